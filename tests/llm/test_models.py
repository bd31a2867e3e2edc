"""Fitted models by their accuracy on held-out texts, and the pipeline on a small corpus."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestead.llm import langid, quality, toxicity
from lodestead.llm.queries import QUERIES
from lodestead.llm.words import utf8

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = QUERIES["op7_language_id"](spark, SF)
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)]
    model = langid.train(spark.createDataFrame([*train, (None, None, None), (99, "x", None)], "doc_id long, text string, lang string"))
    texts = ["the dog", "die katze", "katzen und hunde", None, "", "123 !?", "the " * 50000, "日本", "the dog", "dogs the"]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(texts)], "doc_id long, text string, score double, lang_pred string")
    found = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [found[i].lang_pred for i in range(7)] == ["en", "de", "de", "und", "und", "und", "en"]
    assert found[3].score == 0 and found[7].lang_pred == "de" and found[7].score == 0.5
    assert found[0].score == found[8].score > 0.9 and found[9].lang_pred == "en"
    assert langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.train(docs.where("doc_id < 0").withColumn("lang", F.lit("en")))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_ngrams_stay_in_their_word():
    one, owner = langid._ngrams([b"ab", "é".encode()], 3)
    assert owner.tolist() == [0, 0, 1] and len(set(one.tolist())) == 3
    assert langid._ngrams([b"a"], 6)[0].size == 0


@pytest.mark.parametrize("name, label, least", [("op8_quality", "quality", 0.93), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_labels(spark, name, label, least):
    found = QUERIES[name](spark, SF)
    assert found.count() == 1000
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r[label] == r.predicted for r in rows) / len(rows) > least
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, module, label):
    texts = ["good plain words here", "bad ### words $$$ idiot"] * 20 + [None, "", "a", "é", "words " * 20000]
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in enumerate(texts)] + [(0, texts[0], 1.0, 2)], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(0, 0, "x"), (None, 1, "x"), (3, None, "x"), (7777, 1, "x")], f"doc_id long, {label} int, text string")
    model = module.train(docs, labels)
    found = module.score(docs, model).collect()
    assert len(found) == len(texts) + 1
    of = {r.doc_id: r.score for r in found}
    assert of[1] > 0.7 and of[0] < 0.3 and of[2] == of[0]
    assert module.score(docs.limit(0), model).count() == 0
    empty = module.score(docs, module.train(docs, labels.limit(0))).collect()
    assert {r.score for r in empty} == {0.5 if module is quality else 0.0}


def test_trigrams_stay_in_their_text():
    raw, offsets = utf8(pa.array(["abc", "", "ab", "c", "abcd"]))
    found = quality.counts(raw, offsets)
    assert found[:, : quality.FEATURES].sum(axis=1).tolist() == [1, 0, 0, 0, 2]
    raw, offsets = utf8(pa.array(["a a a b", "a b", "", "b"]))
    assert quality.counts(raw, offsets)[:, quality.FEATURES].tolist() == [50, 0, 0, 0]


def test_votes_are_exact():
    rng = np.random.default_rng(0)
    model = quality.Model(None, None, quality._unit(rng.standard_normal((50, 8)).astype(np.float32)), (np.arange(50) % 2).astype(np.float32), 0.5)
    vectors = quality._unit(rng.standard_normal((30, 8)).astype(np.float32))
    got = quality.votes(model, vectors, 5)
    for v, score in zip(vectors, got):
        near = v @ model.vectors.T
        top = np.argsort(-near)[:5]
        w = np.maximum(near[top], 0)
        assert abs(score - (w * model.labels[top]).sum() / w.sum()) < 1e-5


def test_pipeline(spark, tmp_path):
    sentence = "the quick brown fox jumps over the lazy dog and runs away from the farm before noon today"
    item = "this passage of the benchmark must not be in any text that a model is trained on later"
    texts = [
        sentence, sentence, sentence + " again", "write to ann@x.org about the other matter please", f"so {item} they say", None, "", "123 456", "plain text number seven with words of its own",
        "short", "short", "<|endoftext|> odd",
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(8, texts[8], "en", "s", 1), (8, texts[8], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(found) == [0, 3, 8, 9, 11]
    assert found[3].text == "write to [EMAIL] about the other matter please" and found[3].n_chars == len(found[3].text)
    assert found[0].n_tokens == len(found[0].ids) > 10 and found[0].decoded.replace("</w>", "") == sentence
    assert found[11].ids[0] == 49407
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and (name == "bpe" or none.columns == docs.columns)


def test_pipeline_keeps_unlike_texts(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stages = dict(corpus_pipeline.STAGES)
    nothing = spark.createDataFrame([(1, "some text", None, "s", 9), (2, "other words", None, "s", 11), (3, "12 34", None, "s", 5), (4, None, None, "s", 0)], schema)
    assert sorted(r.doc_id for r in stages["language_id"](spark, nothing, "").collect()) == [1, 2]
    near = stages["jaccard_join"]
    assert near(spark, spark.createDataFrame([(None, f"text of its own number {i}", "en", "s", 1) for i in "abc"], schema), "").count() == 3
    assert near(spark, spark.createDataFrame([(5, "one text of that id", "en", "s", 1), (5, "quite another one", "en", "s", 1)], schema), "").count() == 2
    rows = [(None, "a text of several rows", "en", "s", 1)] * 3 + [(7, "a text of several rows", "en", "s", 1), (8, "A text of several rows", "en", "s", 1), (9, " ", "en", "s", 1), (9, " ", "en", "s", 1)]
    assert sorted(r.doc_id for r in near(spark, spark.createDataFrame(rows, schema), "").collect()) == [7, 9, 9]
    equal = near(spark, spark.createDataFrame([(7, "same text", "fr", "s", 1), (7, "same text", "en", "t", 2)], schema), "").collect()
    assert [tuple(r) for r in equal] == [(7, "same text", "en", "t", 2)]


def test_stages_compose_to_the_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        assert 0 < docs.count() <= before.count()
    rows = {r.doc_id: (r.text, r.ids) for r in docs.collect()}
    assert rows == {r.doc_id: (r.text, r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
