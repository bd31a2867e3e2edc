"""The registered queries of this package: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.llm import bloomlm, bpe, decontaminate, langid, linededup, pii, quality, setjoin, sketch, tokencount, toxicity, turns, whitening
from lodestead.llm.frames import bucket, documents, ids_and_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited(documents(spark, sf_dir))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(bucket(F.col("doc_id"), 3) != 1))
    found = langid.predict(ids_and_text(docs), model)
    return found.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(bucket(F.col("doc_id"), 5) != 0))
    found = quality.score(docs, model)
    return found.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(bucket(F.col("doc_id"), 3) != 1))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomlm.score(documents(spark, sf_dir), bucket(F.col("doc_id"), 7) == 2)


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


_OP2_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark WHERE item_id IS NOT NULL),
words AS (
  SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
item_windows AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM words WHERE kind = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT id AS doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE kind = 'd' AND len(w) >= n)),
hits AS (SELECT doc_id, d.n, i, item_id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.run = b.run),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered ON id = covered.doc_id LEFT JOIN found ON id = found.doc_id WHERE kind = 'd'
"""


@query("op2_decontaminate", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar(documents(spark, sf_dir))


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.report(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


_OP11_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, place, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents)),
common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, text, place, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines LEFT JOIN common USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op11_line_dedup", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.deduplicate(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(documents(spark, sf_dir, "embeddings"))


@query("op13_turn_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(turns.damage(documents(spark, sf_dir, "conversations")))
