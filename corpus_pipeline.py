"""From raw documents to a tokenised training corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
what it returns is written as Parquet and read again as the next one's documents.
All but the last keep the columns of ``documents``.

1. Language ID drops documents that have no language: null texts and texts without a letter. Where no
   row has a language to learn from, all others stay.
2. The n-gram Jaccard join keeps of each component of near-duplicate texts one row: that of the
   smallest id (of several texts of that id, the one whose hash is the least; of rows
   without an id one if there is no other; of equal rows one). Different texts stay, whether or not they
   have an id of their own. Documents without words are no duplicates of each other and stay.
3. Benchmark decontamination drops documents that share ten consecutive words with
   a benchmark item, or a whole shorter item.
4. PII generalises personal data, and terms that disclose it, to their kinds in brackets,
   and sets ``n_chars`` anew.
5. Byte pair encoding adds ``ids`` and ``n_tokens``, and ``decoded``, the text that the ids stand for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.checkpoints import cut
from lodestead.llm import bpe, decontaminate, langid, pii, setjoin
from lodestead.llm.frames import documents, shared_folder

#: SQL can express neither the fitted language model nor byte pair encoding.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, model, out="_language", score="_score")
    return found.where(F.col("_language") != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = setjoin.placed(docs).withColumn("_none", F.col("doc_id").isNull())
    texts = found.groupBy(F.col("doc_id").alias("_id"), "_none", F.col("print").alias("_print"), "root").agg(F.count("*").alias("_rows"))
    first = F.min(F.struct("_none", "_id", "_print", "_rows")).alias("_first")
    kept = texts.where("root IS NOT NULL").groupBy("root").agg(first).select("_first.*")
    wordless = texts.where("root IS NULL").select("_none", "_id", "_print", F.lit(1).cast("long").alias("_rows"))
    kept = cut(kept.unionByName(wordless))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_print"))
    once = docs.join(kept.where("_rows = 1"), same, "left_semi")
    several = kept.where("_rows > 1")
    if several.isEmpty():
        return once
    repeated = docs.join(several, same, "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = repeated.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias("_row"))
    return once.unionByName(least.select("doc_id", "text", *[F.col(f"_row.{c}") for c in rest]).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    found = bpe.encode(docs, path).withColumn("n_tokens", F.size("ids").cast("long"))
    return bpe.decode(found, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what is between stages is written to the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
