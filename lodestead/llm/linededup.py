"""Line deduplication over a corpus, in DataFrame expressions.

A text is cut into lines at ``\\n``. A line's key is the line without
`[\\x20\\x09-\\x0D]` at its ends and with A-Z lower-cased. Keys of at least ``LEAST``
code points that at least ``DOCUMENTS`` documents hold are common: their lines go
everywhere but in the document with the largest id among those that hold them.

1. Long lines are exploded to (document, position, 128-bit hash of the key), and that
   table, without any text, is kept.
2. Hashes that occur in few rows are set aside by a count that is combined before the
   shuffle. Of the others the distinct documents are counted in two levels, first
   by hash and document, then by hash, so that a line of very many documents is spread.
   Both lists of hashes are kept before the lines are joined to them: an aggregate inside the join would
   fix how its lines are dealt, and Spark could not split those of one hash.
3. Positions of common lines come back by document and are gathered there (a document
   bounds their number); the text is put together from the positions that are left, in linear time.

The text of a document travels once, and only if the positions are more than Spark
broadcasts. Keys are told apart by two 64-bit hashes.

Defined results: null and empty texts are one empty line; a document whose lines all go has
the empty text; all rows of one id count as one document, and rows without an id together as
one that comes before every other; repeated rows repeat; an empty table gives an empty one.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.llm.frames import ids_and_text, keep

#: Code points of a key that is looked at, and documents that make it common.
LEAST = 40
DOCUMENTS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _print(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def long_lines(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id``, ``print`` (of the text), ``at`` (the line's position) and the hash (``h``, ``i``) of each long line's key."""
    rows = docs.where(F.length("text") >= least).select("doc_id", _print(F.col("text")).alias("print"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(_BLANKS))).where(F.length("line") >= least)
    rows = rows.withColumn("line", F.translate("line", _UPPER, _LOWER))
    return rows.select("doc_id", "print", "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("line"), "line").alias("i"))


def common_lines(lines: DataFrame, documents: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``lines`` whose hash occurs often enough to be common, and of the common hashes
    the number of documents and the one that keeps its lines (null: those without an id)."""
    often = keep(lines.groupBy("h", "i").agg(F.count("*").alias("rows")).where(F.col("rows") >= documents).select("h", "i"))
    met = keep(lines.join(often, ["h", "i"]))
    each = met.groupBy("h", "i", "doc_id").agg(F.lit(1).alias("one"))
    common = each.groupBy("h", "i").agg(F.count("*").alias("n_documents"), F.max("doc_id").alias("keeper")).where(F.col("n_documents") >= documents)
    return met, keep(common)


def deduplicate(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """``doc_id``, ``text``, ``n_lines``, ``n_dropped`` and ``kept`` (the lines that stay, joined by ``\\n``) for every row."""
    docs = ids_and_text(docs)
    met, common = common_lines(keep(long_lines(docs, least)), documents)
    gone = met.join(common, ["h", "i"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).agg(F.collect_set("at").alias("_gone"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (_print(F.col("text")) == F.col("_print"))
    rows = docs.join(gone, same, "left").select("doc_id", "text", "_gone")
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\n]+", "")) + 1
    # a lambda's variable holds the split lines, so that they are made once and not for each line
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone"))
    built = F.get(F.transform(F.array(lines_of(F.col("text"))), lambda lines: F.array_join(F.transform(left, lambda at: F.get(lines, at)), "\n")), F.lit(0))
    return rows.select(
        "doc_id", "text", n.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(built).alias("kept"),
    )
