"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Of every
``GRAM`` consecutive words a hash is taken, and of every window of ``WINDOW`` words
the least of its hashes is kept (the last one of equals), once for consecutive
windows that agree. Two texts that share a window of ten words therefore share
one kept hash inside it: every shared span of that length is found. Texts meet on
kept hashes; a meeting is compared word by word and extended to either side as far
as a window reaches, so hashes only propose. Items with fewer than ``WINDOW`` words
are looked up whole, by runs of their length.

The benchmark's side of a join is broadcast when it is measured to hold at most
``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes; beyond, both sides are shuffled
on the hash, and Spark splits the documents' rows of a passage that very many of them have.
A document's hits meet as a set of spans, whose number its own length
bounds. Benchmark items with equal words are looked up once.

Words are hashed once each, lower-cased by themselves (so that a word's hash doesn't depend on
what stands beside it); a run is hashed from its words' hashes. All lengths of short
items are looked up in one pass over the documents.

Defined results: null and empty texts have no words and no hits; items without words
or without an id never occur; repeated document rows give as many equal rows; empty
tables give no rows, or no hits. Only ``doc_id``/``item_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.llm.frames import keep

GRAM = 5
WINDOW = 10
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
#: Documents to drop that are sent to all texts, of 16 bytes each.
SENT_ROWS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS, -1), "")


def raw_words(text: Column) -> Column:
    """The words as they stand."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _RAW_SEPARATORS, -1), "")


def word_hashes(words: str) -> Column:
    """A hash of each word. Words that agree but for A-Z agree here, too; which others do, the comparison of
    words tells."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _grams(words: str) -> Column:
    """A hash of every ``GRAM`` words in a row. The words' hashes are bound to a lambda's variable: as a column
    they would be put into the inner lambda and be made again for each place."""
    places = F.sequence(F.lit(0), F.size(words) - GRAM)
    each = lambda h: F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(GRAM)]))
    return F.get(F.transform(F.array(word_hashes(words)), each), F.lit(0))


def small_enough(side: DataFrame, rows: int) -> bool:
    """Whether ``side`` is measured to fit a broadcast."""
    size = F.sum(F.length(F.to_json(F.struct("*"))))
    found = side.limit(rows + 1).agg(F.count("*").alias("rows"), size.alias("bytes")).first()
    return found["rows"] <= rows and (found["bytes"] or 0) <= BROADCAST_BYTES


def kept_hashes(rows: DataFrame) -> DataFrame:
    """For rows with ``words`` and ``print``: their columns with ``hash`` and ``at`` for each kept hash, and
    one row with ``at`` null for each row (dealt by its ``print``), so that none gets lost."""
    n, count = F.size("words"), WINDOW - GRAM + 1
    rows = rows.withColumn("grams", F.when(n >= WINDOW, _grams("words")).otherwise(F.array().cast("array<long>")))
    spread = rows.withColumn("from", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.size("grams") - count))))
    gram = [F.get("grams", F.col("from") + i) for i in range(count)]
    # a window keeps something new if its last hash is the least, or if the one that has left was
    middle = F.least(*gram[:-1])
    new = (F.col("from") <= 0) | (gram[-1] <= middle) | (F.get("grams", F.col("from") - 1) < middle)
    kept = spread.where(new).withColumn("hash", F.when(F.col("from") >= 0, F.least(*gram)).otherwise(F.col("print")))
    place = F.lit(0)
    for i in range(1, count):
        place = F.when(gram[i] == F.col("hash"), i).otherwise(place)
    return kept.withColumn("at", F.when(F.col("from") >= 0, F.col("from") + place)).drop("grams", "from")


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct word sequences of the benchmark with the ids (as strings) of the items that have them."""
    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text").cast("string")).alias("words"))
    return rows.where(F.size("words") > 0).groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _agreeing(words: str, around: str) -> tuple[Column, Column]:
    """How many words agree in a row to the left of the places ``at`` and ``lead``, and from there on to the right. The
    lambda keeps this, which few rows need, out of the code generated for all places of all texts."""
    same = lambda d: F.translate(F.get(words, F.col("at") + d), _UPPER, _LOWER) == F.get(around, F.col("lead") + d)
    differ = F.filter(F.array(*[F.lit(d) for d in range(GRAM - WINDOW, WINDOW)]), lambda d: ~F.coalesce(same(d), F.lit(False)))
    left = -1 - F.coalesce(F.array_max(F.filter(differ, lambda d: d < 0)), F.lit(GRAM - WINDOW - 1))
    return left, F.coalesce(F.array_min(F.filter(differ, lambda d: d >= 0)), F.lit(WINDOW))


def spans(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id``, ``print`` (a hash of the text), ``n_words``, ``first``, ``last`` (words, from 0) and ``items`` for
    each span that documents share with items; and one row without a span for each document row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("print"), raw_words(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    items = items_of(benchmark)
    long_items = kept_hashes(items.where(F.size("words") >= WINDOW).withColumn("print", F.lit(0).cast("long"))).where("at IS NOT NULL")
    lead = F.least(F.col("at"), F.lit(WINDOW - GRAM))
    long_items = long_items.select(F.col("hash").alias("item_hash"), "items", lead.alias("lead"), F.slice("words", F.col("at") - lead + 1, F.lit(2 * WINDOW - GRAM)).alias("around"))
    lengths = sorted(r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n") < WINDOW).distinct().collect())
    if small_enough(long_items, broadcast_rows):
        long_items = F.broadcast(long_items)
    # what a meeting needs goes with the hash, not the whole text
    start = F.greatest(F.col("at") - (WINDOW - GRAM), F.lit(0))
    found = kept_hashes(rows).withColumn("words", F.slice("words", start + 1, F.lit(2 * WINDOW - GRAM))).withColumn("shift", start).withColumn("at", F.col("at") - start)
    met = found.join(long_items, (F.col("hash") == F.col("item_hash")) & F.col("at").isNotNull(), "left")
    left, right = _agreeing("words", "around")
    met = met.where("at IS NULL OR item_hash IS NOT NULL").withColumn("left", left).withColumn("right", right)
    met = met.where((F.col("at").isNull()) | ((F.col("right") >= GRAM) & (F.col("left") + F.col("right") >= WINDOW)))
    hit = F.col("at").isNotNull()
    out = met.select(
        "doc_id", "print", "n_words", F.when(hit, F.col("shift") + F.col("at") - F.col("left")).alias("first"),
        F.when(hit, F.col("shift") + F.col("at") + F.col("right") - 1).alias("last"), F.when(hit, F.col("items")).alias("items"),
    )
    return out.unionByName(_short_spans(rows, items, lengths, broadcast_rows)) if lengths else out


def _short_spans(rows: DataFrame, items: DataFrame, lengths: list[int], broadcast_rows: int) -> DataFrame:
    """The spans of items of fewer than ``WINDOW`` words; ``lengths`` are those that occur."""
    short = items.where(F.size("words") < WINDOW).select(F.xxhash64(word_hashes("words")).alias("item_hash"), "items", F.col("words").alias("around"))
    if small_enough(short, broadcast_rows):
        short = F.broadcast(short)
    # nothing between the explosions and the join may leave generated code, which would copy a text's words for each place
    runs = rows.withColumn("hashes", word_hashes("words")).withColumn("n", F.explode(F.array(*[F.lit(x) for x in lengths])))
    runs = runs.withColumn("at", F.explode(F.when(F.size("words") >= F.col("n"), F.sequence(F.lit(0), F.size("words") - F.col("n")))))
    runs = runs.select("doc_id", "print", "n_words", "at", "n", F.xxhash64(F.slice("hashes", F.col("at") + 1, F.col("n"))).alias("hash"), F.slice("words", F.col("at") + 1, F.col("n")).alias("run"))
    exact = F.transform("run", lambda w: F.translate(w, _UPPER, _LOWER)) == F.col("around")
    same = runs.join(short, F.col("hash") == F.col("item_hash")).where(exact)
    return same.select("doc_id", "print", "n_words", F.col("at").alias("first"), (F.col("at") + F.col("n") - 1).alias("last"), "items")


def report(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id``, ``print``, ``n_words``, ``n_hit`` (words inside spans), ``n_items``, ``items`` (sorted) and ``contaminated``
    for each document row."""
    found = spans(docs, benchmark, broadcast_rows).groupBy("doc_id", "print").agg(
        F.max("n_words").alias("n_words"), F.sum(F.when(F.col("first").isNull(), 1).otherwise(0)).alias("copies"),
        F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "last"))).alias("spans"), F.collect_set("items").alias("items"),
    )
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(so_far: Column, span: Column) -> Column:
        new = F.greatest(F.lit(0), span["last"] - F.greatest(so_far["end"] + 1, span["first"]) + 1)
        return F.struct(F.greatest(so_far["end"], span["last"]).alias("end"), (so_far["n"] + new).alias("n"))

    counted = F.aggregate(F.sort_array("spans"), start, add, lambda x: x["n"])
    out = found.select("doc_id", "print", "n_words", counted.alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"), "copies")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("doc_id", "print", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.0) -> DataFrame:
    """The documents without contamination, with all their columns. ``least_share``: keep also those of
    whose words at most this share is inside spans. Texts stay where they are if the ids of those to drop
    are measured to be few enough to be sent to them."""
    found = spans(docs, benchmark).where("first IS NOT NULL").select("doc_id", "print").distinct()
    if least_share:
        rows = docs.withColumn("_print", F.xxhash64(F.col("text").cast("string")))
        some = rows.join(found, F.col("_print") == F.col("print"), "left_semi")
        found = report(some, benchmark).where(F.col("n_hit") > least_share * F.col("n_words")).select("doc_id", "print").distinct()
    bad = keep(found)
    if small_enough(bad, SENT_ROWS):
        bad = F.broadcast(bad)
    key = F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("b.print"))
    return docs.alias("d").join(bad.alias("b"), key, "left_anti")
