"""Document fingerprints: the k smallest distinct shingle hashes of a text.

A shingle is five consecutive words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); a
text with fewer words, but not none, has one shingle, the whole sequence. Two
fingerprints of one k estimate resemblance and containment of their texts, one
estimates the number of distinct shingles, and the fingerprint of a text in
parts is the merger of the parts' fingerprints. Estimates are exact while the
sets fit k.

Defined results: null text is the empty text, whose fingerprint is empty; two
empty ones resemble each other fully (1.0), an empty and another not at all;
equal texts have equal fingerprints, repeated rows repeated results; empty tables
give empty tables. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.frames import ids_and_text, map_batches
from lodestead.llm.words import hash_words, rows_by_bytes, shingles, utf8

WORDS = 5
K = 128


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    if len(hashes) > 8 * k:  # most values are far above the k-th smallest
        low = np.unique(hashes[hashes < np.uint64(int(4 * k / len(hashes) * 2.0**64))])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The fingerprint of what both describe together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated size of the intersection over the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    if len(a) < k and len(b) < k:
        common = int(twice.sum())
        return common / (len(both) - common)
    first = np.append(True, ~twice)
    rank = np.cumsum(first)  # the distinct value's place in the union
    n = min(k, int(rank[-1]))
    return int((twice & (rank[1:] <= n)).sum()) / n


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    like, na, nb = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return min(1.0, like / (1 + like) * (na + nb) / na)


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def fingerprints(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    raw, offsets = utf8(texts)
    out = []
    for a, b in rows_by_bytes(offsets):
        words = hash_words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        at = words.bounds
        out += [bottom_k(shingles(words.hashes[at[i] : at[i + 1]], WORDS), k) for i in range(b - a)]
    return out


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc_id``, ``fingerprint`` (base64 of the hashes) and ``n_shingles``, the estimated distinct shingles."""

    def work(batches):
        for batch in batches:
            found = fingerprints(batch.column(1), k)
            yield {"doc_id": batch.column(0), "fingerprint": [to_text(a) for a in found], "n_shingles": [distinct(a, k) for a in found]}

    return map_batches(ids_and_text(docs), work, "doc_id long, fingerprint string, n_shingles double")


def merge_by(rows: DataFrame, key: str, k: int = K, spread: int = 64) -> DataFrame:
    """One fingerprint for each value of ``key`` from rows (key, fingerprint). Each step folds
    what a task has first, and a hot key's partial results meet in ``spread`` places, then in one."""

    kind = rows.schema[key].dataType.simpleString()

    def fold(batches):
        state: dict = {}
        for batch in batches:
            for value, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = from_text(text or "")
                state[value] = merge(state[value], new, k) if value in state else new[:k]
        if state:
            yield {key: list(state), "fingerprint": [to_text(a) for a in state.values()]}

    schema = f"`{key}` {kind}, fingerprint string"
    parts = map_batches(rows.select(key, "fingerprint"), fold, schema)
    some = parts.repartition(F.col(key), F.pmod(F.xxhash64("fingerprint"), F.lit(spread)))
    parts = map_batches(some, fold, schema)
    return map_batches(parts.repartition(F.col(key)), fold, schema)


def neighbours(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``range``, ``extra``: the rows dealt out to ranges of ascending ids, and for each
    range, marked ``extra``, a copy of the row that follows its last one (the first row follows the very last).

    The ranges' bounds and first rows are all that passes the driver: a few numbers for each range. Texts are
    shuffled once. Rows without an id come first; rows of one id are in the order of their texts, nulls first."""
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    shares = [i / n for i in range(1, n)]
    bounds = ids.select(F.percentile_approx("doc_id", shares, max(10_000, 20 * n)).alias("b")).first()["b"] or []
    bounds = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("long")
    def place(values: pd.Series) -> pd.Series:
        empty = values.isna().to_numpy()
        found = np.searchsorted(bounds, values.fillna(0).to_numpy().astype(np.int64), "right")
        return pd.Series(np.where(empty, -1, found))

    placed = docs.withColumn("range", place("doc_id"))
    heads = ids.withColumn("range", place("doc_id")).groupBy("range").agg(F.min("doc_id").alias("head"))
    heads = sorted((r["range"], r["head"]) for r in heads.collect())
    if not heads:
        return placed.withColumn("extra", F.lit(False))
    follows = [(heads[(i + 1) % len(heads)][1], r) for i, (r, _) in enumerate(heads)]
    follows = spark.createDataFrame(follows, "head long, range long")
    first = docs.join(F.broadcast(follows), F.col("doc_id").eqNullSafe(F.col("head")))
    first = first.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    extra = first.select("row.doc_id", "row.text", "range", F.lit(True).alias("extra"))
    rows = placed.select("doc_id", "text", "range", F.lit(False).alias("extra")).unionByName(extra)
    return rows.repartition(n, "range").sortWithinPartitions("range", "extra", "doc_id", "text")


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document's, by ascending id; the first follows the last."""

    def work(batches):
        held = None  # (range, extra, id, text, fingerprint) of the row before
        for batch in batches:
            own = fingerprints(batch.column(1), k)
            rows = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(0).to_pylist(), (t or "" for t in batch.column(1).to_pylist()), own))
            if held is not None:
                rows.insert(0, held)
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
            held = rows[-1] if rows else None
            if not pairs:
                continue
            changed = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
            after = fingerprints(pa.array(changed, pa.large_string()), k)
            yield {
                "doc_id": [a[2] for a, _ in pairs],
                "n_chars": [len(a[3]) for a, _ in pairs],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                "fingerprint": [to_text(a[4]) for a, _ in pairs],
                "edited_fingerprint": [to_text(f) for f in after],
                "near_edited": [resemblance(a[4], f, k) for (a, _), f in zip(pairs, after)],
                "near_next": [resemblance(a[4], b[4], k) for a, b in pairs],
            }

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_batches(neighbours(ids_and_text(docs)), work, schema)
