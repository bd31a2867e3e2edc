"""Quality by the votes of the nearest labelled texts in a latent-semantic space.

Features are hashed character trigrams (bytes, case kept) and the share of words
that repeat the one before: dampened counts times inverse document frequency,
scaled to length one. A truncated singular value
decomposition of a bounded, stratified sample of labelled texts (``SAMPLE``
expected for each label) gives the space. The sample's vectors are broadcast (a
fixed bound); each text is compared with all of them by exact cosine products,
block by block, and its ``NEIGHBOURS`` nearest vote with their labels, weighted
by similarity. Every text is scored whole, in one pass.

Defined results: null and empty texts, and texts that resemble no labelled one,
get the sample's mean label; without any label the score is 0.5; ties among
neighbours go to the earlier sample row; repeated rows repeat; empty tables stay
empty. Only the named columns of either table are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.frames import ids_and_text, map_batches
from lodestead.llm.words import hash_words, rows_by_bytes, utf8

SAMPLE = 1200
FEATURES = 4096
DIMENSIONS = 64
#: Weight of the share of repeated words among the trigrams.
REPEATS = 8
NEIGHBOURS = 15
BLOCK = 1024


@dataclass
class Model:
    scale: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts by bucket, a row for each text; the last column has the percentage of
    words that repeat the word before them."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES + 1), np.float32)
    words = hash_words(raw, offsets)
    again = np.zeros(len(words.hashes) + 1)
    np.cumsum(np.append(False, words.hashes[1:] == words.hashes[:-1])[: len(words.hashes)], out=again[1:])
    a, b = np.minimum(words.bounds[:-1] + 1, words.bounds[1:]), words.bounds[1:]
    out[:, FEATURES] = 100 * (again[b] - again[a]) / np.maximum(1, b - words.bounds[:-1])
    if len(raw) < 3:
        return out
    wide = raw.astype(np.uint32)
    code = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES.bit_length() + 1)
    size = np.diff(offsets)
    own = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, size)
    inside = np.ones(len(raw), bool)
    for back in (1, 2):  # a trigram may not reach into the next text
        at = offsets[1:] - back
        inside[at[at >= 0]] = False
    # texts shorter than three bytes must not unmark what is before them
    for i in np.flatnonzero(size < 2):
        for back in range(1, 3):
            at = int(offsets[i + 1]) - back
            if 0 <= at < offsets[i]:
                j = int(np.searchsorted(offsets, at, "right")) - 1
                inside[at] = offsets[j + 1] - at >= 3
    inside = inside[:-2]
    flat = np.bincount(own[:-2][inside] + code[inside], minlength=n * FEATURES)
    out[:, :FEATURES] = flat.reshape(n, FEATURES)
    return out


def _dampened(found: np.ndarray) -> np.ndarray:
    x = np.log1p(found)
    x[:, FEATURES] *= REPEATS
    return x


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length == 0, 1, length)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """Fit on texts that ``labels`` (doc_id and ``label``, 0 or 1) speaks of."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not sizes:
        return Model(np.zeros(FEATURES + 1, np.float32), np.zeros((FEATURES + 1, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    share = F.when(F.col("label") == 1, min(1.0, sample / sizes.get(1, 1))).otherwise(min(1.0, sample / sizes.get(0, 1)))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality sample")), F.lit(1 << 20)) < share * (1 << 20))
    drawn = drawn.groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = ids_and_text(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label")

    def work(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in rows_by_bytes(offsets):
                found = counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).astype(np.float32)
                part = batch.slice(a, b - a)
                yield {"doc_id": part.column(0), "label": part.column(2), "found": [r.tobytes() for r in found]}

    table = map_batches(rows, work, "doc_id long, label int, found binary").toArrow()
    ids, label_of = table["doc_id"].to_numpy(), table["label"].to_numpy()
    found = [np.frombuffer(x.as_py(), np.float32) for x in table["found"]]
    order = sorted(range(len(found)), key=lambda i: (ids[i], found[i].tobytes()))
    if not order:
        return Model(np.zeros(FEATURES + 1, np.float32), np.zeros((FEATURES + 1, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = np.stack([found[i] for i in order])
    y = label_of[order].astype(np.float32)
    scale = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = _unit(_dampened(x) * scale)
    rank = min(dimensions, *x.shape)
    basis = np.random.default_rng(7).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(5):  # subspace iteration towards the leading right singular vectors
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    space = (basis @ turn.T)[:, :rank].astype(np.float32)
    return Model(scale, space, _unit(x @ space), y, float(y.mean()))


def votes(model: Model, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted mean label of the nearest sample rows, exactly, in blocks."""
    out = np.full(len(vectors), model.prior)
    k = min(neighbours, len(model.vectors))
    if not k:
        return out
    for at in range(0, len(vectors), BLOCK):
        near = vectors[at : at + BLOCK] @ model.vectors.T
        top = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(float)
        total = weight.sum(axis=1)
        some = total > 0
        out[at : at + BLOCK][some] = ((weight * model.labels[top]).sum(axis=1)[some] / total[some]).clip(0, 1)
    return out


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``score`` (higher: label 1 likelier) and ``predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            found = np.zeros(len(batch))
            for a, b in rows_by_bytes(offsets, 1 << 20):
                x = _dampened(counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) * model.scale
                found[a:b] = votes(model, _unit(_unit(x) @ model.space))
            yield {"doc_id": batch.column(0), "score": found, "predicted": (found >= threshold).astype(np.int32)}

    return map_batches(ids_and_text(docs), work, "doc_id long, score double, predicted int")
