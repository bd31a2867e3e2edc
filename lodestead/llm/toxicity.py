"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes ratios.

Features say whether a text holds an n-gram of 4 or 5 characters (bytes; A-Z
lower-cased, runs of other ASCII that is no letter count as one blank), hashed
to ``FEATURES`` buckets. Each is scaled by its naive Bayes log-count ratio: the
log of how much likelier it is in labelled toxic texts. A logistic regression over
the scaled features is fitted on a bounded sample of labelled texts (``SAMPLE``
expected for each label); the ratios are from the same texts. Every text is
scored whole, in one pass.

Defined results: null and empty texts score as the bias alone; without labels of
both kinds every score is 0; repeated rows repeat; empty tables stay empty. Only
the named columns of either table are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.frames import ids_and_text, map_batches
from lodestead.llm.words import rows_by_bytes, utf8

SAMPLE = {1: 1000, 0: 2500}
FEATURES = 1 << 18
SIZES = (4, 5)
#: Sample texts that must hold a feature before it counts.
LEAST = 4
#: Weight of the squared coefficients, and steps of the fit.
RIDGE = 1.0
STEPS = 80

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def present(text: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The buckets of one text's n-grams, ascending. ``seen``: all false, and so again afterwards."""
    folded = _FOLD[text]
    blank = folded == 32
    keep = np.append(True, ~(blank[1:] & blank[:-1])) if len(folded) else np.zeros(0, bool)
    folded = np.concatenate([[32], folded[keep], [32]]).astype(np.uint32)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    base = folded[:-3] | (folded[1:-2] << np.uint32(8)) | (folded[2:-1] << np.uint32(16)) | (folded[3:] << np.uint32(24)) if len(folded) > 3 else folded[:0]
    seen[(base * np.uint32(0x9E3779B1)) >> shift] = True
    if len(folded) > 4:
        more = (base[:-1] * np.uint32(0x85EBCA6B)) ^ (folded[4:] * np.uint32(0xC2B2AE35))
        seen[((more ^ (more >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> shift] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: dict[int, int] = SAMPLE) -> Model:
    """Fit on texts that ``labels`` (doc_id and ``label``, 0 or 1) speaks of."""
    nothing = Model(np.zeros(FEATURES, np.float32), -np.inf)
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return nothing
    share = F.when(F.col("label") == 1, min(1.0, sample[1] / sizes[1])).otherwise(min(1.0, sample[0] / sizes[0]))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity sample")), F.lit(1 << 20)) < share * (1 << 20))
    drawn = drawn.groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = ids_and_text(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label")

    def work(batches):
        seen = np.zeros(FEATURES, bool)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            found = [present(raw[a:b], seen).astype(np.int32).tobytes() for a, b in zip(offsets, offsets[1:])]
            yield {"doc_id": batch.column(0), "label": batch.column(2), "found": found}

    table = map_batches(rows, work, "doc_id long, label int, found binary").toArrow()
    ids, y = table["doc_id"].to_numpy(), table["label"].to_numpy()
    found = [np.frombuffer(x.as_py(), np.int32) for x in table["found"]]
    order = sorted(range(len(found)), key=lambda i: (ids[i], found[i].tobytes()))
    if len(set(y.tolist())) < 2:
        return nothing
    return fit([found[i] for i in order], y[order])


def fit(found: list[np.ndarray], y: np.ndarray) -> Model:
    """From each text's buckets and its label."""
    toxic = np.bincount(np.concatenate([f for f, v in zip(found, y) if v == 1]), minlength=FEATURES).astype(float)
    clean = np.bincount(np.concatenate([f for f, v in zip(found, y) if v == 0]), minlength=FEATURES).astype(float)
    texts = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    ratio = np.log((toxic + 1) / (texts[0] + 2)) - np.log((clean + 1) / (texts[1] + 2))
    used = toxic + clean >= LEAST
    place = (np.cumsum(used) - 1).astype(np.int32)
    column = np.concatenate([place[f[used[f]]] for f in found])
    row = np.repeat(np.arange(len(found), dtype=np.int32), [int(used[f].sum()) for f in found])
    by_column = np.argsort(column, kind="stable").astype(np.int32)
    texts_of = row[by_column]  # the texts that hold each feature, feature by feature
    ends = np.searchsorted(row, np.arange(len(found) + 1))
    edges = np.searchsorted(column[by_column], np.arange(int(used.sum()) + 1))
    del row, by_column
    r = ratio[used]

    def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1)
        np.cumsum(values, out=total[1:])
        return total[bounds[1:]] - total[bounds[:-1]]

    w, b = np.zeros(len(r)), 0.0
    m_w, v_w, m_b, v_b = np.zeros(len(r)), np.zeros(len(r)), 0.0, 0.0
    target = y.astype(float)
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        z = sums((w * r)[column], ends) + b
        gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / len(found)
        g_w = sums(gap[texts_of], edges) * r + RIDGE * w / len(found)
        g_b = gap.sum()
        m_w, v_w = 0.9 * m_w + 0.1 * g_w, 0.999 * v_w + 0.001 * g_w * g_w
        m_b, v_b = 0.9 * m_b + 0.1 * g_b, 0.999 * v_b + 0.001 * g_b * g_b
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.02 * (m_w / c1) / (np.sqrt(v_w / c2) + 1e-8)
        b -= 0.02 * (m_b / c1) / (np.sqrt(v_b / c2) + 1e-8)
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = w * r
    return Model(weights, float(b))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``score`` (higher: label 1 likelier) and ``predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        seen = np.zeros(FEATURES, bool)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            z = np.array([model.weights[present(raw[a:b], seen)].sum() + model.bias for a, b in zip(offsets, offsets[1:])], float)
            found = np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700))))
            yield {"doc_id": batch.column(0), "score": found, "predicted": (found >= threshold).astype(np.int32)}

    return map_batches(ids_and_text(docs), work, "doc_id long, score double, predicted int")
