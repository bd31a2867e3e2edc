"""Embedding whitening by shifted Cholesky QR.

A vector's entry c becomes x = floor(64 c) + 1,000,000. The model is fitted on the distinct
x vectors: n of them with sums S, a tall matrix A of centred rows (n x - S) / n, whose numerators are
whole numbers. A is never written:

1. Each pass over the fitted rows makes A, divides it by the triangular factors found so far
   (forward substitution, a batch at a time) and sums the Gram matrix of what results. Partial
   matrices are summed by their rows, so that only one matrix comes to the driver.
2. The first matrix is shifted by a multiple of the rounding error before its Cholesky
   factorisation; passes go on until the Gram matrix is that of orthonormal columns. The factors'
   product R has the singular values and right singular vectors of A, without A'A ever
   being factored at full condition.
3. The SVD of R gives the components v and the eigenvalues e = s^2 / n of the covariance; a row's whitened
   coordinate is (x - S/n) v / sqrt(e). A last pass measures the whitened rows' own covariance.

What is broadcast or collected has the size of the squared dimension. Distinct vectors are found by a
grouped aggregate on their bytes, which tasks combine beforehand: a vector of very many rows costs one row a task.

Defined results: rows are left out whose vector is null or empty, holds null or non-finite entries or
ones of 2^43 or more in size (there x and its sums leave what is exact), or has not the commonest
length (of equally common ones the longest). Rows without an id keep a null id; repeated rows repeat and
count once in the fit. Components without variance (rank below the dimension) have no rows, so one
single vector, like an empty table, gives none. ``deviation`` is null where it exceeds a long. The sign of a component is
such that its largest entry is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.frames import keep, map_batches

#: Components that are returned.
COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Entries of this size and above count as not finite.
LIMIT = 2.0**43
#: Passes at most; three are enough for matrices of full rank.
PASSES = 12
_UNIT = 2.0**-53
_LONG = 2**63 - 1


@dataclass
class Model:
    n: int
    sums: list[int]
    components: np.ndarray  # one column each
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0


def _entries(column) -> list[np.ndarray | None]:
    """Each row's vector in doubles, None where it can't be used."""
    out = []
    sizes = column.value_lengths().to_pylist()
    flat = column.flatten()
    nulls, values = flat.is_null().to_numpy(zero_copy_only=False), flat.cast("double").fill_null(np.nan).to_numpy(zero_copy_only=False)
    good = ~nulls & (np.abs(np.nan_to_num(values, nan=np.inf)) < LIMIT)
    at = 0
    for size in sizes:
        if size is None:
            out.append(None)
            continue
        out.append(values[at : at + size] if size and good[at : at + size].all() else None)
        at += size
    return out


def scaled(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``size`` and ``x`` (the whole numbers x - 1,000,000 as bytes) of rows with a usable vector."""

    def work(batches):
        for batch in batches:
            ids, vectors = batch.column(0).to_pylist(), _entries(batch.column(1))
            found = [i for i, v in enumerate(vectors) if v is not None]
            yield {
                "vec_id": [ids[i] for i in found], "size": [len(vectors[i]) for i in found],
                "x": [np.floor(SCALE * vectors[i]).astype(np.int64).tobytes() for i in found],
            }

    chosen = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return map_batches(chosen, work, "vec_id long, size int, x binary")


def _matrix(batch, column: int) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(column)]) if len(batch) else np.zeros((0, 0), np.int64)


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: in longs where they suffice, else in Python's whole numbers."""
    middle = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle)]
    from_middle = x - np.array(middle, np.int64)
    if n * (int(np.abs(from_middle).max(initial=0)) + 1) < 2**62:
        return from_middle * n - np.array(rest, np.int64)
    return from_middle.astype(object) * n - np.array(rest, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (numerators(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    d = numerators(x, n, sums)
    if d.dtype != object and d.size and int(np.abs(d).max()) ** 2 * d.shape[1] > _LONG:
        d = d.astype(object)
    total = (d * d).sum(axis=1).tolist()
    return [int(t) if t <= _LONG else None for t in total]


def divided(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows R^-1 for an upper triangular R, by forward substitution over the columns."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _summed(fit: DataFrame, size: int, made) -> np.ndarray:
    """The Gram matrix of what ``made`` makes of the fitted rows, with their sums as one more row."""

    def local(batches):
        total = np.zeros((size + 1, size))
        for batch in batches:
            if len(batch):
                rows = made(_matrix(batch, 0))
                total[:size] += rows.T @ rows
                total[size] += rows.sum(axis=0)
        yield {"part": list(range(size + 1)), "data": [row.tobytes() for row in total]}

    def merged(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = np.frombuffer(data.as_buffer(), np.float64)
                sums[i] = sums[i] + row if i in sums else row
        yield {"part": list(sums), "data": [s.tobytes() for s in sums.values()]}

    dealt = map_batches(fit.select("x"), local, "part int, data binary").repartition(min(size + 1, 64), "part")
    out = np.zeros((size + 1, size))
    for row in map_batches(dealt, merged, "part int, data binary").collect():
        out[row["part"]] = np.frombuffer(row["data"], np.float64)
    return out


def factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: shifted Cholesky factors, composed until the rows divided by them are orthonormal
    (in the directions that have any variance)."""
    size, factors = len(sums), []

    def made(x):
        rows = centred(x, n, sums)
        for r in factors:
            rows = divided(rows, r)
        return rows

    whole = np.eye(size)
    for _ in range(PASSES):
        gram = _summed(fit, size, made)[:size]
        gram = (gram + gram.T) / 2
        if factors and np.abs(gram @ gram - gram).max() <= 64 * size * _UNIT:
            break
        norm = np.trace(gram)
        # the first shift is that of the method; later ones only keep directions without variance factorable
        shift = 11 * (n * size + size * (size + 1)) * _UNIT * norm if not factors else 4 * size * _UNIT * norm
        if norm == 0:
            return np.zeros((size, size))
        r = np.linalg.cholesky(gram + max(shift, np.finfo(float).tiny) * np.eye(size)).T
        factors = [*factors, r]
        whole = r @ whole
    return whole


def train(fit: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of distinct vectors (``x``); None if there are none."""
    first = fit.select(F.length("x")).first()
    if first is None:
        return None
    size = first[0] // 8

    def sums(batches):
        n, total = 0, [0] * size
        for batch in batches:
            if len(batch):
                x = _matrix(batch, 0)
                n += len(x)
                total = [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
        yield {"i": list(range(size + 1)), "total": [str(t) for t in [*total, n]]}

    whole = map_batches(fit.select("x"), sums, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = {r["i"]: int(r["total"]) for r in whole.collect()}
    n, sums_x = totals[size], [totals[i] for i in range(size)]
    r = factor(fit, n, sums_x)
    _, s, turned = np.linalg.svd(r)
    e, v = s**2 / n, turned.T
    rank = int((s > s.max(initial=0.0) * size * 2.0**-40).sum()) if s.max(initial=0.0) > 0 else 0
    k = min(components, rank)
    v = v[:, :k] * np.where(v[np.abs(v).argmax(axis=0), np.arange(size)] < 0, -1.0, 1.0)[:k]
    model = Model(n, sums_x, v, e[:k], float(e.sum()))
    if k:
        gram = _summed(fit, k, lambda x: whitened(x, model))
        mean = gram[k] / n
        model.identity_error = float(np.abs(gram[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whitened(x: np.ndarray, model: Model) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.components / np.sqrt(model.eigenvalues)


def fitted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the commonest length, and their distinct vectors."""
    rows = keep(rows)
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.col("size") == (sizes["size"] if sizes else 0))
    return rows, keep(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every usable row and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``."""
    rows, fit = fitted(scaled(embeddings, vec_id, vector))
    model = train(fit, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return embeddings.sparkSession.createDataFrame([], schema)
    shared = embeddings.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        k = len(model.eigenvalues)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch, 1)
            out, ids, far = whitened(x, model), batch.column(0).to_pylist(), deviations(x, model.n, model.sums)
            yield {
                "vec_id": [i for i in ids for _ in range(k)], "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                "n": np.full(k * len(x), model.n), "deviation": [d for d in far for _ in range(k)], "whitened": out.ravel(),
                "explained": np.tile(model.eigenvalues / model.trace, len(x)), "identity_error": np.full(k * len(x), model.identity_error),
            }

    return map_batches(rows.select("vec_id", "x"), work, schema)
