"""Ridge regression of every fold from one pass over the rows.

What ridge needs of the rows adds up: a Gram matrix for each fold, from which the matrix of
"all but this fold" follows by subtraction. Suburbs, of which there can be very many, never become
columns: their block of the normal equations is diagonal, so it is eliminated suburb by suburb
(a sum over suburbs, made where they lie), the rest is solved on the driver, and each suburb's weight follows from
that. The rest has one column for each scalar feature and property type; nothing grows with rows or suburbs.

The intercept is not penalized and features are not scaled; scalars and rents are taken from their means, which
changes nothing but the rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.checkpoints import cut
from lodestead.operators.merge import send_if_small


@dataclass
class Model:
    """``core`` has for each model the intercept, the scalars' weights and the types' weights; ``suburbs``
    (None without labels) is a table of ``suburb_bucket`` and ``_s``, the weights of the suburb in each model."""

    scalars: list[str]
    means: np.ndarray
    types: list[str]
    core: np.ndarray
    suburbs: DataFrame | None


def _matrix(batch, n_scalars: int, n_types: int, means: np.ndarray):
    """fold, rent and (1, scalars, type) of a batch of (fold, y, x, type)."""
    fold, y = batch.column(0).to_numpy(), batch.column(1).to_numpy() - means[0]
    z = np.zeros((len(fold), 1 + n_scalars + n_types))
    z[:, 0] = 1.0
    z[:, 1 : 1 + n_scalars] = batch.column(2).flatten().to_numpy().reshape(len(fold), n_scalars) - means[1:]
    if n_types:
        z[np.arange(len(fold)), 1 + n_scalars + batch.column(3).to_numpy()] = 1.0
    return fold, y, z


def _added(rows: DataFrame, work, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of what ``work`` makes of a task's batches; parts are summed on the executors."""

    def local(batches):
        total = work(batches).reshape(shape[0], -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["part", "data"])

    def merged(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0.0) + np.frombuffer(data)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "data"])

    kind = "part int, data binary"
    out = np.zeros((shape[0], int(np.prod(shape[1:]))))
    for row in rows.mapInArrow(local, kind).repartition(shape[0], "part").mapInArrow(merged, kind).collect():
        out[row["part"]] = np.frombuffer(row["data"])
    return out.reshape(shape)


def fit(rows: DataFrame, scalars: list[str], labels: bool, used: np.ndarray, alpha: float) -> Model:
    """``rows``: ``fold``, ``y``, ``x`` (the scalars, an array) and, with ``labels``, ``property_label`` and ``suburb_bucket``.
    ``used``: for each model (row) and fold (column), whether the model sees the fold (1.0 or 0.0)."""
    rows = cut(rows)
    found = rows.agg(F.avg("y"), *[F.avg(F.get("x", F.lit(i))) for i in range(len(scalars))]).first()
    means = np.array([m or 0.0 for m in found], float)
    types = sorted(r[0] for r in rows.select("property_label").distinct().collect()) if labels else []
    n_s, n_t, (n_models, n_folds) = len(scalars), len(types), used.shape
    p = 1 + n_s + n_t

    coded = rows.withColumn("type", F.lit(0))
    if labels:
        codes = rows.sparkSession.createDataFrame([(t, i) for i, t in enumerate(types)], "property_label string, type int")
        coded = rows.join(F.broadcast(codes), "property_label")
    coded = coded.select("fold", "y", "x", "type", *(["suburb_bucket"] if labels else []))

    def grams(batches):
        total = np.zeros((n_folds, p, p + 1))
        for batch in batches:
            fold, y, z = _matrix(batch, n_s, n_t, means)
            for f in np.unique(fold):
                own = z[fold == f]
                total[f] += own.T @ np.column_stack([own, y[fold == f]])
        return total

    sums = _added(coded.select("fold", "y", "x", "type"), grams, (n_folds, p, p + 1))
    system = np.einsum("mf,fij->mij", used, sums)
    system[:, np.arange(1, p), np.arange(1, p)] += alpha
    if not labels:
        return Model(scalars, means, types, np.linalg.solve(system[:, :, :p], system[:, :, p:])[:, :, 0], None)

    each = [F.sum(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(n_s)]
    cells = coded.groupBy("suburb_bucket", "fold", "type").agg(F.count("*").alias("n"), F.sum("y").alias("y"), *each)
    cells = cut(cells.select("suburb_bucket", "fold", "type", "n", "y", F.array(*[f"x{i}" for i in range(n_s)]).cast("array<double>").alias("x")))
    cells = cells.repartition("suburb_bucket").sortWithinPartitions("suburb_bucket")

    def suburbs(batches):
        """Name, sums of (1, scalars, type) and of rents by model of each suburb."""
        name, a, r = None, None, None
        for batch in batches:
            names, fold, kind, n, y = (batch.column(i).to_pylist() for i in range(5))
            x = batch.column(5).flatten().to_numpy().reshape(len(names), n_s)
            for i, own in enumerate(names):
                if a is None or own != name:
                    if a is not None:
                        yield name, used @ a, used @ r
                    name, a, r = own, np.zeros((n_folds, p)), np.zeros(n_folds)
                a[fold[i], 0] += n[i]
                a[fold[i], 1 : 1 + n_s] += x[i] - n[i] * means[1:]
                a[fold[i], 1 + n_s + kind[i]] += n[i]
                r[fold[i]] += y[i] - n[i] * means[0]
        if a is not None:
            yield name, used @ a, used @ r

    def eliminated(batches):
        total = np.zeros((n_models, p, p + 1))
        for _, a, r in suburbs(batches):
            for m in range(n_models):
                total[m] += np.outer(a[m], np.append(a[m], r[m])) / (a[m, 0] + alpha)
        return total

    system -= _added(cells, eliminated, (n_models, p, p + 1))
    core = np.linalg.solve(system[:, :, :p], system[:, :, p:])[:, :, 0]

    def weights(batches):
        out = [(name, (r - (a * core).sum(axis=1)) / (a[:, 0] + alpha)) for name, a, r in suburbs(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([w.tolist() for _, w in out], pa.list_(pa.float64()))], ["suburb_bucket", "_s"])

    return Model(scalars, means, types, core, cut(cells.mapInArrow(weights, "suburb_bucket string, _s array<double>")))


def predictions(columns: DataFrame, model: Model, x: Column) -> DataFrame:
    """``columns`` with ``_predicted``: for each model what it says of the row, whose scalars ``x`` holds."""
    n_s = len(model.scalars)

    def vector(values) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    centred = F.zip_with(x, vector(model.means[1:]), lambda a, b: a - b) if n_s else F.array().cast("array<double>")
    spread = F.array(*[F.struct(F.lit(float(c[0] + model.means[0])).alias("b"), (vector(c[1 : 1 + n_s]) if n_s else F.array().cast("array<double>")).alias("w")) for c in model.core])
    # the centred scalars are bound to a variable, so that they are made once for all models
    each = lambda s: F.transform(spread, lambda m: m["b"] + F.aggregate(F.zip_with(s, m["w"], lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v))
    out = columns.withColumn("_linear", F.get(F.transform(F.array(centred), each), F.lit(0)))
    if model.suburbs is None:
        return out.withColumnRenamed("_linear", "_predicted")
    rows = [(t, [float(c[1 + n_s + i]) for c in model.core]) for i, t in enumerate(model.types)]
    known = columns.sparkSession.createDataFrame(rows, "property_label string, _t array<double>")
    out = out.join(F.broadcast(known), "property_label", "left").join(send_if_small(model.suburbs), "suburb_bucket", "left")
    zero = vector([0.0] * len(model.core))
    both = F.zip_with(F.coalesce("_t", zero), F.coalesce("_s", zero), lambda a, b: a + b)
    return out.withColumn("_predicted", F.zip_with("_linear", both, lambda a, b: a + b)).drop("_linear", "_t", "_s")


def gradients(columns: DataFrame, model: Model, x: Column, fold: Column, used: np.ndarray, alpha: float, target: str) -> DataFrame:
    """``model``, ``feature`` and ``gradient``: the derivative of the penalized squared error of each model by each weight, over the number
    of rows it sees, from the rows and their predictions alone. Zero says that the weights are the ridge's."""
    n_models = used.shape[0]
    seen = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in column]) for column in used.T]), fold)
    error = F.transform(F.zip_with(F.col("_predicted"), seen, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda v: (v["a"] - F.col(target)) * v["b"])
    rows = predictions(columns.withColumn("_x", x), model, F.col("_x")).withColumn("_error", error).withColumn("_seen", seen)
    rows = cut(rows.select("_x", "_error", "_seen", *(["property_label", "suburb_bucket"] if model.suburbs is not None else [])))
    numbers = range(n_models)
    weights = model.core

    def long(table: DataFrame, name: Column) -> DataFrame:
        return table.select(F.posexplode(F.array(*[F.col(f"g{m}") for m in numbers])).alias("model", "gradient"), name.alias("feature"))

    seen_rows = rows.agg(*[F.sum(F.get("_seen", F.lit(m))).alias(f"n{m}") for m in numbers]).first()
    sums = [[F.sum(F.get("_error", F.lit(m)) * (F.get("_x", F.lit(j - 1)) if j else F.lit(1.0))) for j in range(1 + len(model.scalars))] for m in numbers]
    scalar = rows.agg(*[s.alias(f"g{m}_{j}") for m in numbers for j, s in enumerate(sums[m])])
    named = [(j, name) for j, name in enumerate(["intercept", *model.scalars])]
    out = None
    for j, name in named:
        own = scalar.select(*[(F.col(f"g{m}_{j}") + (alpha * float(weights[m, j]) if j else 0.0)).alias(f"g{m}") for m in numbers])
        part = long(own, F.lit(name))
        out = part if out is None else out.unionByName(part)
    if model.suburbs is not None:
        totals = [F.sum(F.get("_error", F.lit(m))).alias(f"g{m}") for m in numbers]
        places = {t: i for i, t in enumerate(model.types)}
        table = columns.sparkSession.createDataFrame([(t, [float(w[1 + len(model.scalars) + i]) for w in weights]) for t, i in places.items()], "property_label string, _w array<double>")
        for label, own in (("property_label", table), ("suburb_bucket", model.suburbs.withColumnRenamed("_s", "_w"))):
            summed = rows.groupBy(label).agg(*totals).join(own, label, "left")
            summed = summed.select(label, *[(F.col(f"g{m}") + alpha * F.coalesce(F.get("_w", F.lit(m)), F.lit(0.0))).alias(f"g{m}") for m in numbers])
            out = out.unionByName(long(summed, F.concat(F.lit(f"{label}:"), F.col(label))))
    count = F.get(F.array(*[F.lit(float(seen_rows[f"n{m}"])) for m in numbers]), F.col("model"))
    return out.select("model", "feature", (F.col("gradient") / count).alias("gradient"))
