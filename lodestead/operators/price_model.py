"""What a listing's features say its rent should be."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.checkpoints import cut
from lodestead.functions.numbers import round_even, to_number
from lodestead.operators import ridge as fold_ridge
from lodestead.operators.medians import exact_medians

SIGNAL_SCHEMA = "listing_id string, predicted_weekly_rent double, residual double, pct_over_or_under double"
# A suburb list of this size or less is sent to all executors.
BROADCAST_SUBURBS = 1_000_000


@dataclass(frozen=True)
class Features:
    """Which columns the model looks at."""

    numeric: tuple[str, ...] = tuple(cat.MODEL_NUMERIC_COLUMNS)
    flagged: tuple[str, ...] = tuple(cat.MODEL_FLAGGED_COLUMNS)
    amenities: tuple[str, ...] = tuple(cat.AMENITY_COLUMNS)
    categorical: bool = True

    @property
    def scalar_columns(self) -> list[str]:
        return [*self.numeric, *[f"{c}_missing" for c in self.flagged], *self.amenities]


ALL_FEATURES = Features()


def priced(listings: DataFrame) -> DataFrame:
    return listings.where(F.col(cat.TARGET_COLUMN).isNotNull() & ~F.isnan(cat.TARGET_COLUMN))


def common_suburbs(listings: DataFrame, at_least: int = cat.MIN_SUBURB_COUNT) -> DataFrame:
    """Suburbs with enough priced listings to have a column of their own."""
    known = priced(listings).where(F.col("suburb").isNotNull())
    return known.groupBy("suburb").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def _with_suburb_bucket(listings: DataFrame) -> DataFrame:
    common = common_suburbs(listings).select(F.col("suburb").alias("_common"))
    if common.limit(BROADCAST_SUBURBS + 1).count() <= BROADCAST_SUBURBS:
        common = F.broadcast(common)
    return (
        listings.join(common, F.col("suburb") == F.col("_common"), "left")
        .withColumn("suburb_bucket", F.coalesce("_common", F.lit("other")))
        .drop("_common")
    )


def _number(listings: DataFrame, name: str) -> Column:
    kind = listings.schema[name].dataType.typeName()
    value = to_number(F.col(name)) if kind == "string" else F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def feature_columns(listings: DataFrame, features: Features = ALL_FEATURES) -> DataFrame:
    """Every listing with its model features as plain columns prefixed ``x_``,
    plus ``property_label`` and ``suburb_bucket``. Medians and suburb counts are
    those of the priced listings; missing flags are taken before imputing."""
    medians = exact_medians(
        priced(listings).select(*[_number(listings, c).alias(c) for c in features.numeric]), list(features.numeric)
    )
    base = _with_suburb_bucket(listings) if features.categorical else listings
    numeric = {
        f"x_{c}": F.coalesce(_number(listings, c), F.lit(medians[c]).cast("double"), F.lit(0.0)) for c in features.numeric
    }
    flags = {f"x_{c}_missing": _number(listings, c).isNull().cast("int") for c in features.flagged}
    amenities = {f"x_{c}": F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in features.amenities}
    labels = {"property_label": F.coalesce("property_type", F.lit("unknown"))} if features.categorical else {}
    return base.withColumns({**numeric, **flags, **amenities, **labels})


def feature_matrix(listings: DataFrame, features: Features = ALL_FEATURES) -> DataFrame:
    """Priced listings as ``(listing_id, label columns, feature columns, target)``."""
    ready = priced(feature_columns(listings, features))
    labels = ["property_label", "suburb_bucket"] if features.categorical else []
    return ready.select(
        "listing_id", *labels, *[F.col(f"x_{c}").alias(c) for c in features.scalar_columns], cat.TARGET_COLUMN
    )


def _assembled(columns: DataFrame, features: Features) -> DataFrame:
    """Feature vectors: scalars, then one column per type and suburb with none
    left out (the penalty makes that solvable)."""
    inputs = [f"x_{c}" for c in features.scalar_columns]
    stages = []
    if features.categorical:
        labels = ["property_label", "suburb_bucket"]
        stages = [
            StringIndexer(
                inputCols=labels, outputCols=[f"{c}_i" for c in labels], stringOrderType="alphabetAsc", handleInvalid="keep"
            ),
            OneHotEncoder(inputCols=[f"{c}_i" for c in labels], outputCols=[f"{c}_v" for c in labels], dropLast=False),
        ]
        inputs += [f"{c}_v" for c in labels]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Pipeline(stages=stages).fit(priced(columns)).transform(columns)


def fold_of(listing_id: Column, folds: int = cat.FOLDS) -> Column:
    """Fold of a listing by its id alone: the same on every run and for every
    partitioning, and unchanged when other listings come or go."""
    return F.pmod(F.conv(F.substring(F.md5(listing_id), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def ridge(train: DataFrame, n: int, std_population: float, std_sample: float, n_features: int, alpha: float = 1.0):
    """Ridge with an unpenalized intercept and unscaled features, of one set of vectors, by the library. It
    divides its penalty by the label's deviation (and by n), hence the factor. ``with_price_signal`` fits the ridge of
    all folds by one pass instead (``operators.ridge``); this one is what other models are written like."""
    estimator = LinearRegression(
        featuresCol="features", labelCol=cat.TARGET_COLUMN, solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha * std_population / n
    )
    return estimator.fit(train)


def _scalars(features: Features) -> Column:
    return F.array(*[F.col(f"x_{c}").cast("double") for c in features.scalar_columns]).cast("array<double>")


def _with_predictions(listings: DataFrame, predicted: DataFrame, known: Column) -> DataFrame:
    """Listings with the price signal of what ``predicted`` says in its column of that name."""
    kept = [c for c in listings.columns if c != "predicted_weekly_rent"]
    target = F.col(cat.TARGET_COLUMN)
    return predicted.select(*kept, F.when(known, F.col("_signal")).alias("predicted_weekly_rent")).withColumns(
        {
            "residual": target - F.col("predicted_weekly_rent"),
            "pct_over_or_under": round_even(
                F.try_divide(target - F.col("predicted_weekly_rent"), F.col("predicted_weekly_rent")) * 100.0, 1
            ),
        }
    )


def ridge_models(listings: DataFrame, features: Features, folds: int, in_sample: bool, alpha: float = 1.0):
    """The listings' feature columns and the ridge of each fold's outside (of everything, in sample), with
    which folds each model sees."""
    columns = feature_columns(listings, features)
    labels = ["property_label", "suburb_bucket"] if features.categorical else []
    rows = priced(columns).select(fold_of(F.col("listing_id"), folds).alias("fold"), F.col(cat.TARGET_COLUMN).cast("double").alias("y"), _scalars(features).alias("x"), *labels)
    used = np.ones((1, folds)) if in_sample else 1.0 - np.eye(folds)
    return columns, fold_ridge.fit(rows, features.scalar_columns, features.categorical, used, alpha), used


def boosted_trees(train: DataFrame, n: int, std_population: float, std_sample: float, n_features: int, rounds: int = 100):
    """Gradient-boosted trees, for comparison with the ridge."""
    estimator = GBTRegressor(
        featuresCol="features", labelCol=cat.TARGET_COLUMN, maxIter=rounds, stepSize=0.1, maxBins=255,
        minInstancesPerNode=20, seed=0,
    )
    return estimator.fit(train)


def with_price_signal(
    listings: DataFrame,
    features: Features = ALL_FEATURES,
    fit: Callable = ridge,
    min_rows: int = cat.MIN_ROWS_FOR_FOLDS,
    folds: int = cat.FOLDS,
) -> DataFrame:
    """Listings plus ``predicted_weekly_rent``, ``residual`` and
    ``pct_over_or_under``; null where no rent is known. Each prediction comes
    from a model that did not see the listing, unless there are too few priced
    listings for folds. Scoring is done on the row itself, so nothing is joined
    back."""
    fold = fold_of(F.col("listing_id"), folds)
    target = F.col(cat.TARGET_COLUMN)
    known = target.isNotNull() & ~F.isnan(target)
    outside = [F.when(fold != k, target) for k in range(folds)]
    if fit is ridge:
        return _ridge_signal(listings, features, min_rows, folds)
    stats = priced(listings).agg(
        F.count("*").alias("n"), F.stddev_pop(target).alias("pop"), F.stddev_samp(target).alias("samp"),
        *[F.count(y).alias(f"n{k}") for k, y in enumerate(outside)],
        *[F.stddev_pop(y).alias(f"pop{k}") for k, y in enumerate(outside)],
        *[F.stddev_samp(y).alias(f"samp{k}") for k, y in enumerate(outside)],
    ).first()
    if stats["n"] == 0:
        nothing = F.lit(None).cast("double")
        return listings.withColumns({c: nothing for c in ("predicted_weekly_rent", "residual", "pct_over_or_under")})
    vectors = _assembled(feature_columns(listings, features), features)
    training = priced(vectors).select("features", cat.TARGET_COLUMN, fold.alias("fold")).persist()
    width = training.first()["features"].size
    in_sample = stats["n"] < min_rows or min(stats[f"n{k}"] for k in range(folds)) == 0
    if in_sample:
        warnings.warn(f"only {stats['n']} priced listings: predictions are in-sample and optimistic", stacklevel=2)
        models = {0: fit(training, stats["n"], stats["pop"], stats["samp"] or 0.0, width)}
    else:
        models = {
            k: fit(training.where(F.col("fold") != k), stats[f"n{k}"], stats[f"pop{k}"], stats[f"samp{k}"] or 0.0, width)
            for k in range(folds)
        }
    training.unpersist()
    scored = vectors
    for k, model in models.items():
        scored = model.setPredictionCol(f"_p{k}").transform(scored)
    predicted = F.col("_p0") if in_sample else F.get(F.array(*[F.col(f"_p{k}") for k in models]), fold)
    return _with_predictions(listings, scored.withColumn("_signal", predicted), known)


def _ridge_signal(listings: DataFrame, features: Features, min_rows: int, folds: int) -> DataFrame:
    target = F.col(cat.TARGET_COLUMN)
    known = target.isNotNull() & ~F.isnan(target)
    sizes = {r["fold"]: r["n"] for r in priced(listings).groupBy(fold_of(F.col("listing_id"), folds).alias("fold")).agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if n == 0:
        nothing = F.lit(None).cast("double")
        return listings.withColumns({c: nothing for c in ("predicted_weekly_rent", "residual", "pct_over_or_under")})
    in_sample = n < min_rows or any(n == sizes.get(k, 0) for k in range(folds))
    if in_sample:
        warnings.warn(f"only {n} priced listings: predictions are in-sample and optimistic", stacklevel=3)
    columns, model, _ = ridge_models(listings, features, folds, in_sample)
    scored = fold_ridge.predictions(columns, model, _scalars(features))
    place = F.lit(0) if in_sample else fold_of(F.col("listing_id"), folds)
    return _with_predictions(listings, scored.withColumn("_signal", F.get("_predicted", place)), known)


def predict_value(listings: DataFrame, **options) -> DataFrame:
    """The price signal alone, dearest against its prediction first."""
    signal = (
        with_price_signal(listings, **options)
        .where(F.col("predicted_weekly_rent").isNotNull())
        .select("listing_id", "predicted_weekly_rent", "residual", "pct_over_or_under")
    )
    # a sort looks at its rows twice, and each look would predict them again
    return value_order(cut(signal))


def value_order(signal: DataFrame) -> DataFrame:
    return signal.orderBy(F.desc("residual"), "listing_id")


def model_metrics(signal: DataFrame, actual: str = cat.TARGET_COLUMN) -> DataFrame:
    """Mean absolute error and R2 of predictions against known rents."""
    y, p = F.col(actual), F.col("predicted_weekly_rent")
    both = signal.where(y.isNotNull() & p.isNotNull())
    return both.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count("*"))).alias("r2"),
    )


def compare_models(listings: DataFrame, models: dict[str, Callable] | None = None, **options) -> DataFrame:
    """Metrics of several models evaluated the same way, one row each."""
    rows = [
        model_metrics(with_price_signal(listings, fit=fit, **options)).withColumn("model", F.lit(name))
        for name, fit in (models or {"ridge": ridge, "boosted_trees": boosted_trees}).items()
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.select("model", "n", "mae", "r2")
