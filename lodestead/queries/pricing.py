"""Feature matrix and price signal."""

from __future__ import annotations


from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.operators import medians, price_model
from lodestead.queries.registry import query
from lodestead.queries.scoring import FOLDS_SQL, ONE_FEATURE
from lodestead.queries.views import view
from lodestead.sources.tables import conform

def one_row(spark, found):
    """The medians as they were found, without another pass."""
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{c} double" for c in found))


KNOWN = ["bedrooms", "bathrooms", "commute_transit_minutes"]


@query(
    "column_medians",
    """SELECT median(bedrooms) * 1e0 AS bedrooms, median(bathrooms) * 1e0 AS bathrooms, median(commute_transit_minutes) AS commute_transit_minutes,
      median(weekly_rent_aud) AS weekly_rent_aud, CAST(NULL AS DOUBLE) AS floor_size_sqm FROM v_listings""",
)
def column_medians(spark, sf_dir):
    columns = [*KNOWN, "weekly_rent_aud", "floor_size_sqm"]
    listings = view(spark, sf_dir, "v_listings")
    return one_row(spark, medians.exact_medians(listings, columns))


@query(
    "lineitem_medians",
    "SELECT median(l_quantity) AS l_quantity, median(l_extendedprice) AS l_extendedprice, median(l_discount) AS l_discount FROM lineitem",
)
def lineitem_medians(spark, sf_dir):
    from lodestead.queries.views import table

    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    lines = table(spark, sf_dir, "lineitem")
    return one_row(spark, medians.exact_medians(lines, columns))


@query(
    "suburb_buckets",
    "SELECT suburb, count(*) AS n FROM v_listings WHERE weekly_rent_aud IS NOT NULL AND suburb IS NOT NULL GROUP BY suburb HAVING count(*) >= 3",
)
def suburb_buckets(spark, sf_dir):
    return price_model.common_suburbs(view(spark, sf_dir, "v_listings"))


def _matrix_sql() -> str:
    numeric = [
        f"coalesce(CAST({c} AS DOUBLE), (SELECT CAST(median({c}) AS DOUBLE) FROM priced), 0) AS {c}" if c in KNOWN else f"0e0 AS {c}"
        for c in cat.MODEL_NUMERIC_COLUMNS
    ]
    flags = [f"1 AS {c}_missing" for c in cat.MODEL_FLAGGED_COLUMNS]
    known = {"air_conditioning", "pet_friendly", "pool"}
    amenities = [f"coalesce({c}, 0) AS {c}" if c in known else f"0 AS {c}" for c in cat.AMENITY_COLUMNS]
    return f"""WITH priced AS (SELECT * FROM v_listings WHERE weekly_rent_aud IS NOT NULL),
    common AS (SELECT suburb FROM priced WHERE suburb IS NOT NULL GROUP BY suburb HAVING count(*) >= 3)
    SELECT listing_id, coalesce(property_type, 'unknown') AS property_label, coalesce(c.suburb, 'other') AS suburb_bucket,
      {', '.join([*numeric, *flags, *amenities])}, weekly_rent_aud
    FROM priced p LEFT JOIN common c ON p.suburb = c.suburb"""


@query("feature_matrix_scalar", _matrix_sql())
def feature_matrix_scalar(spark, sf_dir):
    return price_model.feature_matrix(conform(view(spark, sf_dir, "v_listings")))


SIGNAL_COLUMNS = "round(predicted_weekly_rent, 2) AS predicted_weekly_rent, round(weekly_rent_aud - predicted_weekly_rent, 2) + 0e0 AS residual"


def _rounded(signal):
    return signal.select(
        "listing_id",
        F.round("predicted_weekly_rent", 2).alias("predicted_weekly_rent"),
        (F.round("residual", 2) + F.lit(0.0)).alias("residual"),
    )


@query("value_signal_folds", f"WITH {FOLDS_SQL} SELECT listing_id, {SIGNAL_COLUMNS} FROM signal ORDER BY residual DESC, listing_id")
def value_signal_folds(spark, sf_dir):
    """Out-of-fold ridge on one feature, whose closed form SQL can say."""
    return _rounded(price_model.predict_value(conform(view(spark, sf_dir, "v_listings")), features=ONE_FEATURE))


IN_SAMPLE_SQL = """model AS (
  SELECT avg(y) AS my, avg(x) AS mx, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + 1) AS w
  FROM (SELECT weekly_rent_aud AS y, CAST(bathrooms AS DOUBLE) AS x FROM v_listings WHERE weekly_rent_aud IS NOT NULL)
), signal AS (
  SELECT listing_id, weekly_rent_aud, my + w * (bathrooms - mx) AS predicted_weekly_rent FROM v_listings, model WHERE weekly_rent_aud IS NOT NULL
)"""


@query("value_signal_in_sample", f"WITH {IN_SAMPLE_SQL} SELECT listing_id, {SIGNAL_COLUMNS} FROM signal")
def value_signal_in_sample(spark, sf_dir):
    """The fallback for tables too small for folds, forced."""
    listings = conform(view(spark, sf_dir, "v_listings"))
    return _rounded(price_model.predict_value(listings, features=ONE_FEATURE, min_rows=10**12))


@query(
    "model_metrics",
    f"""WITH {FOLDS_SQL} SELECT count(*) AS n, round(avg(abs(weekly_rent_aud - predicted_weekly_rent)), 4) AS mae,
      round(1 - sum(pow(weekly_rent_aud - predicted_weekly_rent, 2)) / (var_pop(weekly_rent_aud) * count(*)), 4) + 0e0 AS r2 FROM signal""",
)
def model_metrics(spark, sf_dir):
    signal = price_model.with_price_signal(conform(view(spark, sf_dir, "v_listings")), features=ONE_FEATURE)
    found = price_model.model_metrics(signal)
    return found.select("n", F.round("mae", 4).alias("mae"), (F.round("r2", 4) + F.lit(0.0)).alias("r2"))


@query("value_signal_full")
def value_signal_full(spark, sf_dir):
    """Out-of-fold ridge on every feature; checked against a closed form in the tests."""
    return price_model.predict_value(conform(view(spark, sf_dir, "v_listings", heavy=("part",))))


FEATURES_SQL = ", ".join(f"('{c}')" for c in ["intercept", *price_model.ALL_FEATURES.scalar_columns])


@query(
    "ridge_gradient_folds",
    f"""WITH priced AS (SELECT * FROM v_listings WHERE weekly_rent_aud IS NOT NULL),
    common AS (SELECT suburb FROM priced WHERE suburb IS NOT NULL GROUP BY suburb HAVING count(*) >= 3),
    features AS (
      SELECT * FROM (VALUES {FEATURES_SQL}) AS v(feature)
      UNION ALL SELECT DISTINCT concat('property_label:', coalesce(property_type, 'unknown')) FROM priced
      UNION ALL SELECT DISTINCT concat('suburb_bucket:', coalesce(c.suburb, 'other')) FROM priced p LEFT JOIN common c ON p.suburb = c.suburb)
    SELECT CAST(model AS INT) AS model, feature, 0e0 AS gradient FROM features, range(5) AS m(model)""",
)
def ridge_gradient_folds(spark, sf_dir):
    """What is left of the derivative of each fold's penalized error on every feature: nothing."""
    listings = conform(view(spark, sf_dir, "v_listings"))
    columns, model, used = price_model.ridge_models(listings, price_model.ALL_FEATURES, cat.FOLDS, in_sample=False)
    found = price_model.fold_ridge.gradients(
        price_model.priced(columns), model, price_model._scalars(price_model.ALL_FEATURES), price_model.fold_of(F.col("listing_id")), used, 1.0, cat.TARGET_COLUMN
    )
    return found.select("model", "feature", (F.round("gradient", 6) + F.lit(0.0)).alias("gradient"))
