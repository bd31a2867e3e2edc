"""Ratings, suggested actions and the decision report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.functions.numbers import round_even
from lodestead.functions.text import strip
from lodestead.operators.enrich import nearest_rail_walk
from lodestead.operators.score import harmonic_mean


def ratings_wide(ratings: DataFrame, names: list[str]) -> DataFrame:
    """One row per listing with ``<p>_rating`` and ``<p>_comment``: each person's
    latest rating. Latest and pivot are one grouping, so one shuffle."""
    order = F.struct(*[c for c in ("rated_at", "seq") if c in ratings.columns])
    entry = F.struct("score", "comment")
    latest = ratings.where(F.col("person").isin(names)).groupBy("listing_id").agg(
        *[F.max_by(entry, F.when(F.col("person") == p, order)).alias(p) for p in names]
    )
    return latest.select(
        "listing_id",
        *[c for p in names for c in (F.col(f"{p}.score").alias(f"{p}_rating"), F.col(f"{p}.comment").alias(f"{p}_comment"))],
    )


def with_ratings(listings: DataFrame, ratings: DataFrame, names: list[str]) -> DataFrame:
    return listings.join(ratings_wide(ratings, names), "listing_id", "left") if names else listings


def rating_spread(ratings: DataFrame, names: list[str]) -> DataFrame:
    """Agreement per rated listing, out of one row per listing and person."""
    n = F.count(F.col("score"))
    return ratings.where(F.col("person").isin(names)).groupBy("listing_id").agg(
        (F.max("score") - F.min("score")).alias("spread"),
        (F.min("score") >= cat.RATING_GOOD).alias("all_good"),
        (F.max("score") < cat.RATING_LOW).alias("all_low"),
        (n < len(names)).alias("any_missing"),
    )


def suggested_action(names: list[str]) -> Column:
    """What to do next; the first rule that applies wins. Expects ``status``,
    ``<p>_hard_filter_pass`` and ``<p>_rating`` columns."""
    decided = F.coalesce(strip(F.col("status")) != "", F.lit(False))
    action = F.when(decided, F.col("status"))
    if not names:
        return action.otherwise(F.lit("awaiting rating"))
    failing = F.array_join(
        F.array(*[F.when(~F.coalesce(F.col(f"{p}_hard_filter_pass"), F.lit(True)), F.lit(p)) for p in names]), ", "
    )
    ratings = [F.col(f"{p}_rating") for p in names]
    missing = F.lit(False)
    for r in ratings:
        missing = missing | r.isNull() | F.isnan(r)
    lowest, highest = (F.array_min(F.array(*ratings)), F.array_max(F.array(*ratings)))
    return (
        action.when(failing != "", F.concat(F.lit("skip -- hard filter failed ("), failing, F.lit(")")))
        .when(missing, F.lit("awaiting rating"))
        .when(highest - lowest >= cat.RATING_DIVERGE, F.lit("discuss -- scores diverge"))
        .when(lowest >= cat.RATING_GOOD, F.lit("worth inspecting"))
        .when(highest < cat.RATING_LOW, F.lit("skip -- low rating"))
        .otherwise(F.lit("maybe"))
    )


def report_columns(names: list[str]) -> list[str]:
    """Fixed order. The price model's view comes after every person's own, so
    that it does not colour a first impression."""
    head = [
        "listing_id", "address", "suburb", "url", "weekly_rent_aud", "bedrooms", "lease_term_months",
        "available_from", "commute_transit_minutes", "nearest_train_station_walk_minutes",
        "nearest_rail_walk_minutes", "status", "suggested_action", "combined_fit_score",
    ]
    per_person = [f"{p}_{f}" for p in names for f in ("hard_filter_pass", "fit_score", "rating", "comment")]
    return [*head, *per_person, "predicted_weekly_rent", "pct_over_or_under"]


def decision_report(scored: DataFrame, names: list[str]) -> DataFrame:
    """Report rows out of listings that carry scores, ratings and price signal."""
    ready = nearest_rail_walk(scored).withColumns(
        {
            "suggested_action": suggested_action(names),
            "combined_fit_score": harmonic_mean([F.col(f"{p}_fit_score") for p in names]),
        }
    )
    rounded = (
        "commute_transit_minutes", "nearest_train_station_walk_minutes", "nearest_rail_walk_minutes", "predicted_weekly_rent",
    )
    return ready.withColumns({c: round_even(F.col(c), 2) for c in rounded}).select(*report_columns(names))


def action_rank(action: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in cat.ACTION_ORDER.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, action), F.lit(len(cat.ACTION_ORDER)))


def in_report_order(report: DataFrame) -> DataFrame:
    """Most pressing action first; the id settles ties, and also spreads one
    very common action over many sort tasks."""
    return report.orderBy(action_rank(F.col("suggested_action")), "listing_id")
