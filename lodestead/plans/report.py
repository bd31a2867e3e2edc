"""Stored listings to decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestead.operators import decision, price_model, score
from lodestead.sources.preferences import Preferences, people


def build_report(
    listings: DataFrame,
    ratings: DataFrame,
    preferences: list[Preferences],
    features: price_model.Features = price_model.ALL_FEATURES,
) -> DataFrame:
    """One row per listing, most pressing first: each person's filters, score
    and rating, the combined score, the suggested action and, last, the price
    model's view."""
    names = people(preferences)
    valued = price_model.with_price_signal(listings, features)
    scored = score.score_wide(valued, preferences, population=listings)
    return decision.in_report_order(decision.decision_report(decision.with_ratings(scored, ratings, names), names))
