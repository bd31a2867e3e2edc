"""Looked-up geography: what an outside job has found out per address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.functions.numbers import duration_minutes

# Listing column <- lookup column.
LOOKUP_COLUMNS = {
    "lat": "lat",
    "lon": "lon",
    "commute_driving_minutes": "driving_minutes",
    "commute_transit_minutes": "transit_minutes",
}


def join_known(listings: DataFrame, found: DataFrame) -> DataFrame:
    """Left join on ``address`` of the listings that have one; the others get nulls."""
    matched = listings.where(F.col("address").isNotNull()).join(found, "address", "left")
    return matched.unionByName(listings.where(F.col("address").isNull()), allowMissingColumns=True)


def with_geo_lookup(listings: DataFrame, lookup: DataFrame) -> DataFrame:
    """Coordinates, commute minutes and any nearest-point columns of the exact
    same address. A listing's own value stays where the lookup has none. Listings
    without an address meet no lookup, so they don't travel to one task."""
    sources = {k: v for k, v in LOOKUP_COLUMNS.items() if v in lookup.columns}
    sources.update({c: c for c in cat.POI_COLUMNS if c in lookup.columns})
    found = lookup.select(F.col("address"), *[F.col(v).alias(f"_{k}") for k, v in sources.items()])
    joined = join_known(listings, found)
    own = set(listings.columns)
    kept = [c for c in listings.columns if c not in sources]
    return joined.select(
        *kept, *[(F.coalesce(f"_{k}", k) if k in own else F.col(f"_{k}")).alias(k) for k in sources]
    )


def lookup_misses(listings: DataFrame, lookup: DataFrame) -> DataFrame:
    """Distinct addresses the lookup does not know yet: the outside job's to-do list."""
    wanted = listings.select("address").where(F.col("address").isNotNull()).distinct()
    return wanted.join(lookup.select("address"), "address", "left_anti")


def with_walk_minutes(nearest: DataFrame, walks: DataFrame) -> DataFrame:
    """Walk minutes onto long nearest rows by exact address and category. Walks
    hold a ``duration`` text such as ``'840s'``; only the one nearest point of
    each category is ever walked to."""
    minutes = walks.select("address", "category", duration_minutes(F.col("duration")).alias("walk_minutes"))
    return nearest.join(minutes, ["address", "category"], "left")


def nearest_rail_walk(listings: DataFrame) -> DataFrame:
    """Shortest walk to any kind of rail; unknown kinds are passed over."""
    walks = [F.col(f"nearest_{c}_walk_minutes") for c in cat.RAIL_CATEGORIES]
    return listings.withColumn("nearest_rail_walk_minutes", F.least(*walks))
