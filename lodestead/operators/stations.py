"""Station points from a transit feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.functions.text import blank_to_null
from lodestead.sources.points import parsed_stops


def rail_routes(routes: DataFrame) -> DataFrame:
    """Routes of the wanted modes; all others (buses above all) are left out."""
    modes = F.create_map(*[F.lit(x) for pair in cat.ROUTE_TYPE_MODE.items() for x in pair])
    return routes.where(F.col("route_type").isin(list(cat.ROUTE_TYPE_MODE))).select(
        "route_id", modes[F.col("route_type")].alias("mode")
    )


def stop_modes(routes: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Distinct ``(stop_id, mode)``. The calls table is by far the largest, so
    it meets a trip list already cut down to rail and is folded to stops before
    anything of it is shuffled further."""
    rail_trips = trips.select("trip_id", "route_id").join(rail_routes(routes), "route_id").select("trip_id", "mode")
    return stop_times.select("trip_id", "stop_id").join(rail_trips, "trip_id").select("stop_id", "mode").distinct()


def stations(modes: DataFrame, stops: DataFrame) -> DataFrame:
    """One row ``(station_id, name, lat, lon, mode)`` per station and mode.

    A stop stands for its parent when the feed has that parent. Coordinates
    come whole from the row that was chosen; only the name may fall back, from
    the chosen row to the stop to its id."""
    typed = parsed_stops(stops)
    row = F.struct("stop_id", "stop_name", "stop_lat", "stop_lon")
    parents = typed.select(F.col("stop_id").alias("parent_id"), row.alias("parent"))
    own = modes.join(typed, "stop_id").select(
        "mode", "stop_id", "stop_name", blank_to_null(F.col("parent_station")).alias("parent_id"), row.alias("own")
    )
    chosen = own.join(parents, "parent_id", "left").select(
        "mode",
        "stop_id",
        F.coalesce("parent", "own").alias("at"),
        F.coalesce(
            blank_to_null(F.coalesce("parent", "own")["stop_name"]), blank_to_null(F.col("stop_name")), F.col("stop_id")
        ).alias("name"),
    )
    placed = chosen.where(F.col("at.stop_lat").isNotNull() & F.col("at.stop_lon").isNotNull())
    # platforms of a station agree on everything but a fallback name; the last
    # platform by id gives it
    return placed.groupBy(F.col("at.stop_id").alias("station_id"), "mode").agg(
        F.max_by("name", "stop_id").alias("name"),
        F.first("at.stop_lat").alias("lat"),
        F.first("at.stop_lon").alias("lon"),
    ).select("station_id", "name", "lat", "lon", "mode")


def build_stations(feed: dict[str, DataFrame]) -> DataFrame:
    return stations(stop_modes(feed["routes"], feed["trips"], feed["stop_times"]), feed["stops"])


def count_by(points: DataFrame, column: str) -> DataFrame:
    return points.groupBy(column).count().withColumnRenamed("count", "n")
