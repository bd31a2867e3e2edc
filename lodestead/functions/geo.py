"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL for the distance in km on a sphere between two positions given as SQL
    expressions; null as soon as any coordinate is null."""
    chord = (
        f"(pow(sin(radians({lat2} - ({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - ({lon1})) / 2), 2))"
    )
    return f"({EARTH_RADIUS_KM}D * 2 * atan2(sqrt({chord}), sqrt(greatest(1 - {chord}, 0D))))"


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    return F.expr(haversine_sql(lat1, lon1, lat2, lon2))
