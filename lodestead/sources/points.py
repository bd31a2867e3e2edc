"""Reference points: station and place files, map elements, transit feeds."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestead import catalog as cat
from lodestead.functions.numbers import to_number
from lodestead.functions.text import blank_to_null

FEED_COLUMNS = {
    "routes": ["route_id", "route_type"],
    "trips": ["trip_id", "route_id"],
    "stop_times": ["trip_id", "stop_id"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon", "parent_station"],
}
ELEMENT_SCHEMA = T.StructType().add(
    "elements",
    T.ArrayType(
        T.StructType()
        .add("type", "string")
        .add("id", "long")
        .add("lat", "double")
        .add("lon", "double")
        .add("center", T.StructType().add("lat", "double").add("lon", "double"))
        .add("tags", T.MapType(T.StringType(), T.StringType()))
    ),
)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    # Header-driven, every column a string; the reader copes with BOM and CRLF.
    return spark.read.csv(path, header=True, inferSchema=False)


def read_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables of an unpacked transit feed, columns as strings. Fails
    at once, naming every file that is missing."""
    paths = {table: os.path.join(folder, f"{table}.txt") for table in FEED_COLUMNS}
    missing = sorted(f"{t}.txt" for t, p in paths.items() if not _exists(spark, p))
    if missing:
        raise FileNotFoundError(f"transit feed {folder} lacks {', '.join(missing)}")
    feed = {}
    for table, columns in FEED_COLUMNS.items():
        raw = _csv(spark, paths[table])
        # parent_station is optional in a feed
        feed[table] = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns])
    return feed


def station_points(stations: DataFrame) -> DataFrame:
    """Station rows ``(name, lat, lon, mode)`` as points; other modes are left out."""
    mode_category = F.create_map(*[F.lit(x) for pair in cat.MODE_CATEGORY.items() for x in pair])
    return stations.where(F.col("mode").isin(list(cat.MODE_CATEGORY))).select(
        mode_category[F.col("mode")].alias("category"),
        "name",
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
    )


def place_points(places: DataFrame) -> DataFrame:
    """Place rows ``(name, lat, lon, category)`` as points of known categories."""
    return places.where(F.col("category").isin(cat.POI_CATEGORIES)).select(
        "category", "name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")
    )


def union_points(stations: DataFrame, places: DataFrame) -> DataFrame:
    return station_points(stations).unionByName(place_points(places))


def read_points(spark: SparkSession, stations_path: str, places_path: str) -> DataFrame:
    """Both point files together; a file that is not there adds no rows."""
    points = spark.createDataFrame([], cat.POINT_SCHEMA)
    for path, shape in ((stations_path, station_points), (places_path, place_points)):
        if _exists(spark, path):
            points = points.unionByName(shape(_csv(spark, path)))
    return points


def read_elements(spark: SparkSession, path: str, category: str) -> DataFrame:
    """Landed map answers of one category, one row per element."""
    answers = spark.read.schema(ELEMENT_SCHEMA).json(path, multiLine=True)
    return answers.select(F.inline("elements")).withColumn("category", F.lit(category))


def element_points(elements: DataFrame) -> DataFrame:
    """Map elements as points: a node by its own position, anything else by its
    centre. Elements without a position are left out, nameless ones get a
    made-up name."""
    is_node = F.col("type") == "node"
    made_up = F.format_string("Unnamed %s (%s/%d)", F.col("category"), F.col("type"), F.col("id"))
    return elements.select(
        "category",
        F.coalesce(blank_to_null(F.col("tags")["name"]), made_up).alias("name"),
        F.when(is_node, F.col("lat")).otherwise(F.col("center.lat")).alias("lat"),
        F.when(is_node, F.col("lon")).otherwise(F.col("center.lon")).alias("lon"),
    ).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def parsed_stops(stops: DataFrame) -> DataFrame:
    """Feed stops with numeric coordinates (null when they do not parse)."""
    return stops.withColumns({"stop_lat": to_number(F.col("stop_lat")), "stop_lon": to_number(F.col("stop_lon"))})
