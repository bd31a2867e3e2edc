"""Writing results. A table that is read while it is rebuilt is written to a
new version folder; readers take the newest complete one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Quotes are doubled, as spreadsheets expect, and empty cells stay empty.
CSV = {"header": "true", "escape": '"', "emptyValue": ""}
_VERSION = re.compile(r"v(\d{8})$")
# Versions of a table that stay: readers that began before the last few writes can finish.
KEPT_VERSIONS = 8


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str, bool]]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        match = _VERSION.match(status.getPath().getName())
        if match:
            done = fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
            found.append((int(match.group(1)), status.getPath().toString(), done))
    return sorted(found)


def current_path(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest complete version; half-written ones do not count."""
    complete = [path for _, path, done in _versions(spark, root) if done]
    return complete[-1] if complete else None


def write_version(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write the whole table as the next version and return its folder."""
    taken = [n for n, _, _ in _versions(df.sparkSession, root)]
    target = f"{root}/v{max(taken, default=0) + 1:08d}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    _forget_old(df.sparkSession, root)
    return target


def overwrite_partitions(df: DataFrame, folder: str, partition_by: list[str]) -> None:
    """Replace, in a table that is there, just the partitions that ``df`` has rows of. ``df`` must not read the table
    any more. A job that dies on the way leaves old or new partitions, so its rows must bear being written again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(folder)


def drop_partition(spark: SparkSession, folder: str, column: str, value: str) -> None:
    """Remove a partition that has no rows any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{column}={value}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _forget_old(spark: SparkSession, root: str) -> None:
    """Remove what is older than the newest ``KEPT_VERSIONS`` complete versions."""
    found = _versions(spark, root)
    complete = [n for n, _, done in found if done]
    if len(complete) <= KEPT_VERSIONS:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for n, folder, _ in found:
        if n < complete[-KEPT_VERSIONS]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def text_columns(df: DataFrame) -> DataFrame:
    """Every column in its export spelling: lists as JSON, the rest as text."""
    return df.select(
        *[
            (F.to_json(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name).cast("string")).alias(
                f.name
            )
            for f in df.schema.fields
        ]
    )


def newest_first(listings: DataFrame) -> DataFrame:
    return listings.orderBy(F.desc("date_captured"), "listing_id")


def export_csv(listings: DataFrame, path: str) -> None:
    """All listings, newest capture first, as CSV with a header."""
    text_columns(newest_first(listings)).write.mode("overwrite").options(**CSV).csv(path)


def publish(report: DataFrame, path: str) -> None:
    """Replace the published report; nulls are shown as empty cells."""
    text_columns(report).na.fill("").write.mode("overwrite").options(**CSV).csv(path)


def sorted_stations(stations: DataFrame) -> DataFrame:
    return stations.select("name", "lat", "lon", "mode").orderBy("name", "lat", "lon", "mode")


def write_stations(stations: DataFrame, path: str) -> None:
    sorted_stations(stations).write.mode("overwrite").options(**CSV).csv(path)


def replace_categories(stored: DataFrame, fresh: DataFrame, refreshed: list[str]) -> DataFrame:
    """Points after a refresh: every refreshed category comes from the fresh
    rows alone, even when it came back empty; the others stay as stored."""
    kept = stored.where(~F.col("category").isin(refreshed)) if refreshed else stored
    return kept.unionByName(fresh.where(F.col("category").isin(refreshed))) if refreshed else kept


def write_points(points: DataFrame, path: str) -> None:
    """Points as one folder per category, sorted inside, so that a category is
    replaced or read alone."""
    (
        points.repartitionByRange("category", "name", "lat", "lon")
        .sortWithinPartitions("category", "name", "lat", "lon")
        .write.mode("overwrite")
        .partitionBy("category")
        .parquet(path)
    )
