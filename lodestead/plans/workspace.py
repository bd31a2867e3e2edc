"""Where the jobs keep their tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.checkpoints import cut
from lodestead.operators.merge import bucket_of
from lodestead.sinks.tables import current_path, overwrite_partitions, write_version
from lodestead.sources import preferences as prefs
from lodestead.sources.tables import conform

LEDGER_SCHEMA = "source_file string, listing_id string"
RUN_SCHEMA = "at timestamp, job string, processed long, skipped long, stored long, buckets int"
COVERAGE_SCHEMA = "at timestamp, field string, missing long, total long"
ISSUE_SCHEMA = "subject string, column_name string, raw string, reason string, action string"

SCHEMAS = {
    "listings": cat.LISTING_SCHEMA,
    "ratings": cat.RATING_SCHEMA,
    "overrides": cat.OVERRIDE_SCHEMA,
    "snapshot": cat.SNAPSHOT_SCHEMA,
    "geo_lookup": cat.GEO_LOOKUP_SCHEMA,
    "points": cat.POINT_SCHEMA,
    "ledger": LEDGER_SCHEMA,
    "people": "person string",
    "hard_filters": prefs.FILTER_SCHEMA,
    "weights": prefs.WEIGHT_SCHEMA,
    "preferred_suburbs": prefs.SUBURB_SCHEMA,
    "issues": ISSUE_SCHEMA,
    "run_log": RUN_SCHEMA,
    "coverage": COVERAGE_SCHEMA,
}
# Tables kept in buckets of this column, so that a batch reads and writes the buckets of its own keys only.
BUCKETED = {"listings": "listing_id"}
_BUCKET = re.compile(r"bucket_of_(\d+)$")


@dataclass(frozen=True)
class Workspace:
    """A folder of versioned tables. Reading takes the newest complete version
    and an unwritten table is empty; writing a table never touches what is being read.
    ``revise`` replaces single buckets of a bucketed table inside its newest version.
    ``buckets`` is what a new table gets; a table keeps the number that its column is named by."""

    spark: SparkSession
    root: str
    buckets: int = 64

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        path = current_path(self.spark, self.path(name))
        schema = SCHEMAS[name]
        if path is None:
            return self.spark.createDataFrame([], schema)
        if name in BUCKETED:
            # columns a newer catalogue has added read as null
            return conform(self.spark.read.parquet(path))
        return self.spark.read.schema(schema).parquet(path)

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        if name in BUCKETED:
            bucket = f"bucket_of_{self.buckets}"
            df, partition_by = self._in_buckets(df, name, bucket), [bucket]
        write_version(df, self.path(name), partition_by)
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """More rows for a table's newest version."""
        path = current_path(self.spark, self.path(name))
        if path is None:
            return self.write(name, df)
        df.write.mode("append").parquet(path)
        return self.read(name)

    def revise(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """``change`` applied to the rows of the buckets that ``keys`` (the table's key column) fall into; other buckets
        are neither read nor written. Applying it twice must give what once gives. Returns how many buckets were touched."""
        path, key = current_path(self.spark, self.path(name)), BUCKETED[name]
        columns = self.spark.read.parquet(path).columns if path else []
        bucket = next((c for c in columns if _BUCKET.match(c)), None)
        if bucket is None:  # nothing there yet, or a table from before buckets
            self.write(name, cut(change(self.read(name))))
            return self.buckets
        n = int(_BUCKET.match(bucket).group(1))
        touched = sorted(r[0] for r in keys.select(bucket_of(F.col(key), n)).distinct().collect())
        if touched:
            rows = conform(self.spark.read.parquet(path).where(F.col(bucket).isin(touched)))
            overwrite_partitions(self._in_buckets(cut(change(rows)), name, bucket), path, [bucket])
        return len(touched)

    def _in_buckets(self, df: DataFrame, name: str, bucket: str) -> DataFrame:
        n = int(_BUCKET.match(bucket).group(1))
        return df.withColumn(bucket, bucket_of(F.col(BUCKETED[name]), n)).hint("rebalance", bucket)
