"""Listing, rating and edit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestead import catalog as cat


def conform(df: DataFrame, schema: T.StructType = cat.LISTING_SCHEMA, keep_extra: bool = True) -> DataFrame:
    """Add the catalogue columns the table lacks as nulls and put the catalogue
    first. Columns outside it are kept as they are, never dropped or altered."""
    have = dict(df.dtypes)
    known = [
        f"`{f.name}`" if have.get(f.name) == kind else f"CAST({f'`{f.name}`' if f.name in have else 'NULL'} AS {kind}) AS `{f.name}`"
        for f, kind in ((f, f.dataType.simpleString()) for f in schema.fields)
    ]
    extra = [f"`{c}`" for c in have if c not in schema.fieldNames()] if keep_extra else []
    return df.selectExpr(*known, *extra)


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out over all cores when it has fewer splits than there are
    cores, for steps that cost far more than moving the rows. Scans of any size
    have splits enough and are left alone. Only for plain scans: asking a plan
    with joins for its partitions would run it."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Stored listings; files written under an older catalogue are merged in."""
    return conform(spark.read.option("mergeSchema", True).parquet(path))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(cat.RATING_SCHEMA).parquet(path)


def read_edits(spark: SparkSession, path: str | None) -> DataFrame | None:
    """One edit sheet as text cells. ``None`` stands for a sheet that is not
    there, which callers must tell apart from a sheet without rows."""
    if path is None:
        return None
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    cells = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    # The row's place in the drop, so that "the later row wins" has a meaning: files by
    # name, rows as they stand. A multi-line file is read in one piece, so ids are
    # consecutive in it, but Spark reads larger files first.
    placed = cells.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    files = sorted(placed.groupBy("_file").agg(F.min("_id").alias("first"), F.count("*").alias("n")).collect())
    before, at = [], 0
    for name, first, n in files:
        before.append((name, at - first))
        at += n
    if not before:
        return cells.withColumn("row", F.lit(0).cast("long"))
    moves = F.broadcast(spark.createDataFrame(before, "_file string, _move long"))
    return placed.join(moves, "_file").withColumn("row", F.col("_id") + F.col("_move")).drop("_file", "_id", "_move")
