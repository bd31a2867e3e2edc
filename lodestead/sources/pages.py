"""Saved listing pages as ``(source_file, html, captured_on)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_GLOB = "*.{html,htm}"
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def decode_utf8(content: Column) -> Column:
    """UTF-8 text with undecodable bytes left out."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "")


def _as_pages(files: DataFrame) -> DataFrame:
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        decode_utf8(F.col("content")).alias("html"),
        F.to_date("modificationTime").alias("captured_on"),
    )


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All saved pages of a folder; the file's date stands for the capture date."""
    return _as_pages(spark.read.format("binaryFile").option("pathGlobFilter", PAGE_GLOB).load(folder))


def stream_pages(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """The same pages as a stream that hands out every file once."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", PAGE_GLOB)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _as_pages(reader.load(folder))


def file_order(source_file: Column) -> Column:
    """Sort key of the scan order: all ``.html`` files by name, then ``.htm``."""
    return F.struct((~source_file.endswith(".html")).alias("late"), source_file.alias("name"))
