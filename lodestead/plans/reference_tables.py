"""Builds of the reference points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.checkpoints import cut
from lodestead.operators.stations import build_stations
from lodestead.plans.workspace import Workspace
from lodestead.sinks.tables import current_path, drop_partition, overwrite_partitions, replace_categories
from lodestead.sources import points as src


def refresh_stations(workspace: Workspace, feed_folder: str) -> DataFrame:
    """Stations of a transit feed into the point table. All station categories
    are replaced: the feed is the whole truth about them."""
    feed = src.read_feed(workspace.spark, feed_folder)
    fresh = src.station_points(build_stations(feed))
    stations = list(cat.MODE_CATEGORY.values())
    return _replace(workspace, fresh, stations)


def refresh_places(workspace: Workspace, answers: dict[str, str]) -> DataFrame:
    """Landed map answers (category to path) into the point table. Categories
    without an answer this time keep what they had; an empty answer empties its
    category."""
    fresh = None
    for category, path in answers.items():
        rows = src.element_points(src.read_elements(workspace.spark, path, category))
        fresh = rows if fresh is None else fresh.unionByName(rows)
    return _replace(workspace, fresh, list(answers)) if fresh is not None else workspace.read("points")


def _replace(workspace: Workspace, fresh: DataFrame, categories: list[str]) -> DataFrame:
    """The categories' rows anew, each in a folder of its own; the files of other categories are left alone."""
    folder = current_path(workspace.spark, workspace.path("points"))
    rows = fresh if folder is not None else replace_categories(workspace.read("points"), fresh, categories)
    rows = cut(rows.where(F.col("category").isin(categories)).select("category", "name", "lat", "lon"))
    ordered = rows.repartitionByRange("category", "name", "lat", "lon").sortWithinPartitions("category", "name", "lat", "lon")
    if folder is None:
        return workspace.write("points", ordered, ["category"])
    filled = {r[0] for r in rows.select("category").distinct().collect()}
    if filled:
        overwrite_partitions(ordered, folder, ["category"])
    for category in categories:
        if category not in filled:
            drop_partition(workspace.spark, folder, "category", category)
    return workspace.read("points")
