"""Incremental ingest: pages to stored listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.checkpoints import cut
from lodestead.operators import enrich, merge, nearest
from lodestead.operators.extract import COVERAGE_FIELDS, extract
from lodestead.plans.workspace import Workspace
from lodestead.sources.pages import file_order
from lodestead.sources.tables import conform


def enriched(
    batch: DataFrame,
    lookup: DataFrame,
    points: DataFrame,
    walks: DataFrame | None = None,
    anchor: tuple[float, float] | None = None,
) -> DataFrame:
    """Geography of a batch: looked-up position and commute, nearest points of
    every category, walks to them, distance to the anchor. What the lookup does
    not know stays null and keeps nobody from being stored."""
    located = enrich.with_geo_lookup(batch, lookup.select("address", "lat", "lon", "driving_minutes", "transit_minutes"))
    placed = nearest.nearest_wide(located, points)
    if walks is not None:
        wide = walks.groupBy("address").agg(
            *[
                F.max(F.when(F.col("category") == c, enrich.duration_minutes(F.col("duration")))).alias(f"nearest_{c}_walk_minutes")
                for c in cat.POI_CATEGORIES
            ]
        )
        placed = enrich.join_known(placed.drop(*[c for c in wide.columns if c != "address"]), wide)
    return nearest.with_anchor_distance(placed, *(anchor or (None, None)))


def folded_batch(parsed: DataFrame, overrides: DataFrame, captured_at: Column | None = None) -> DataFrame:
    """A parsed batch, one row for each listing, under the human corrections of its listings."""
    stamped = conform(parsed).withColumn("date_captured", F.current_timestamp() if captured_at is None else captured_at)
    folded = cut(merge.fold_batch(stamped, "listing_id", file_order(F.col("source_file"))))
    own = overrides.join(merge.send_if_small(folded.select("listing_id")), "listing_id", "left_semi")
    return cut(merge.apply_overrides(folded, own))


def merge_batch(
    stored: DataFrame, parsed: DataFrame, overrides: DataFrame, captured_at: Column | None = None
) -> DataFrame:
    """Fold a parsed batch, put human corrections over it and lay it over the stored
    listings, which carry theirs already."""
    return merge.upsert(stored, merge.send_if_small(folded_batch(parsed, overrides, captured_at)))


def ledger_view(ledger: DataFrame, listings: DataFrame, pages: DataFrame) -> DataFrame:
    """Those of a batch's files that were ever read, with what is known of their listings' positions."""
    names = pages.select("source_file").where(F.col("source_file").isNotNull()).distinct()
    met = ledger.join(merge.send_if_small(names), "source_file", "left_semi")
    positions = listings.select("listing_id", "lat").join(merge.send_if_small(met.select("listing_id").distinct()), "listing_id", "left_semi")
    return met.join(merge.send_if_small(positions), "listing_id", "left").select("source_file", "lat")


def ingest(
    workspace: Workspace,
    pages: DataFrame,
    force: bool = False,
    with_enrichment: bool = True,
    walks: DataFrame | None = None,
    anchor: tuple[float, float] | None = None,
) -> dict[str, int]:
    """Read the pages that are new (all of them with ``force``) into the listing
    table, of which only the buckets of the batch's listings are read and written. Running it again on the
    same pages changes nothing. Returns how many pages were read and how many skipped, by a count of the pages
    as they are parsed and one of the names, and notes both in the run log, and how often each
    required field was missing from them in the coverage table."""
    seen = ledger_view(workspace.read("ledger"), workspace.read("listings"), pages)
    taken, stored = Observation(), Observation()
    todo = merge.skip_ingested(pages, seen, with_enrichment, force)
    # page parsing is the dear step, and its result is looked at several times
    missing = [F.count_if(F.col(f).isNull()).alias(f) for f in COVERAGE_FIELDS]
    parsed = cut(conform(extract(todo)).observe(taken, F.count("*").alias("n"), *missing))
    processed = taken.get["n"]
    skipped = pages.select("source_file").count() - processed
    if processed == 0:
        log_run(workspace, "ingest", processed, skipped, 0, 0)
        return {"processed": processed, "skipped": skipped}
    batch = parsed
    if with_enrichment:
        batch = conform(enriched(parsed, workspace.read("geo_lookup"), workspace.read("points"), walks, anchor))
    fresh = merge.send_if_small(folded_batch(batch, workspace.read("overrides")))
    buckets = workspace.revise("listings", fresh, lambda rows: merge.upsert(rows, fresh).observe(stored, F.count("*").alias("n")))
    files = parsed.select("source_file", "listing_id").where(F.col("source_file").isNotNull()).distinct()
    workspace.append("ledger", files.join(workspace.read("ledger"), "source_file", "left_anti"))
    log_run(workspace, "ingest", processed, skipped, stored.get["n"], buckets)
    found = workspace.spark.createDataFrame([(f, taken.get[f], processed) for f in COVERAGE_FIELDS], "field string, missing long, total long")
    workspace.append("coverage", found.select(F.current_timestamp().alias("at"), "*"))
    return {"processed": processed, "skipped": skipped}


def log_run(workspace: Workspace, job: str, processed: int, skipped: int, stored: int, buckets: int) -> None:
    """One row on a run: pages read and left alone, rows in the buckets it wrote, and how many buckets these were."""
    row = workspace.spark.createDataFrame([(job, processed, skipped, stored, buckets)], "job string, processed long, skipped long, stored long, buckets int")
    workspace.append("run_log", row.select(F.current_timestamp().alias("at"), "*"))
