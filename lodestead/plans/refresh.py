"""The whole cycle, in the one order that loses nothing: edits are pulled in
before anything that people edited is overwritten."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.checkpoints import cut
from lodestead.operators import merge
from lodestead.operators import reconcile as rec
from lodestead.operators.people import unknown_columns
from lodestead.plans.ingest import ingest
from lodestead.plans.report import build_report
from lodestead.plans.workspace import Workspace
from lodestead.sinks.tables import publish
from lodestead.sources.preferences import load_preferences, people


@dataclass(frozen=True)
class Edits:
    """The four edit sheets; None for one that could not be read."""

    ratings: DataFrame | None = None
    details: DataFrame | None = None
    weights: DataFrame | None = None
    filters: DataFrame | None = None


def stored_preferences(workspace: Workspace):
    return load_preferences(*(workspace.read(t) for t in ("hard_filters", "weights", "preferred_suburbs", "people")))


def pull_ratings(workspace: Workspace, sheet: DataFrame, names: list[str], now: Column) -> None:
    statuses = rec.status_edits(sheet)
    ratings = rec.rating_edits(sheet, names, now)
    workspace.revise("listings", statuses, lambda rows: merge.apply_status(rows, statuses))
    workspace.write("ratings", rec.replace_rows(workspace.read("ratings"), ratings, ["listing_id", "person"]))


def pull_details(workspace: Workspace, sheet: DataFrame, now: Column) -> DataFrame:
    """Corrections into the override store and their own listings (which carry earlier
    ones already); returns the cells nobody could read."""
    corrections = cut(rec.detail_corrections(sheet, workspace.read("snapshot")).withColumn("set_at", now))
    keys = ["listing_id", "column_name"]
    workspace.write("overrides", rec.replace_rows(workspace.read("overrides"), corrections, keys))
    workspace.revise("listings", corrections, lambda rows: merge.apply_overrides(rows, corrections))
    return rec.detail_issues(sheet)


def pull_preferences(workspace: Workspace, edits: Edits, names: list[str]) -> DataFrame | None:
    """Preferences of the named people rebuilt wholesale, sheet by sheet; those of
    other people stay. A sheet that could not be read leaves its preferences as
    they are."""

    def replace(table: str, fresh: DataFrame) -> None:
        others = workspace.read(table).where(~F.col("person").isin(names))
        workspace.write(table, others.unionByName(fresh, allowMissingColumns=True))

    issues = None
    if edits.weights is not None:
        replace("weights", rec.weight_edits(edits.weights, names).select("person", "feature", "weight", F.col("pos").cast("int")))
        replace("preferred_suburbs", rec.suburb_edits(edits.weights, names))
        issues = rec.weight_issues(edits.weights, names)
    if edits.filters is not None:
        replace("hard_filters", rec.filter_edits(edits.filters, names))
    return issues


def unknown_filters(workspace: Workspace) -> DataFrame:
    """Filters on columns that the listings do not have, as issue rows."""
    unknown = unknown_columns(workspace.read("hard_filters"), workspace.read("listings").columns)
    return unknown.select(
        F.col("person").alias("subject"),
        F.col("column").alias("column_name"),
        F.col("kind").alias("raw"),
        F.lit("unknown column").alias("reason"),
        F.lit("kept").alias("action"),
    )


def pull_edits(workspace: Workspace, edits: Edits, names: list[str] | None = None, now: Column | None = None) -> None:
    known = people(stored_preferences(workspace))
    if names is None:
        names = known
    elif not set(names) <= set(known):
        everyone = sorted({*names, *known})
        workspace.write("people", workspace.spark.createDataFrame([(p,) for p in everyone], "person string"))
    now = F.current_timestamp() if now is None else now
    found = []
    if edits.ratings is not None:
        pull_ratings(workspace, edits.ratings, names, now)
    if edits.details is not None:
        found.append(pull_details(workspace, edits.details, now))
    issues = pull_preferences(workspace, edits, names)
    if issues is not None:
        found.append(issues)
    if found:
        found.append(unknown_filters(workspace))
        rejected = found[0]
        for more in found[1:]:
            rejected = rejected.unionByName(more)
        workspace.write("issues", rejected)


def publish_all(workspace: Workspace, out: str) -> DataFrame:
    """Report and detail sheet out, then the snapshot later edits are told from.
    The snapshot comes from the listings that were just shown."""
    preferences = stored_preferences(workspace)
    listings = workspace.read("listings")
    report = build_report(listings, workspace.read("ratings"), preferences)
    publish(report, f"{out}/listings")
    publish(rec.detail_sheet(listings), f"{out}/details")
    workspace.write("snapshot", rec.detail_snapshot(listings))
    return report


def refresh(
    workspace: Workspace,
    pages: DataFrame,
    edits: Edits,
    out: str,
    names: list[str] | None = None,
    **ingest_options,
) -> DataFrame:
    """Pull edits, read new pages, publish. Edits come first, so neither the
    ingest nor the publishing can undo one."""
    pull_edits(workspace, edits, names)
    ingest(workspace, pages, **ingest_options)
    return publish_all(workspace, out)
