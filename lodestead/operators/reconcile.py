"""Human edits against the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.functions import cells
from lodestead.functions.numbers import sheet_weight, to_number
from lodestead.functions.text import trimmed_or_null
from lodestead.operators.merge import latest_per_key, send_if_small


def _row_order(edits: DataFrame) -> Column:
    """Place of an edit in its sheet, for "the later row wins"."""
    return F.col("row") if "row" in edits.columns else F.lit(0).cast("long")


def _named(edits: DataFrame) -> DataFrame:
    return edits.withColumn("listing_id", trimmed_or_null(F.col("listing_id"))).where(F.col("listing_id").isNotNull())


# --- ratings and status ------------------------------------------------------


def status_edits(edits: DataFrame) -> DataFrame:
    """``(listing_id, status)`` of every non-blank status cell."""
    rows = _named(edits).select("listing_id", trimmed_or_null(F.col("status")).alias("status"), _row_order(edits).alias("row"))
    return latest_per_key(rows.where(F.col("status").isNotNull()), ["listing_id"], ["row", "status"]).drop("row")


def rating_edits(edits: DataFrame, names: list[str], rated_at: Column | None = None) -> DataFrame:
    """Wide rating cells as long ratings; cells without a readable score are
    left out, blank comments are null."""
    entries = F.array(
        *[
            F.struct(
                F.lit(p).alias("person"),
                cells.number_cell(F.col(f"{p}_rating")).alias("score"),
                (trimmed_or_null(F.col(f"{p}_comment")) if f"{p}_comment" in edits.columns else F.lit(None).cast("string")).alias(
                    "comment"
                ),
            )
            for p in names
            if f"{p}_rating" in edits.columns
        ]
    )
    long = _named(edits).select("listing_id", F.inline(entries), _row_order(edits).alias("row"))
    latest = latest_per_key(long.where(F.col("score").isNotNull()), ["listing_id", "person"], ["row", "score"]).drop("row")
    return latest.withColumn("rated_at", F.current_timestamp() if rated_at is None else rated_at)


def replace_rows(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with every row of a fresh key replaced."""
    return stored.join(send_if_small(fresh.select(*keys)), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


# --- listing details ---------------------------------------------------------


def detail_snapshot(listings: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Detail cells as last shown to people, one row per known cell."""
    wanted = [c for c in (columns or cat.DETAIL_COLUMNS) if c in listings.columns]

    def stored(c: str) -> Column:
        kind = cat.DETAIL_COLUMNS[c][1]
        value = (F.col(c) != 0).cast("int") if kind == "boolean" else F.col(c)
        return cells.canonical_stored(value, kind).alias(c)

    return (
        listings.select("listing_id", *[stored(c) for c in wanted])
        .unpivot("listing_id", wanted, "column_name", "value")
        .where(F.col("value").isNotNull())
    )


def detail_sheet(listings: DataFrame) -> DataFrame:
    """Listings with their detail columns under the labels people see."""
    shown = {
        c: ((F.col(c) != 0) if kind == "boolean" else F.col(c)).cast("string").alias(label)
        for c, (label, kind) in cat.DETAIL_COLUMNS.items()
        if c in listings.columns
    }
    return listings.select("listing_id", "address", *shown.values())


def label_columns() -> dict[str, str]:
    return {label: column for column, (label, _) in cat.DETAIL_COLUMNS.items()}


def detail_cells(edits: DataFrame) -> DataFrame:
    """Every filled detail cell as ``(listing_id, column_name, label, raw,
    value)``; ``value`` is null when the text cannot be read. Sheets may be
    headed by labels or by column names."""
    headed = {**label_columns(), **{c: c for c in cat.DETAIL_COLUMNS}}
    present = {h: c for h, c in headed.items() if h in edits.columns}
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(h).alias("label"),
                F.col(f"`{h}`").alias("raw"),
                cells.canonical_cell(F.col(f"`{h}`"), cat.DETAIL_COLUMNS[c][1]).alias("value"),
            )
            for h, c in present.items()
        ]
    )
    long = _named(edits).select("listing_id", F.inline(entries), _row_order(edits).alias("row"))
    filled = long.where(F.col("raw").isNotNull() & (F.col("raw") != ""))
    return filled


def detail_corrections(edits: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Cells a person changed: readable and not what was last published. A cell
    that merely disagrees with the table by now is no correction. Of several rows
    for a listing each is compared, and the last that changes something counts."""
    readable = detail_cells(edits).where(F.col("value").isNotNull()).select("listing_id", "column_name", "value", "row")
    published = snapshot.select("listing_id", "column_name", F.col("value").alias("published"))
    changed = readable.join(published, ["listing_id", "column_name"], "left").where(~F.col("value").eqNullSafe(F.col("published")))
    changed = changed.select("listing_id", "column_name", "value", "row")
    return latest_per_key(changed, ["listing_id", "column_name"], ["row", "value"]).drop("row")


def detail_issues(edits: DataFrame) -> DataFrame:
    """Filled detail cells nobody can read."""
    return detail_cells(edits).where(F.col("value").isNull()).select(
        F.col("listing_id").alias("subject"),
        F.col("column_name"),
        "raw",
        F.lit("unreadable").alias("reason"),
        F.lit("skipped").alias("action"),
    )


# --- preferences -------------------------------------------------------------


def _by_person(sheet: DataFrame, key: str, suffix: str, names: list[str]) -> DataFrame:
    present = [p for p in names if f"{p}_{suffix}" in sheet.columns]
    entries = F.array(*[F.struct(F.lit(p).alias("person"), F.col(f"{p}_{suffix}").cast("string").alias("raw")) for p in present])
    return sheet.select(key, _row_order(sheet).alias("pos"), F.inline(entries))


def weight_edits(sheet: DataFrame, names: list[str]) -> DataFrame:
    """Weight sheet to ``(person, feature, weight, pos)``; blank and unreadable
    cells set no weight."""
    rows = _by_person(sheet, "feature", "weight", names).where(F.col("feature") != cat.PREFERRED_SUBURBS_ROW)
    weights = rows.select("person", "feature", sheet_weight(F.col("raw")).alias("weight"), "pos")
    return latest_per_key(weights.where(F.col("weight").isNotNull()), ["person", "feature"], ["pos", "weight"])


def weight_issues(sheet: DataFrame, names: list[str], scale: int = cat.SHEET_WEIGHT_SCALE) -> DataFrame:
    """Weight cells that were passed over or held inside the range."""
    rows = _by_person(sheet, "feature", "weight", names).where(F.col("feature") != cat.PREFERRED_SUBURBS_ROW)
    value = to_number(trimmed_or_null(F.col("raw")))
    reason = F.when(value.isNull() & trimmed_or_null(F.col("raw")).isNotNull(), F.lit("unreadable")).when(
        F.abs(value) > scale, F.lit("out of range")
    )
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        F.col("person").alias("subject"),
        F.col("feature").alias("column_name"),
        trimmed_or_null(F.col("raw")).alias("raw"),
        "reason",
        F.when(F.col("reason") == "unreadable", F.lit("skipped")).otherwise(F.lit("clamped")).alias("action"),
    )


def suburb_edits(sheet: DataFrame, names: list[str]) -> DataFrame:
    """The preferred-suburb row, one row per person and suburb. Of several such
    rows the last one is the list, also when it is blank."""
    rows = _by_person(sheet, "feature", "weight", names).where(F.col("feature") == cat.PREFERRED_SUBURBS_ROW)
    last = latest_per_key(rows.select("person", "pos", "raw"), ["person"], ["pos", "raw"])
    return last.select("person", F.explode(cells.list_cell(F.col("raw"))).alias("suburb")).distinct()


def filter_edits(sheet: DataFrame, names: list[str]) -> DataFrame:
    """Filter sheet to ``(person, key, num, text, list, on, pos)``. Unknown
    filters and blank cells are left out; an unticked box stays as off. Of several
    rows for a filter the last readable one sets it, at the place of the first."""
    kinds = {k: [f for f, kind in cat.SHEET_FILTERS.items() if kind == k] for k in ("number", "boolean", "list")}
    raw, key = F.col("raw"), F.col("filter")
    rows = _by_person(sheet, "filter", "value", names).where(key.isin(list(cat.SHEET_FILTERS)))
    parsed = rows.select(
        "person",
        key.alias("key"),
        F.when(key.isin(kinds["number"]), cells.number_cell(raw)).alias("num"),
        F.lit(None).cast("string").alias("text"),
        F.when(key.isin(kinds["list"]), cells.list_cell(raw)).alias("list"),
        F.when(key.isin(kinds["boolean"]), cells.boolean_cell(raw)).alias("on"),
        "pos",
    )
    readable = parsed.where(F.col("num").isNotNull() | F.col("list").isNotNull() | F.col("on").isNotNull())
    last = F.max_by(F.struct("num", "text", "list", "on"), F.struct("pos", "num", "list", "on")).alias("last")
    return readable.groupBy("person", "key").agg(last, F.min("pos").cast("int").alias("pos")).select("person", "key", "last.*", "pos")
