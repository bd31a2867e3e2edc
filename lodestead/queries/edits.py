"""Edits against stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestead.functions import cells
from lodestead.operators import merge, reconcile
from lodestead.queries.registry import query
from lodestead.queries.scoring import NAMES
from lodestead.queries.views import run_sql, view

COLUMNS = ["air_conditioning", "lease_term_months"]
SNAPSHOT_SQL = """snapshot AS (
  SELECT listing_id, 'air_conditioning' AS column_name, CASE WHEN air_conditioning <> 0 THEN '1.0' ELSE '0.0' END AS value
  FROM v_listings WHERE air_conditioning IS NOT NULL
  UNION ALL SELECT listing_id, 'lease_term_months', concat(CAST(lease_term_months AS VARCHAR), '.0') FROM v_listings WHERE lease_term_months IS NOT NULL
)"""
CELLS_SQL = """cells AS (
  SELECT listing_id, 'air_conditioning' AS column_name, air_conditioning AS raw,
    CASE WHEN trim(air_conditioning) = '' THEN NULL WHEN lower(trim(air_conditioning)) IN ('true', 'yes', '1') THEN '1.0' ELSE '0.0' END AS value
  FROM v_detail_edits
  UNION ALL SELECT listing_id, 'lease_term_months', lease_term_months, CAST(TRY_CAST(trim(lease_term_months) AS DOUBLE) AS VARCHAR) FROM v_detail_edits
)"""
CORRECTIONS_SQL = f"""{SNAPSHOT_SQL}, {CELLS_SQL}, corrections AS (
  SELECT c.listing_id, c.column_name, c.value FROM cells c LEFT JOIN snapshot s ON c.listing_id = s.listing_id AND c.column_name = s.column_name
  WHERE raw <> '' AND c.value IS NOT NULL AND c.value IS DISTINCT FROM s.value
)"""


def _snapshot(spark, sf_dir):
    return reconcile.detail_snapshot(view(spark, sf_dir, "v_listings"), COLUMNS)


def _corrections(spark, sf_dir):
    return reconcile.detail_corrections(view(spark, sf_dir, "v_detail_edits"), _snapshot(spark, sf_dir))


@query("detail_snapshot", f"WITH {SNAPSHOT_SQL} SELECT * FROM snapshot")
def detail_snapshot(spark, sf_dir):
    return _snapshot(spark, sf_dir)


@query("detail_cells", f"WITH {CELLS_SQL} SELECT listing_id, column_name, raw, value FROM cells WHERE raw <> ''")
def detail_cells(spark, sf_dir):
    return reconcile.detail_cells(view(spark, sf_dir, "v_detail_edits")).drop("label", "row")


@query("detail_diff", f"WITH {CORRECTIONS_SQL} SELECT * FROM corrections")
def detail_diff(spark, sf_dir):
    return _corrections(spark, sf_dir)


@query(
    "detail_issues",
    f"""WITH {CELLS_SQL} SELECT listing_id AS subject, column_name, raw, 'unreadable' AS reason, 'skipped' AS action FROM cells
    WHERE raw <> '' AND value IS NULL""",
)
def detail_issues(spark, sf_dir):
    return reconcile.detail_issues(view(spark, sf_dir, "v_detail_edits"))


@query(
    "detail_update",
    f"""WITH {CORRECTIONS_SQL} SELECT l.listing_id, coalesce(CAST(CAST(a.value AS DOUBLE) AS INT), air_conditioning) AS air_conditioning,
      coalesce(CAST(CAST(t.value AS DOUBLE) AS INT), lease_term_months) AS lease_term_months
    FROM v_listings l LEFT JOIN corrections a ON l.listing_id = a.listing_id AND a.column_name = 'air_conditioning'
    LEFT JOIN corrections t ON l.listing_id = t.listing_id AND t.column_name = 'lease_term_months'""",
)
def detail_update(spark, sf_dir):
    """Corrections applied to the listings themselves."""
    updated = merge.apply_overrides(view(spark, sf_dir, "v_listings"), _corrections(spark, sf_dir))
    return updated.select("listing_id", *COLUMNS)


@query(
    "override_store",
    f"""WITH {CORRECTIONS_SQL} SELECT listing_id, column_name, value FROM corrections
    UNION ALL SELECT o.listing_id, o.column_name, o.value FROM v_overrides o
    WHERE NOT EXISTS (SELECT 1 FROM corrections c WHERE c.listing_id = o.listing_id AND c.column_name = o.column_name)""",
)
def override_store(spark, sf_dir):
    return reconcile.replace_rows(view(spark, sf_dir, "v_overrides"), _corrections(spark, sf_dir), ["listing_id", "column_name"])


EDITS_SQL = """edits AS (SELECT nullif(trim(listing_id), '') AS listing_id, nullif(trim(status), '') AS status,
  CASE WHEN trim(alice_rating) = 'nan' THEN NULL ELSE TRY_CAST(trim(alice_rating) AS DOUBLE) END AS alice, nullif(trim(alice_comment), '') AS alice_comment,
  CASE WHEN trim(bob_rating) = 'nan' THEN NULL ELSE TRY_CAST(trim(bob_rating) AS DOUBLE) END AS bob, nullif(trim(bob_comment), '') AS bob_comment
  FROM v_rating_edits WHERE trim(listing_id) <> ''),
long AS (SELECT listing_id, 'alice' AS person, alice AS score, alice_comment AS comment FROM edits WHERE alice IS NOT NULL
  UNION ALL SELECT listing_id, 'bob', bob, bob_comment FROM edits WHERE bob IS NOT NULL)"""


@query(
    "status_edits",
    f"WITH {EDITS_SQL} SELECT l.listing_id, coalesce(e.status, l.status) AS status FROM v_listings l LEFT JOIN edits e ON l.listing_id = e.listing_id",
)
def status_edits(spark, sf_dir):
    edits = reconcile.status_edits(view(spark, sf_dir, "v_rating_edits"))
    return merge.apply_status(view(spark, sf_dir, "v_listings").select("listing_id", "status"), edits)


@query("rating_edits", f"WITH {EDITS_SQL} SELECT * FROM long")
def rating_edits(spark, sf_dir):
    return reconcile.rating_edits(view(spark, sf_dir, "v_rating_edits"), NAMES).drop("rated_at")


@query(
    "rating_upsert",
    f"""WITH {EDITS_SQL}, latest AS (SELECT listing_id, person, score, comment FROM (
      SELECT *, row_number() OVER (PARTITION BY listing_id, person ORDER BY rated_at DESC, seq DESC) AS rn FROM v_ratings) WHERE rn = 1)
    SELECT * FROM long UNION ALL SELECT t.* FROM latest t
    WHERE NOT EXISTS (SELECT 1 FROM long e WHERE e.listing_id = t.listing_id AND e.person = t.person)""",
)
def rating_upsert(spark, sf_dir):
    stored = merge.latest_per_key(view(spark, sf_dir, "v_ratings"), ["listing_id", "person"], ["rated_at", "seq"])
    return reconcile.replace_rows(
        stored.select("listing_id", "person", "score", "comment"), rating_edits(spark, sf_dir), ["listing_id", "person"]
    )


@query(
    "edit_counters",
    f"""WITH {EDITS_SQL} SELECT (SELECT count(*) FROM long) AS ratings, (SELECT count(*) FROM edits WHERE status IS NOT NULL) AS statuses""",
)
def edit_counters(spark, sf_dir):
    sheet = view(spark, sf_dir, "v_rating_edits")
    changes = reconcile.rating_edits(sheet, NAMES).select(F.lit("rating").alias("kind")).unionByName(
        reconcile.status_edits(sheet).select(F.lit("status").alias("kind"))
    )
    return changes.agg(
        F.count_if(F.col("kind") == "rating").alias("ratings"), F.count_if(F.col("kind") == "status").alias("statuses")
    )


WEIGHTS_SQL = """cells AS (SELECT feature, 'alice' AS person, trim(alice_weight) AS raw, "row" AS pos FROM v_weight_cells
  UNION ALL SELECT feature, 'bob', trim(bob_weight), "row" FROM v_weight_cells),
read AS (SELECT *, CASE WHEN raw = 'nan' THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS v FROM cells)"""


@query("weight_edits", f"WITH {WEIGHTS_SQL} SELECT person, feature, least(greatest(v, -5e0), 5e0) / 5e0 AS weight, pos FROM read WHERE v IS NOT NULL")
def weight_edits(spark, sf_dir):
    return reconcile.weight_edits(view(spark, sf_dir, "v_weight_cells"), NAMES)


@query(
    "weight_issues",
    f"""WITH {WEIGHTS_SQL} SELECT person AS subject, feature AS column_name, raw, CASE WHEN v IS NULL THEN 'unreadable' ELSE 'out of range' END AS reason,
      CASE WHEN v IS NULL THEN 'skipped' ELSE 'clamped' END AS action FROM read WHERE (v IS NULL AND raw <> '') OR abs(v) > 5""",
)
def weight_issues(spark, sf_dir):
    return reconcile.weight_issues(view(spark, sf_dir, "v_weight_cells"), NAMES)


# A filter sheet per nation, with known and unknown filters.
FILTER_SHEET = """SELECT CASE n_nationkey % 5 WHEN 0 THEN 'max_weekly_rent_aud' WHEN 1 THEN 'excluded_suburb' WHEN 2 THEN 'pet_friendly_required'
    WHEN 3 THEN 'max_moon_phase' ELSE 'min_bedrooms' END AS filter,
  CASE n_nationkey % 5 WHEN 0 THEN CASE WHEN n_nationkey = 20 THEN '12F' ELSE concat(' ', CAST(1200 + n_nationkey AS STRING), ' ') END WHEN 1 THEN concat(' ', n_name, ', ,Glebe ') WHEN 2 THEN 'FALSE' WHEN 3 THEN '3' ELSE 'two' END AS alice_value,
  CASE WHEN n_nationkey % 2 = 0 THEN '' WHEN n_nationkey % 5 = 1 THEN ' , ' ELSE 'Yes' END AS bob_value, n_nationkey AS "row" FROM nation"""
FILTERS_SQL = f"""cells AS (SELECT filter AS "key", 'alice' AS person, alice_value AS raw, "row" AS pos FROM ({FILTER_SHEET})
  UNION ALL SELECT filter, 'bob', bob_value, "row" FROM ({FILTER_SHEET})),
read AS (SELECT person, "key", CASE WHEN "key" LIKE 'm%' THEN TRY_CAST(trim(raw) AS DOUBLE) END AS num,
  CASE WHEN "key" = 'pet_friendly_required' AND trim(raw) <> '' THEN lower(trim(raw)) IN ('true', 'yes', '1') END AS "on",
  CASE WHEN "key" = 'excluded_suburb' THEN array_to_string(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> ''), '|') END AS items, pos
  FROM cells WHERE "key" <> 'max_moon_phase')"""


@query(
    "filter_edits",
    f"""WITH {FILTERS_SQL}, ranked AS (
      SELECT *, min(pos) OVER (PARTITION BY person, "key") AS first_pos, row_number() OVER (PARTITION BY person, "key" ORDER BY pos DESC) AS place
      FROM read WHERE num IS NOT NULL OR "on" IS NOT NULL OR items <> '')
    SELECT person, "key", num, "on", nullif(items, '') AS items, CAST(first_pos AS INTEGER) AS pos FROM ranked WHERE place = 1""",
)
def filter_edits(spark, sf_dir):
    found = reconcile.filter_edits(run_sql(spark, sf_dir, FILTER_SHEET), NAMES)
    return found.withColumn("items", F.array_join("list", "|")).drop("list", "text")


SUBURB_SHEET = """SELECT CASE WHEN n_nationkey % 6 = 0 THEN 'preferred_suburbs_list' ELSE n_name END AS feature,
  concat(n_name, ' , ,North ', n_name) AS alice_weight, CASE WHEN n_nationkey % 12 = 0 THEN ' ' ELSE n_name END AS bob_weight, n_nationkey AS "row" FROM nation"""


@query(
    "suburb_edits",
    f"""WITH cells AS (SELECT 'alice' AS person, alice_weight AS raw, "row" AS pos FROM ({SUBURB_SHEET}) WHERE feature = 'preferred_suburbs_list'
      UNION ALL SELECT 'bob', bob_weight, "row" FROM ({SUBURB_SHEET}) WHERE feature = 'preferred_suburbs_list'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY pos DESC) AS place FROM cells),
    items AS (SELECT person, trim(unnest(string_split(raw, ','))) AS suburb FROM ranked WHERE place = 1)
    SELECT DISTINCT person, suburb FROM items WHERE suburb <> ''""",
)
def suburb_edits(spark, sf_dir):
    return reconcile.suburb_edits(run_sql(spark, sf_dir, SUBURB_SHEET), NAMES)


# Order dates written in the spellings people use, then read back.
CELL_TEXTS = """SELECT o_orderkey AS id, CASE o_orderkey % 4
    WHEN 0 THEN {iso} WHEN 1 THEN concat(' ', {day}, '/', {month}, '/', {year}, ' ') WHEN 2 THEN concat({day}, ' ', {name}, ' ', {year}) ELSE 'soon' END AS date_text,
  CASE WHEN o_orderkey % 3 = 0 THEN concat(' ', CAST(o_totalprice AS STRING)) WHEN o_orderkey % 6 = 1 THEN 'about ten' WHEN o_orderkey % 6 = 4 THEN '5d' ELSE '   ' END AS number_text,
  CASE o_orderkey % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'nope' ELSE '' END AS boolean_text FROM orders"""
_DATE_PARTS = {
    "iso": "date_format(o_orderdate, 'yyyy-MM-dd')",
    "day": "CAST(day(o_orderdate) AS STRING)",
    "month": "CAST(month(o_orderdate) AS STRING)",
    "year": "CAST(year(o_orderdate) AS STRING)",
    "name": "date_format(o_orderdate, 'MMM')",
}


@query(
    "cell_values",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS as_date,
      CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS as_number,
      CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 5 < 3 END AS as_boolean FROM orders""",
)
def cell_values(spark, sf_dir):
    texts = run_sql(spark, sf_dir, CELL_TEXTS.format(**_DATE_PARTS))
    return texts.select(
        "id",
        cells.date_cell(F.col("date_text")).alias("as_date"),
        cells.number_cell(F.col("number_text")).alias("as_number"),
        cells.boolean_cell(F.col("boolean_text")).alias("as_boolean"),
    )
