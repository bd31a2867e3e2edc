"""Incremental ingest, upsert, overrides, export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.checkpoints import shared_folder
from lodestead.operators import merge
from lodestead.plans.ingest import folded_batch, ingest
from lodestead.plans.workspace import Workspace
from lodestead.queries.registry import query
from lodestead.queries.views import run_sql, view
from lodestead.sinks.tables import newest_first
from lodestead.sources.pages import file_order
from lodestead.sources.tables import conform

PAGES = "SELECT concat('p', CAST(page_id AS STRING), CASE WHEN page_id % 4 = 0 THEN '.htm' ELSE '.html' END) AS source_file, page_id FROM pages"
LEDGER = """SELECT concat('p', CAST(page_id AS STRING), CASE WHEN page_id % 4 = 0 THEN '.htm' ELSE '.html' END) AS source_file,
  CASE WHEN page_id % 6 = 0 THEN NULL ELSE 1e0 END AS lat FROM pages WHERE page_id % 3 = 0"""


@query("ingest_skip", f"SELECT source_file, page_id FROM ({PAGES}) WHERE NOT (page_id % 3 = 0 AND page_id % 6 <> 0)")
def ingest_skip(spark, sf_dir):
    return merge.skip_ingested(run_sql(spark, sf_dir, PAGES), run_sql(spark, sf_dir, LEDGER))


@query("ingest_skip_plain", f"SELECT source_file, page_id FROM ({PAGES}) WHERE page_id % 3 <> 0")
def ingest_skip_plain(spark, sf_dir):
    """Without enrichment every file in the ledger is skipped."""
    return merge.skip_ingested(run_sql(spark, sf_dir, PAGES), run_sql(spark, sf_dir, LEDGER), with_enrichment=False)


@query("run_counters", "SELECT count(*) FILTER (WHERE NOT (page_id % 3 = 0 AND page_id % 6 <> 0)) AS processed, count(*) FILTER (WHERE page_id % 3 = 0 AND page_id % 6 <> 0) AS skipped FROM pages")
def run_counters(spark, sf_dir):
    return merge.run_counters(run_sql(spark, sf_dir, PAGES), ingest_skip(spark, sf_dir))


# Orders as parses: many files per listing, gaps in every column.
BATCH = """SELECT CAST(o_custkey AS STRING) AS listing_id,
  concat(CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '.htm' ELSE '.html' END) AS source_file,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice END AS weekly_rent_aud,
  CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE CAST(o_orderkey % 7 AS INT) END AS bedrooms FROM orders"""
FOLD_SQL = f"""batch AS (SELECT *, CASE WHEN source_file LIKE '%.html' THEN 0 ELSE 1 END AS late FROM ({BATCH})),
folded AS (SELECT listing_id, arg_max(source_file, (late, source_file)) AS source_file,
  arg_max(weekly_rent_aud, (late, source_file)) FILTER (WHERE weekly_rent_aud IS NOT NULL) AS weekly_rent_aud,
  arg_max(bedrooms, (late, source_file)) FILTER (WHERE bedrooms IS NOT NULL) AS bedrooms
  FROM batch GROUP BY listing_id)"""


@query("batch_fold", f"WITH {FOLD_SQL} SELECT * FROM folded")
def batch_fold(spark, sf_dir):
    return merge.fold_batch(run_sql(spark, sf_dir, BATCH), "listing_id", file_order(F.col("source_file")))


STORED = "SELECT * FROM v_listings WHERE CAST(listing_id AS INT) % 5 <> 0"
SHOWN = "listing_id, suburb, weekly_rent_aud, bedrooms, bathrooms, air_conditioning, lat"
UPSERT_SQL = f"""stored AS ({STORED}), merged AS (
  SELECT coalesce(n.listing_id, s.listing_id) AS listing_id, suburb, coalesce(n.weekly_rent_aud, s.weekly_rent_aud) AS weekly_rent_aud,
    coalesce(n.bedrooms, s.bedrooms) AS bedrooms, bathrooms, air_conditioning, lat
  FROM stored s FULL OUTER JOIN v_incoming n ON s.listing_id = n.listing_id
)"""


@query("upsert_merge", f"WITH {UPSERT_SQL} SELECT {SHOWN} FROM merged")
def upsert_merge(spark, sf_dir):
    merged = merge.upsert(run_sql(spark, sf_dir, STORED), view(spark, sf_dir, "v_incoming"))
    return merged.select(*SHOWN.split(", "))


@query(
    "upsert_apply",
    f"""WITH {UPSERT_SQL} SELECT m.listing_id, suburb, weekly_rent_aud,
      coalesce(CAST(b.value AS INT), bedrooms) AS bedrooms, bathrooms, coalesce(CAST(a.value AS INT), air_conditioning) AS air_conditioning, lat
    FROM merged m LEFT JOIN v_overrides b ON m.listing_id = b.listing_id AND b.column_name = 'bedrooms'
    LEFT JOIN v_overrides a ON m.listing_id = a.listing_id AND a.column_name = 'air_conditioning'""",
)
def upsert_apply(spark, sf_dir):
    """A batch over the stored table, then human corrections over both."""
    merged = merge.upsert(run_sql(spark, sf_dir, STORED), view(spark, sf_dir, "v_incoming"))
    return merge.apply_overrides(merged, view(spark, sf_dir, "v_overrides")).select(*SHOWN.split(", "))


# A batch of files, some read before, over the stored listings and under human corrections.
READ_BEFORE = "SELECT source_file, 1e0 AS lat FROM batch WHERE CAST(split_part(source_file, '.', 1) AS BIGINT) % 4 = 0"
INGEST_SQL = f"""batch AS (SELECT *, CASE WHEN source_file LIKE '%.html' THEN 0 ELSE 1 END AS late FROM ({BATCH})),
read_before AS ({READ_BEFORE}),
folded AS (SELECT listing_id, arg_max(source_file, (late, source_file)) AS source_file,
  arg_max(weekly_rent_aud, (late, source_file)) FILTER (WHERE weekly_rent_aud IS NOT NULL) AS weekly_rent_aud,
  arg_max(bedrooms, (late, source_file)) FILTER (WHERE bedrooms IS NOT NULL) AS bedrooms
  FROM batch WHERE source_file NOT IN (SELECT source_file FROM read_before) GROUP BY listing_id),
corrected AS (SELECT f.listing_id, source_file, weekly_rent_aud, coalesce(CAST(b.value AS INT), bedrooms) AS bedrooms, CAST(a.value AS INT) AS air_conditioning
  FROM folded f LEFT JOIN v_overrides b ON f.listing_id = b.listing_id AND b.column_name = 'bedrooms'
  LEFT JOIN v_overrides a ON f.listing_id = a.listing_id AND a.column_name = 'air_conditioning'),
stored AS ({STORED})"""


@query(
    "ingest_batch",
    f"""WITH {INGEST_SQL} SELECT coalesce(n.listing_id, s.listing_id) AS listing_id, suburb, coalesce(n.weekly_rent_aud, s.weekly_rent_aud) AS weekly_rent_aud,
      coalesce(n.bedrooms, s.bedrooms) AS bedrooms, bathrooms, coalesce(n.air_conditioning, s.air_conditioning) AS air_conditioning, lat, source_file
    FROM stored s FULL OUTER JOIN corrected n ON s.listing_id = n.listing_id""",
)
def ingest_batch(spark, sf_dir):
    """A whole batch through a bucketed table: skip, fold, overrides, and the merge of the buckets it falls into."""
    batch = run_sql(spark, sf_dir, BATCH)
    ledger = run_sql(spark, sf_dir, f"WITH batch AS ({BATCH}) {READ_BEFORE}")
    space = Workspace(spark, f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}", buckets=16)
    space.write("listings", conform(run_sql(spark, sf_dir, STORED)))
    fresh = folded_batch(merge.skip_ingested(batch, ledger), view(spark, sf_dir, "v_overrides"))
    space.revise("listings", fresh, lambda rows: merge.upsert(rows, merge.send_if_small(fresh)))
    return space.read("listings").select(*SHOWN.split(", "), "source_file")


@query("run_log", "SELECT 'ingest' AS job, count(*) FILTER (WHERE page_id % 3 <> 0) AS processed, count(*) FILTER (WHERE page_id % 3 = 0) AS skipped FROM pages")
def run_log(spark, sf_dir):
    """What an ingest of all pages notes about itself, a third of them read before."""
    pages = run_sql(spark, sf_dir, f"SELECT source_file, html, DATE '2026-01-01' AS captured_on FROM ({PAGES}) JOIN pages USING (page_id)")
    space = Workspace(spark, f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}", buckets=16)
    space.write("ledger", run_sql(spark, sf_dir, f"SELECT source_file, CAST(NULL AS STRING) AS listing_id FROM ({PAGES}) WHERE page_id % 3 = 0"))
    ingest(space, pages, with_enrichment=False)
    return space.read("run_log").select("job", "processed", "skipped")


DATED = """SELECT listing_id, suburb, weekly_rent_aud,
  CAST('2026-01-01' AS TIMESTAMP) + INTERVAL '1' DAY * (CAST(listing_id AS INT) % 97) AS date_captured FROM v_listings"""


@query("export_newest_first", f"SELECT * FROM ({DATED}) ORDER BY date_captured DESC, listing_id")
def export_newest_first(spark, sf_dir):
    return newest_first(run_sql(spark, sf_dir, DATED))


@query(
    "schema_evolution",
    "SELECT listing_id, weekly_rent_aud, bedrooms, CAST(NULL AS VARCHAR) AS manual_notes, CAST(NULL AS INT) AS second_storey, CAST(NULL AS DOUBLE) AS nearest_beach_km FROM v_incoming",
)
def schema_evolution(spark, sf_dir):
    """A table of an older catalogue read under today's."""
    wide = conform(view(spark, sf_dir, "v_incoming"))
    assert wide.columns == list(cat.LISTING_COLUMNS)
    return wide.select("listing_id", "weekly_rent_aud", "bedrooms", "manual_notes", "second_storey", "nearest_beach_km")
