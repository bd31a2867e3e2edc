"""Listing-domain views derived from the shared test tables.

Each text runs unchanged in Spark SQL and in the checking engine. The test
tables hold no nulls, so nulls are made from keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodestead.sources.tables import spread

VIEWS = {
    "v_listings": """
SELECT CAST(p_partkey AS STRING) AS listing_id,
  CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey IN (4, 8) THEN 'Rare#1' ELSE p_brand END AS suburb,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_type END AS property_type,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_retailprice END AS weekly_rent_aud,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size % 5 + 1 AS INT) END AS bedrooms,
  CAST(p_size % 3 + 1 AS INT) AS bathrooms,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST((p_partkey * 37) % 90 AS DOUBLE) END AS commute_transit_minutes,
  CASE WHEN p_partkey % 4 = 0 THEN 6 WHEN p_partkey % 4 = 1 THEN 12 ELSE NULL END AS lease_term_months,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS air_conditioning,
  CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS pet_friendly,
  0 AS pool,
  CAST(NULL AS DOUBLE) AS floor_size_sqm,
  CASE WHEN p_partkey % 29 = 0 THEN 'applied' WHEN p_partkey % 31 = 0 THEN '  ' ELSE NULL END AS status,
  CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE -34.3 + 0.9 * CAST((p_partkey * 7919) % 10007 AS DOUBLE) / 10007 END AS lat,
  CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE 150.4 + 1.1 * CAST((p_partkey * 104729) % 10009 AS DOUBLE) / 10009 END AS lon
FROM part""",
    "v_ratings": """
SELECT CAST((event_id * 31) % (SELECT count(*) FROM part) AS STRING) AS listing_id,
  CASE WHEN user_id % 2 = 0 THEN 'alice' ELSE 'bob' END AS person,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 10 + 1 AS DOUBLE) END AS score,
  event_type AS comment, ts AS rated_at, event_id AS seq
FROM events""",
    "v_poi": """
SELECT CASE s_suppkey % 3 WHEN 0 THEN 'train_station' WHEN 1 THEN 'school' ELSE 'park' END AS category,
  s_name AS name,
  -34.3 + 0.9 * CAST(((s_suppkey - s_suppkey % 6 + s_suppkey % 3) * 6007) % 997 AS DOUBLE) / 997 AS lat,
  150.4 + 1.1 * CAST(((s_suppkey - s_suppkey % 6 + s_suppkey % 3) * 3001) % 991 AS DOUBLE) / 991 AS lon
FROM supplier""",
    "v_routes": """
SELECT CAST(n_nationkey AS STRING) AS route_id,
  CASE n_regionkey WHEN 0 THEN '2' WHEN 1 THEN '401' WHEN 2 THEN '900' ELSE '700' END AS route_type
FROM nation""",
    "v_trips": """
SELECT CAST(c_custkey AS STRING) AS trip_id, CAST(c_nationkey AS STRING) AS route_id FROM customer""",
    "v_stop_times": """
SELECT CAST(o_custkey AS STRING) AS trip_id,
  CAST(o_orderkey % ((SELECT count(*) FROM supplier) + 3) AS STRING) AS stop_id
FROM orders""",
    "v_stops": """
SELECT CAST(s_suppkey AS STRING) AS stop_id,
  CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE s_name END AS stop_name,
  CASE WHEN s_suppkey % 37 = 5 THEN 'n/a' ELSE CAST(s_suppkey % 89 AS STRING) END AS stop_lat,
  CAST(s_suppkey % 83 AS STRING) AS stop_lon,
  CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN '9999999'
       ELSE CAST(s_suppkey - s_suppkey % 4 AS STRING) END AS parent_station
FROM supplier""",
    "v_incoming": """
SELECT CAST(p_partkey AS STRING) AS listing_id,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice + 10 END AS weekly_rent_aud,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size % 4 + 1 AS INT) END AS bedrooms
FROM part WHERE p_partkey % 2 = 0""",
    "v_overrides": """
SELECT CAST(p_partkey AS STRING) AS listing_id,
  CASE WHEN p_partkey % 2 = 0 THEN 'bedrooms' ELSE 'air_conditioning' END AS column_name,
  CASE WHEN p_partkey % 2 = 0 THEN '9' ELSE '1' END AS value
FROM part WHERE p_partkey % 8 < 2""",
    "v_detail_edits": """
SELECT CAST(p_partkey AS STRING) AS listing_id,
  CASE WHEN p_partkey % 6 = 0 THEN 'yes' WHEN p_partkey % 6 = 1 THEN '' WHEN p_partkey % 6 = 2 THEN 'TRUE' ELSE 'no' END AS air_conditioning,
  CASE WHEN p_partkey % 10 = 0 THEN 'twelve' WHEN p_partkey % 10 < 5 THEN ' 12 ' ELSE '' END AS lease_term_months
FROM part""",
    # looked-up geography per address; the address of a listing is its key text
    "v_geo_lookup": """
SELECT concat('addr ', CAST(c_custkey AS STRING)) AS address,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE -33.0 - CAST(c_custkey % 100 AS DOUBLE) / 100 END AS lat,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 151.0 + CAST(c_custkey % 90 AS DOUBLE) / 100 END AS lon,
  CAST(c_custkey % 60 AS DOUBLE) AS driving_minutes,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 75 AS DOUBLE) END AS transit_minutes
FROM customer""",
    "v_walks": """
SELECT concat('addr ', CAST(p_partkey AS STRING)) AS address,
  CASE p_partkey % 3 WHEN 0 THEN 'train_station' WHEN 1 THEN 'school' ELSE 'park' END AS category,
  CASE WHEN p_partkey % 10 = 0 THEN 'n/a' ELSE concat(CAST(p_partkey * 7 % 3000 AS STRING), 's') END AS duration
FROM part""",
    # a rating sheet as people leave it: blanks, white space, unreadable scores
    "v_rating_edits": """
SELECT CASE WHEN p_partkey % 37 = 0 THEN '  ' ELSE concat(' ', CAST(p_partkey AS STRING), ' ') END AS listing_id,
  CASE WHEN p_partkey % 6 = 0 THEN ' inspecting ' WHEN p_partkey % 6 = 1 THEN '   ' ELSE '' END AS status,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 11 AS STRING) WHEN p_partkey % 4 = 1 THEN 'great' ELSE '' END AS alice_rating,
  CASE WHEN p_partkey % 3 = 0 THEN concat('  note ', CAST(p_partkey AS STRING)) ELSE ' ' END AS alice_comment,
  CASE WHEN p_partkey % 5 = 0 THEN ' 7.5 ' WHEN p_partkey % 5 = 1 THEN 'nan' ELSE '' END AS bob_rating,
  '' AS bob_comment, p_partkey AS "row"
FROM part""",
    # preference sheets over many people, taken from the customers
    "v_weight_cells": """
SELECT concat('feature ', CAST(c_custkey AS STRING)) AS feature,
  CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey % 13 - 6 AS STRING) WHEN 1 THEN 'abc' WHEN 2 THEN ' ' WHEN 3 THEN 'nan' ELSE ' -2.5 ' END AS alice_weight,
  CASE c_custkey % 3 WHEN 0 THEN '9' WHEN 1 THEN '-7' ELSE '' END AS bob_weight,
  c_custkey AS "row"
FROM customer""",
}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A test table; ``heavy`` announces work that is worth all cores."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if heavy else scan


def run_sql(spark: SparkSession, sf_dir: str, sql: str, heavy: tuple[str, ...] = ()) -> DataFrame:
    """Spark SQL over the test tables and fixture views it names; ``heavy`` lists
    the tables whose rows meet costly work."""
    text = with_views(sql)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    text = text.replace('"row"', "`row`")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t, t in heavy) for t in used})


def view(spark: SparkSession, sf_dir: str, name: str, heavy: tuple[str, ...] = ()) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}", heavy)


def with_views(sql: str) -> str:
    """Put every fixture view a text names in front of it as a table expression."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    heads = ",\n".join(f"{v} AS ({VIEWS[v]}\n)" for v in used)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"
