"""Human edits that repeat, contradict or cannot be read, and what they must not touch."""

import time

import pytest
from pyspark.sql import functions as F

from lodestead.functions import cells, numbers
from lodestead.operators import enrich, merge, reconcile
from lodestead.operators.locate import _walk
from lodestead.plans.refresh import Edits, pull_edits
from lodestead.plans.workspace import Workspace
from lodestead.sources.tables import read_edits


@pytest.mark.parametrize(
    "text, value",
    [("5d", None), ("12F", None), ("0x10", None), ("5", 5.0), (" -1.5 ", -1.5), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("inf", float("inf")), ("nan", None), ("", None), ("1 2", None)],
)
def test_whole_numbers(spark, text, value):
    row = spark.createDataFrame([(text,)], "t string").select(numbers.to_number(F.col("t")).alias("a"), cells.number_cell(F.col("t")).alias("b")).first()
    assert row.a == value and row.b == value


def test_unreadable_weights_are_issues(spark):
    sheet = spark.createDataFrame([("pool", "5d", "3"), ("gym", "9", "")], "feature string, ann_weight string, bo_weight string")
    assert {(r.subject, r.raw, r.reason) for r in reconcile.weight_issues(sheet, ["ann", "bo"]).collect()} == {("ann", "5d", "unreadable"), ("ann", "9", "out of range")}
    assert {(r.person, r.feature) for r in reconcile.weight_edits(sheet, ["ann", "bo"]).collect()} == {("ann", "gym"), ("bo", "pool")}


def test_last_filter_row_counts(spark):
    rows = [("max_weekly_rent_aud", "500", "700", 0), ("min_bedrooms", "2", "", 1), ("max_weekly_rent_aud", "900", "a lot", 2)]
    sheet = spark.createDataFrame(rows, "filter string, ann_value string, bo_value string, row long")
    found = {(r.person, r.key, r.num, r.pos) for r in reconcile.filter_edits(sheet, ["ann", "bo"]).collect()}
    assert found == {("ann", "max_weekly_rent_aud", 900.0, 0), ("ann", "min_bedrooms", 2.0, 1), ("bo", "max_weekly_rent_aud", 700.0, 0)}


def test_last_suburb_row_is_the_list(spark):
    rows = [("preferred_suburbs_list", "Glebe, Newtown", "Glebe", 0), ("preferred_suburbs_list", "Enmore", " ", 1)]
    sheet = spark.createDataFrame(rows, "feature string, ann_weight string, bo_weight string, row long")
    assert {(r.person, r.suburb) for r in reconcile.suburb_edits(sheet, ["ann", "bo"]).collect()} == {("ann", "Enmore")}


def test_each_detail_row_is_compared(spark):
    sheet = spark.createDataFrame([("1", "12", 0), ("1", "6", 1), ("2", "6", 0)], "listing_id string, lease_term_months string, row long")
    snapshot = spark.createDataFrame([("1", "lease_term_months", "6.0"), ("2", "lease_term_months", "6.0")], "listing_id string, column_name string, value string")
    assert [(r.listing_id, r.value) for r in reconcile.detail_corrections(sheet, snapshot).collect()] == [("1", "12.0")]


def test_rows_of_several_files_are_in_order_of_their_names(spark, tmp_path):
    (tmp_path / "part-00000.csv").write_text("listing_id,status\n1,first\n2,only\n")
    (tmp_path / "part-00001.csv").write_text("listing_id,status\n" + "".join(f"x{i},seen\n" for i in range(2000)) + "1,last\n")
    edits = read_edits(spark, str(tmp_path))
    assert sorted(r.row for r in edits.collect()) == list(range(2003))
    assert {r.listing_id: r.status for r in reconcile.status_edits(edits).where("listing_id in ('1', '2')").collect()} == {"1": "last", "2": "only"}


def test_pulling_for_one_person_leaves_the_others(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "space"))

    def sheets(weight, rent):
        weights = [("pool", weight, weight), ("preferred_suburbs_list", "Glebe", "Enmore")]
        filters = [("max_weekly_rent_aud", rent, rent), ("min_bedrooms", "", "2")]
        return Edits(
            weights=spark.createDataFrame(weights, "feature string, ann_weight string, bo_weight string"),
            filters=spark.createDataFrame(filters, "filter string, ann_value string, bo_value string"),
        )

    pull_edits(space, sheets("5", "500"), ["ann", "bo"])
    pull_edits(space, sheets("1", "900"), ["ann"])
    assert {(r.person, r.weight) for r in space.read("weights").collect()} == {("ann", 0.2), ("bo", 1.0)}
    assert {(r.person, r.suburb) for r in space.read("preferred_suburbs").collect()} == {("ann", "Glebe"), ("bo", "Enmore")}
    assert {(r.person, r.key, r.num) for r in space.read("hard_filters").collect()} == {("ann", "max_weekly_rent_aud", 900.0), ("bo", "max_weekly_rent_aud", 500.0), ("bo", "min_bedrooms", 2.0)}


def test_listings_without_address_join_nothing(spark):
    listings = spark.createDataFrame([("1", "a", 1.0), ("2", None, 2.0), ("3", None, None), ("4", "b", None)], "listing_id string, address string, lat double")
    lookup = spark.createDataFrame([("a", 9.0, 8.0, 1.0, 2.0), (None, 7.0, 7.0, 7.0, 7.0)], "address string, lat double, lon double, driving_minutes double, transit_minutes double")
    found = {r.listing_id: (r.lat, r.lon, r.commute_driving_minutes) for r in enrich.with_geo_lookup(listings, lookup).collect()}
    assert found == {"1": (9.0, 8.0, 1.0), "2": (2.0, None, None), "3": (None, None, None), "4": (None, None, None)}


def test_skipping_moves_names_only(spark):
    pages = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z"), (None, "w")], "source_file string, html string")
    ledger = spark.createDataFrame([("a", 1.0)], "source_file string, lat double")
    left = merge.skip_ingested(pages, ledger)
    assert sorted(r.html for r in left.collect()) == ["w", "y", "z"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merge.skip_ingested(pages, ledger)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moved and "BroadcastHashJoin [source_file" in plan


def test_skipping_beyond_a_broadcast(spark):
    """A bitmap of the ledger's names is applied where the pages are read; only names it claims are looked up."""
    pages = spark.range(2000).selectExpr("CASE WHEN id % 50 = 7 THEN NULL ELSE concat('f', CAST(id AS STRING)) END AS source_file", "concat('h', CAST(id AS STRING)) AS html", "id AS _part").repartition(3)
    ledger = spark.range(500, 3000).selectExpr("concat('f', CAST(id AS STRING)) AS source_file", "CASE WHEN id % 3 = 0 THEN NULL ELSE 1e0 END AS lat")
    expected = sorted(r.html for r in merge.skip_ingested(pages, ledger).collect())
    assert len(expected) == sum(i % 50 == 7 or i < 500 or i % 3 == 0 for i in range(2000))
    assert sorted(r.html for r in merge.skip_ingested(pages, ledger, limit=-1).collect()) == expected
    add, bits = merge.claims(ledger, most_bits=1 << 15)
    claimed = add(pages.select("source_file"))
    assert bits == 1 << 15 and claimed.join(ledger, "source_file").where("NOT _claimed").count() == 0
    assert claimed.where("NOT _claimed").count() > 300
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo = merge.skip_ingested(pages.select("source_file", "html"), ledger, limit=-1)
        moved = []

        def walk(node):
            if node.nodeName().startswith("Exchange") and "REPARTITION" not in node.toString().splitlines()[0]:
                moved.append(node.output().mkString(","))
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(todo._jdf.queryExecution().executedPlan().initialPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved and not any("html" in m for m in moved)
    assert merge.skip_ingested(pages, ledger.limit(0), limit=-1).count() == 2000


def test_page_walk_is_linear():
    page = "<div>" * 100_000 + "</span>" * 100_000
    start = time.perf_counter()
    _walk(page)
    assert time.perf_counter() - start < 3
    assert _walk("<div class=x><p>a</b></p></div>") == _walk("<div class=x><p>a</p></div>")


def test_old_versions_go(spark, tmp_path):
    from lodestead.sinks.tables import KEPT_VERSIONS

    space = Workspace(spark, str(tmp_path / "space"))
    for i in range(KEPT_VERSIONS + 3):
        space.write("people", spark.createDataFrame([(f"p{i}",)], "person string").coalesce(1))
    folders = sorted(p.name for p in (tmp_path / "space" / "people").iterdir())
    assert len(folders) == KEPT_VERSIONS and space.read("people").first().person == f"p{KEPT_VERSIONS + 2}"


def test_nearest_without_broadcast(spark, monkeypatch):
    from lodestead.operators import nearest

    rows = [(str(i), -33.0 if i % 2 else None, 151.0 + (i % 3) * 0.001) for i in range(40)]
    listings = spark.createDataFrame(rows, "listing_id string, lat double, lon double")
    points = spark.createDataFrame([("park", f"P{i}", -33.0 + i * 0.01, 151.0 + i * 0.02) for i in range(50)], "category string, name string, lat double, lon double")
    one = {r.listing_id: (r.nearest_park, r.nearest_park_km) for r in nearest.nearest_wide(listings, points).collect()}
    monkeypatch.setattr(nearest, "BROADCAST_ENTRIES", -1)
    two = {r.listing_id: (r.nearest_park, r.nearest_park_km) for r in nearest.nearest_wide(listings, points, leaf_points=4).collect()}
    assert one == two and len(two) == 40 and two["0"] == (None, None) and two["1"][0] == "P0"
