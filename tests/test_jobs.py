"""Whole jobs: ingest, pickup, refresh."""

import datetime as dt

from pyspark.sql import functions as F

from lodestead.plans.ingest import ingest
from lodestead.plans.refresh import Edits, publish_all, pull_edits, refresh, stored_preferences
from lodestead.plans.workspace import Workspace
from lodestead.sinks.tables import current_path, export_csv, write_stations
from lodestead.sources.pages import read_pages
from lodestead.sources.tables import conform, read_edits, read_listings, read_ratings
from lodestead.streaming.pickup import pick_up_pages

PAGE = """<link rel=canonical href="https://h.example/x-{id}"><h1 class="property-info-address">{id} High St, Glebe NSW 2037</h1>
<ul class="property-info__primary-features"><li aria-label="{beds} bedrooms"></ul><span class="property-price">${rent} per week</span>
<meta property="og:description" content="Home.&lt;br&gt;- {feature}">"""


def save(folder, name, **values):
    folder.mkdir(exist_ok=True)
    facts = {"id": 1, "beds": 2, "rent": 500, "feature": "Pool", **values}
    (folder / name).write_text(PAGE.format(**facts))


def space_with_points(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "space"))
    space.write("points", spark.createDataFrame([("park", "P", -33.0, 151.0)], "category string, name string, lat double, lon double"), ["category"])
    lookup = spark.createDataFrame(
        [("1 High St, Glebe NSW 2037", -33.1, 151.1, 20.0, 30.0)],
        "address string, lat double, lon double, driving_minutes double, transit_minutes double",
    )
    space.write("geo_lookup", lookup)
    return space


def by_id(space):
    return {r["listing_id"]: r for r in space.read("listings").collect()}


def test_ingest_again_and_again(spark, tmp_path):
    space, folder = space_with_points(spark, tmp_path), tmp_path / "pages"
    save(folder, "one.html")
    save(folder, "two.html", id=2, rent=600)
    pages = read_pages(spark, str(folder))
    walks = spark.createDataFrame([("1 High St, Glebe NSW 2037", "park", "600s")], "address string, category string, duration string")
    assert ingest(space, pages, walks=walks, anchor=(-33.0, 151.0)) == {"processed": 2, "skipped": 0}
    first = by_id(space)
    assert first["1"]["lat"] == -33.1 and first["1"]["nearest_park"] == "P" and first["1"]["nearest_park_walk_minutes"] == 10.0
    assert first["1"]["straight_line_km"] > 10 and first["2"]["lat"] is None and first["2"]["straight_line_km"] is None
    # the one without a position is tried again, the other is left alone
    assert ingest(space, pages) == {"processed": 1, "skipped": 1}
    assert ingest(space, pages, with_enrichment=False) == {"processed": 0, "skipped": 2}
    again = by_id(space)
    assert again["1"] == first["1"] and again["2"]["weekly_rent_aud"] == 600.0
    # a second file of the same listing updates it, and its nulls erase nothing
    (folder / "three.htm").write_text('<link rel=canonical href="https://h.example/x-1"><span class="property-price">$777</span>')
    assert ingest(space, read_pages(spark, str(folder)), with_enrichment=False)["processed"] == 1
    merged = by_id(space)["1"]
    assert (merged["weekly_rent_aud"], merged["bedrooms"], merged["source_file"]) == (777.0, 2, "three.htm")
    assert ingest(space, read_pages(spark, str(folder)), with_enrichment=False)["processed"] == 0
    assert ingest(space, read_pages(spark, str(folder)), force=True, with_enrichment=False)["processed"] == 3


def files_of(space, name):
    from pathlib import Path

    root = Path(current_path(space.spark, space.path(name)).removeprefix("file:"))
    found = {}
    for f in root.glob("*=*/*.parquet"):
        found.setdefault(f.parent.name, set()).add(f.name)
    return found


def test_ingest_touches_only_its_buckets(spark, tmp_path):
    space, folder = space_with_points(spark, tmp_path), tmp_path / "pages"
    rows = spark.range(500).selectExpr("CAST(id AS STRING) AS listing_id", "CAST(id AS DOUBLE) AS weekly_rent_aud", "'x' AS suburb")
    space.write("listings", conform(rows))
    before = files_of(space, "listings")
    assert len(before) == 64 and all(b.startswith("bucket_of_64=") for b in before)
    save(folder, "one.html", id=3, rent=900)
    save(folder, "two.html", id=1000)
    ingest(space, read_pages(spark, str(folder)), with_enrichment=False)
    after = files_of(space, "listings")
    assert sorted(b for b in after if after[b] != before[b]) == sorted({f"bucket_of_64={r[0]}" for r in spark.sql("SELECT CAST(pmod(xxhash64(x), 64) AS INT) FROM VALUES ('3'), ('1000') AS t(x)").collect()})
    found = by_id(space)
    assert len(found) == 501 and found["3"]["weekly_rent_aud"] == 900.0 and found["3"]["suburb"] == "Glebe" and found["4"]["weekly_rent_aud"] == 4.0
    # a workspace that would make other buckets keeps to those that are there
    other = Workspace(spark, str(tmp_path / "space"), buckets=8)
    other.revise("listings", spark.createDataFrame([("4",)], "listing_id string"), lambda r: r.withColumn("suburb", F.when(F.col("listing_id") == "4", "Y").otherwise(F.col("suburb"))))
    assert by_id(other)["4"]["suburb"] == "Y" and len(files_of(other, "listings")) == 64 and len(by_id(other)) == 501
    log = [(r.job, r.processed, r.skipped, r.buckets) for r in space.read("run_log").collect()]
    assert log == [("ingest", 2, 0, 2)] or log == [("ingest", 2, 0, 1)]
    parsed = [r for r in found.values() if r["source_file"]]
    seen = {r.field: (r.missing, r.total) for r in space.read("coverage").collect()}
    assert len(seen) == 5 and seen["weekly_rent_aud"] == (sum(r["weekly_rent_aud"] is None for r in parsed), 2)
    assert seen["address"] == (sum(r["address"] is None for r in parsed), 2)


def test_points_replace_only_their_categories(spark, tmp_path):
    from lodestead.plans.reference_tables import _replace

    space = Workspace(spark, str(tmp_path / "space"))
    point = lambda *rows: spark.createDataFrame(rows, "category string, name string, lat double, lon double")
    _replace(space, point(("park", "A", 1.0, 2.0), ("school", "S", 1.0, 2.0), ("beach", "B", 1.0, 2.0)), ["park", "school", "beach"])
    before = files_of(space, "points")
    _replace(space, point(("park", "C", 1.0, 2.0), ("beach", "not asked for", 1.0, 2.0)), ["park", "school"])
    after = files_of(space, "points")
    assert sorted((r.category, r.name) for r in space.read("points").collect()) == [("beach", "B"), ("park", "C")]
    assert set(after) == {"category=park", "category=beach"} and after["category=beach"] == before["category=beach"] and after["category=park"] != before["category=park"]


def test_pickup_takes_every_file_once(spark, tmp_path):
    space, folder, checkpoint = space_with_points(spark, tmp_path), tmp_path / "pages", str(tmp_path / "cp")
    save(folder, "one.html")
    save(folder, "two.html", id=2)
    pick_up_pages(space, str(folder), checkpoint, max_files=1).awaitTermination()
    assert set(by_id(space)) == {"1", "2"} and space.read("ledger").count() == 2
    version = current_path(spark, space.path("listings"))
    pick_up_pages(space, str(folder), checkpoint).awaitTermination()
    assert current_path(spark, space.path("listings")) == version
    save(folder, "three.html", id=3)
    pick_up_pages(space, str(folder), checkpoint, with_enrichment=False).awaitTermination()
    assert set(by_id(space)) == {"1", "2", "3"}
    # a replay from scratch meets the ledger and changes nothing
    rows = sorted(map(str, by_id(space).values()))
    pick_up_pages(space, str(folder), str(tmp_path / "cp2"), with_enrichment=False).awaitTermination()
    assert sorted(map(str, by_id(space).values())) == rows


def sheets(spark):
    ratings = spark.createDataFrame(
        [("1", "inspecting", "8", " nice ", ""), ("2", "", "9", "", "x")],
        "listing_id string, status string, ann_rating string, ann_comment string, bo_rating string",
    )
    details = spark.createDataFrame([("1", "FALSE", "12"), ("2", "", "a year")], "listing_id string, `Swimming pool` string, `Lease term (months)` string")
    weights = spark.createDataFrame(
        [("preferred_suburbs_list", "Glebe, Bondi", "", 0), ("bedrooms", "5", "9", 1), ("pool", "", "x", 2), ("preferred_suburbs", "1", "2", 3)],
        "feature string, ann_weight string, bo_weight string, row long",
    )
    filters = spark.createDataFrame(
        [("max_weekly_rent_aud", "550", "", 0), ("pet_friendly_required", "FALSE", "", 1), ("who_knows", "3", "3", 2)],
        "filter string, ann_value string, bo_value string, row long",
    )
    return Edits(ratings, details, weights, filters)


def test_refresh_cycle(spark, tmp_path):
    space, folder, out = space_with_points(spark, tmp_path), tmp_path / "pages", str(tmp_path / "out")
    save(folder, "one.html")
    save(folder, "two.html", id=2, rent=600, beds=4)
    pages = read_pages(spark, str(folder))
    first = refresh(space, pages, Edits(), out, names=["ann", "bo"], with_enrichment=False)
    # people without any preferences count too: everything passes, all alike
    assert {(r["ann_hard_filter_pass"], r["bo_fit_score"]) for r in first.collect()} == {(True, 5.0)}
    report = refresh(space, pages, sheets(spark), out, names=["ann", "bo"], with_enrichment=False)
    rows = {r["listing_id"]: r for r in report.collect()}
    assert rows["1"]["suggested_action"] == "inspecting" and rows["2"]["suggested_action"] == "skip -- hard filter failed (ann)"
    assert (rows["1"]["ann_rating"], rows["1"]["ann_comment"], rows["1"]["bo_rating"]) == (8.0, "nice", None)
    assert by_id(space)["1"]["pool"] == 0 and by_id(space)["1"]["lease_term_months"] == 12
    assert {(r["subject"], r["column_name"], r["action"]) for r in space.read("issues").collect()} == {
        ("2", "lease_term_months", "skipped"), ("bo", "bedrooms", "clamped"), ("bo", "pool", "skipped"),
    }
    ann = next(p for p in stored_preferences(space) if p.person == "ann")
    assert ann.weights == {"bedrooms": 1.0, "preferred_suburbs": 0.2} and ann.suburbs == ["Bondi", "Glebe"]
    assert [(f.kind, f.column, f.value) for f in ann.filters] == [("max", "weekly_rent_aud", 550.0), ("required", "pet_friendly", False)]
    # a correction outlives a fresh reading of its page
    ingest(space, pages, force=True, with_enrichment=False)
    assert by_id(space)["1"]["pool"] == 0 and by_id(space)["2"]["pool"] == 1
    # reading the published sheet back, unedited, corrects nothing
    before = space.read("overrides").count()
    pull_edits(space, Edits(details=read_edits(spark, f"{out}/details")), ["ann", "bo"])
    assert space.read("overrides").count() == before
    # a sheet that is not there leaves preferences alone
    pull_edits(space, Edits(weights=read_edits(spark, f"{out}/nowhere")), ["ann", "bo"])
    assert next(p for p in stored_preferences(space) if p.person == "ann").weights == ann.weights


def test_published_files(spark, tmp_path):
    space, out = space_with_points(spark, tmp_path), str(tmp_path / "out")
    save(tmp_path / "pages", "one.html")
    ingest(space, read_pages(spark, str(tmp_path / "pages")), with_enrichment=False)
    publish_all(space, out)
    cells = spark.read.csv(f"{out}/listings", header=True).collect()
    assert len(cells) == 1 and cells[0]["listing_id"] == "1" and cells[0]["suggested_action"] == "awaiting rating"
    export_csv(space.read("listings"), f"{out}/export")
    exported = spark.read.csv(f"{out}/export", header=True, escape='"').first()
    assert exported["features_raw"] == '["Pool"]'
    stations = spark.createDataFrame([("B", 1.0, 2.0, "train"), ("A", 1.0, 2.0, "metro")], "name string, lat double, lon double, mode string")
    write_stations(stations, f"{out}/stations")
    assert [r["name"] for r in spark.read.csv(f"{out}/stations", header=True).collect()] == ["A", "B"]


def test_half_written_versions_do_not_count(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "space"))
    assert space.read("ratings").count() == 0
    rating = spark.createDataFrame([("1", "ann", 5.0, None, dt.datetime(2026, 1, 1))], space.read("ratings").schema)
    space.write("ratings", rating)
    broken = tmp_path / "space" / "ratings" / "v00000002"
    broken.mkdir()
    assert space.read("ratings").count() == 1
    space.write("ratings", space.read("ratings").withColumn("score", F.col("score") + 1))
    assert current_path(spark, space.path("ratings")).endswith("v00000003") and space.read("ratings").first()["score"] == 6.0
    assert read_ratings(spark, current_path(spark, space.path("ratings"))).count() == 1


def test_older_catalogue_reads(spark, tmp_path):
    path = str(tmp_path / "old")
    spark.createDataFrame([("1", 2)], "listing_id string, bedrooms int").write.parquet(path)
    spark.createDataFrame([("2", "n")], "listing_id string, manual_notes string").write.mode("append").parquet(path)
    rows = {r["listing_id"]: r for r in read_listings(spark, path).collect()}
    assert rows["1"]["bedrooms"] == 2 and rows["2"]["manual_notes"] == "n" and rows["2"]["second_storey"] is None
