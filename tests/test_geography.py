"""Nearest points against brute force, stations, point files."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.operators import enrich, nearest, stations
from lodestead.plans.reference_tables import refresh_places, refresh_stations
from lodestead.plans.workspace import Workspace
from lodestead.sources import points


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0)))


def brute(listings, pois):
    found = {}
    for listing_id, lat, lon in listings:
        if lat is None or lon is None:
            continue
        for c in {p[0] for p in pois}:
            found[listing_id, c] = min((round(km(lat, lon, p[2], p[3]), 9), p[1]) for p in pois if p[0] == c)
    return found


def check(spark, listings, pois, leaf_points):
    left = spark.createDataFrame(listings, "listing_id string, lat double, lon double")
    right = spark.createDataFrame(pois, "category string, name string, lat double, lon double")
    got = nearest.nearest_long(left, right, leaf_points=leaf_points).collect()
    want = brute(listings, pois)
    assert len(got) == len(want)
    for r in got:
        distance, name = want[r["listing_id"], r["category"]]
        assert r["km"] == pytest.approx(distance, abs=1e-6), r
        assert r["name"] == name, (r, distance)


def spread(n, seed, lat0, lat1, lon0, lon1):
    a, b = 48271, 69621
    for i in range(n):
        u = ((i + seed) * a % 65537) / 65537
        v = ((i + seed) * b % 65521) / 65521
        yield lat0 + u * (lat1 - lat0), lon0 + v * (lon1 - lon0)


@pytest.mark.parametrize("leaf_points", [1, 7, 10_000])
def test_one_crowded_place(spark, leaf_points):
    """A third of all points and listings in one block, the rest far around."""
    pois = [("school", f"s{i:04d}", a, b) for i, (a, b) in enumerate(spread(120, 1, -33.9, -33.88, 151.1, 151.13))]
    pois += [("school", f"t{i:04d}", a, b) for i, (a, b) in enumerate(spread(120, 5, -40, -20, 120, 155))]
    pois += [("park", "only park", -33.0, 150.0), ("park", "also here", -33.0, 150.0), ("helipad", "unknown kind", -33.9, 151.1)]
    listings = [(f"a{i}", a, b) for i, (a, b) in enumerate(spread(150, 9, -33.9, -33.88, 151.1, 151.13))]
    listings += [(f"b{i}", a, b) for i, (a, b) in enumerate(spread(150, 3, -45, -10, 110, 160))]
    listings += [("none", None, 151.0), ("same", -33.0, 150.0)]
    check(spark, listings, [p for p in pois if p[0] != "helipad"] if leaf_points > 100 else [p for p in pois if p[0] in cat.POI_CATEGORIES], leaf_points)


def test_pairs_of_a_crowded_place_are_many_tasks(spark, monkeypatch):
    """Few cells go into a step and many pairs come out: these are dealt to tasks before they multiply."""
    monkeypatch.setattr(nearest, "TASK_PAIRS", 2000, raising=False)
    found, cut = [], nearest.cut

    def counted(df):
        out = cut(df)
        if "best" in out.columns:
            found.append([r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()])
        return out

    monkeypatch.setattr(nearest, "cut", counted)
    pois = [("school", f"s{i:04d}", a, b) for i, (a, b) in enumerate(spread(300, 1, -33.9, -33.6, 151.1, 151.6))]
    check(spark, [(f"a{i}", a, b) for i, (a, b) in enumerate(spread(300, 9, -33.9, -33.6, 151.1, 151.6))], pois, 4)
    assert max(map(sum, found)) > 2000
    assert all(len(parts) > 1 and max(parts) <= 2000 for parts in found if sum(parts) > 2000)


def test_sides_that_are_too_large_to_send_stay_dealt(spark):
    """A sort-merge join with pairs of cells runs in the places they were dealt to, not in a few by compressed bytes."""
    cells = spark.createDataFrame([(("park", "school")[x % 2], x, y) for x in range(64) for y in range(64)], "category string, x int, y int")
    pairs = cells.selectExpr("category", "x AS lx", "y AS ly", "x AS px", "y AS py", "1e9D AS best")
    sites = cells.selectExpr("category", "concat('p', x) AS name", "0D AS lat", "0D AS lon", "struct(1D AS x, 0D AS y, 0D AS z) AS u", "x", "y")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "6"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for found, keys in (
            (nearest._descend(pairs, cells, sites, 27, 27, 5), "lx#\\d+, ly#\\d+"),
            (nearest._leaves(pairs, sites, 27, 5), "category#\\d+, px#\\d+, py#\\d+"),
        ):
            found.collect()
            plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
            exchange = next((i for i, row in enumerate(plan) if re.search(rf"Exchange hashpartitioning\({keys}, 6\), REPARTITION_BY_NUM", row)), None)
            assert exchange is not None, "\n".join(plan)
            assert not any("AQEShuffleRead" in row for row in plan[exchange - 2 : exchange])
            assert sum("SortMergeJoin" in row for row in plan) >= 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pairs_do_not_travel_by_base_cell(spark, monkeypatch):
    """There are few base cells, and all pairs of one would be one task."""
    plans, leaves = [], nearest._leaves

    def planned(pairs, *rest):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return leaves(pairs, *rest)

    monkeypatch.setattr(nearest, "_leaves", planned)
    pois = [("park", f"p{i:03d}", a, b) for i, (a, b) in enumerate(spread(20, 3, -33.9, -33.6, 151.1, 151.6))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        check(spark, [(f"a{i}", a, b) for i, (a, b) in enumerate(spread(20, 7, -33.9, -33.6, 151.1, 151.6))], pois, 8)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans and not any("hashpartitioning(bx" in plan for plan in plans)


def test_edges_of_the_map(spark):
    pois = [("park", f"p{i:03d}", a, b) for i, (a, b) in enumerate(spread(60, 2, -89.9, 89.9, -180, 180))]
    pois += [("park", "east", 10.0, 179.99), ("park", "west", 10.0, -179.99), ("park", "pole", 90.0, 0.0), ("park", "corner", -90.0, 180.0)]
    listings = [(f"l{i}", a, b) for i, (a, b) in enumerate(spread(120, 8, -90, 90, -180, 180))]
    listings += [("e", 10.0, 179.999), ("w", 10.2, -179.998), ("n", 89.99, 77.0), ("s", -90.0, -180.0)]
    check(spark, listings, pois, 2)


def test_ties_go_by_name(spark):
    """Many points at one distance and many at one place."""
    ring = [("park", f"r{i:02d}", 0.5 * math.sin(i * math.pi / 20), 0.5 * math.cos(i * math.pi / 20)) for i in range(40)]
    same = [("school", f"copy{i:03d}", 1.0, 1.0) for i in range(200)]
    left = spark.createDataFrame([("x", 0.0, 0.0), ("y", 1.0, 1.0)], "listing_id string, lat double, lon double")
    right = spark.createDataFrame(ring + same, "category string, name string, lat double, lon double")
    rows = {(r["listing_id"], r["category"]): r["name"] for r in nearest.nearest_long(left, right, leaf_points=1).collect()}
    assert rows["x", "school"] == rows["y", "school"] == "copy000"
    assert nearest.distinct_sites(right).where("category = 'school'").count() == 1


def test_no_points(spark):
    left = spark.createDataFrame([("x", 0.0, 0.0)], "listing_id string, lat double, lon double")
    none = spark.createDataFrame([], cat.POINT_SCHEMA)
    assert nearest.nearest_long(left, none).count() == 0
    row = nearest.nearest_wide(left, none).first()
    assert len(row) == 3 + 14 and row["nearest_beach"] is None


def test_listings_are_not_multiplied(spark):
    """No product of listings and points, and no exchange on the listing side."""
    listings = spark.createDataFrame([(f"a{i}", a, b) for i, (a, b) in enumerate(spread(50, 9, -34, -33, 150, 151))], "listing_id string, lat double, lon double")
    pois = spark.createDataFrame([("park", f"p{i}", a, b) for i, (a, b) in enumerate(spread(40, 4, -34, -33, 150, 151))], "category string, name string, lat double, lon double")
    for leaf_points in (2, 100):
        plan = nearest.nearest_wide(listings, pois, leaf_points)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "SortMergeJoin" not in plan


def test_anchor(spark):
    left = spark.createDataFrame([("x", 0.0, 0.0), ("y", None, 0.0)], "listing_id string, lat double, lon double")
    got = {r["listing_id"]: r["straight_line_km"] for r in nearest.with_anchor_distance(left, 0.0, 1.0).collect()}
    assert got["x"] == pytest.approx(km(0, 0, 0, 1)) and got["y"] is None
    assert nearest.with_anchor_distance(left, None, 1.0).first()["straight_line_km"] is None


FEED = {
    "routes.txt": "﻿route_id,agency,route_type\r\nT,a,2\r\nB,a,700\r\nM,a,401\r\n",
    "trips.txt": "route_id,trip_id\nT,t1\nB,b1\nM,m1\n",
    "stop_times.txt": "trip_id,stop_id,seq\nt1,p1,1\nt1,p2,2\nb1,p1,1\nm1,p1,1\nt1,gone,3\nt1,bad,4\nt1,lone,5\n",
    "stops.txt": "stop_id,stop_name,stop_lat,stop_lon,parent_station\np1,Platform 1,-33.1,151.1,C\np2,Platform 2,-33.2,151.2,C\n"
    "C,,-33.5,151.5,\nbad,Bad,x,151,\nlone,\"Lone, Stop\",-34,150,nowhere\n",
}


def write(folder, files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / name).write_text(content, encoding="utf-8", newline="")
    return str(folder)


def test_feed_to_stations(spark, tmp_path):
    feed = points.read_feed(spark, write(tmp_path / "feed", FEED))
    rows = sorted(tuple(r) for r in stations.build_stations(feed).select("name", "lat", "lon", "mode").collect())
    assert rows == [("Lone, Stop", -34.0, 150.0, "train"), ("Platform 1", -33.5, 151.5, "metro"), ("Platform 2", -33.5, 151.5, "train")]


def test_feed_names_missing_files(spark, tmp_path):
    folder = write(tmp_path / "feed", {k: v for k, v in FEED.items() if not k.startswith("stop")})
    with pytest.raises(FileNotFoundError, match="stop_times.txt, stops.txt"):
        points.read_feed(spark, folder)


def test_point_files(spark, tmp_path):
    (tmp_path / "st.csv").write_text("name,lat,lon,mode\r\nA,1,2,train\r\nB,1,2,ferry\r\n")
    (tmp_path / "poi.csv").write_text("name,lat,lon,category\nP,3,4,park\nQ,3,4,zoo\n")
    got = points.read_points(spark, str(tmp_path / "st.csv"), str(tmp_path / "poi.csv")).collect()
    assert sorted(map(tuple, got)) == [("park", "P", 3.0, 4.0), ("train_station", "A", 1.0, 2.0)]
    assert points.read_points(spark, str(tmp_path / "no.csv"), str(tmp_path / "nor.csv")).count() == 0


def elements(*items):
    return json.dumps({"elements": list(items)})


def test_reference_table_builds(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "space"))
    refresh_stations(space, write(tmp_path / "feed", FEED))
    (tmp_path / "school.json").write_text(
        elements({"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "S"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}}, {"type": "way", "id": 3})
    )
    (tmp_path / "park.json").write_text(elements({"type": "node", "id": 9, "lat": 1.0, "lon": 2.0, "tags": {"name": "P"}}))
    refresh_places(space, {"school": str(tmp_path / "school.json"), "park": str(tmp_path / "park.json")})
    got = sorted((r["category"], r["name"]) for r in space.read("points").collect())
    assert ("school", "Unnamed school (way/2)") in got and ("park", "P") in got and len(got) == 6
    (tmp_path / "empty.json").write_text(elements())
    refresh_places(space, {"park": str(tmp_path / "empty.json")})
    got = sorted(r["category"] for r in space.read("points").collect())
    assert "park" not in got and got.count("school") == 2 and len(got) == 5
    assert refresh_places(space, {}).count() == 5


def test_lookups(spark):
    left = spark.createDataFrame([("1", "a", 1.0), ("2", "b", 2.0), ("3", None, 3.0)], "listing_id string, address string, lat double")
    lookup = spark.createDataFrame([("a", 9.0, None)], "address string, lat double, driving_minutes double")
    got = {r["listing_id"]: (r["lat"], r["commute_driving_minutes"]) for r in enrich.with_geo_lookup(left, lookup).collect()}
    assert got == {"1": (9.0, None), "2": (2.0, None), "3": (3.0, None)}
    assert [r["address"] for r in enrich.lookup_misses(left, lookup).collect()] == ["b"]
