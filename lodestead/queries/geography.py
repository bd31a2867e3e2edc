"""Points, stations, nearest points and looked-up geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.operators import enrich, nearest, stations
from lodestead.queries.registry import query
from lodestead.queries.views import run_sql, table, view
from lodestead.sinks.tables import replace_categories, sorted_stations
from lodestead.sources import points

KM_SQL = """6371e0 * 2 * atan2(
  sqrt(pow(sin(radians(p.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - l.lon) / 2), 2)),
  sqrt(1 - (pow(sin(radians(p.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - l.lon) / 2), 2))))"""
NEAREST_SQL = f"""nearest AS (
  SELECT listing_id, category, name, km FROM (
    SELECT listing_id, category, name, {KM_SQL} AS km,
      row_number() OVER (PARTITION BY listing_id, category ORDER BY {KM_SQL}, name, p.lat, p.lon) AS rn
    FROM v_listings l CROSS JOIN v_poi p WHERE l.lat IS NOT NULL
  ) WHERE rn = 1
)"""
LONG_SQL = f"WITH {NEAREST_SQL} SELECT listing_id, category, name, round(km, 6) AS km FROM nearest"
WIDE_SQL = (
    f"WITH {NEAREST_SQL} SELECT l.listing_id, "
    + ", ".join(
        f"max(CASE WHEN category = '{c}' THEN name END) AS nearest_{c}, "
        f"round(max(CASE WHEN category = '{c}' THEN km END), 6) AS nearest_{c}_km"
        for c in cat.POI_CATEGORIES
    )
    + " FROM v_listings l LEFT JOIN nearest n ON l.listing_id = n.listing_id GROUP BY l.listing_id"
)


@query("nearest_long", LONG_SQL)
def nearest_long(spark, sf_dir):
    found = nearest.nearest_long(view(spark, sf_dir, "v_listings", heavy=("part",)), view(spark, sf_dir, "v_poi"))
    return found.withColumn("km", F.round("km", 6))


@query("nearest_wide", WIDE_SQL)
def nearest_wide(spark, sf_dir):
    found = nearest.nearest_wide(view(spark, sf_dir, "v_listings", heavy=("part",)).select("listing_id", "lat", "lon"), view(spark, sf_dir, "v_poi"))
    return found.drop("lat", "lon").withColumns(
        {f"nearest_{c}_km": F.round(f"nearest_{c}_km", 6) for c in cat.POI_CATEGORIES}
    )


@query("nearest_grid", LONG_SQL)
def nearest_grid(spark, sf_dir):
    """The same answer with candidate lists held so short that the trees have
    to be walked."""
    found = nearest.nearest_long(view(spark, sf_dir, "v_listings", heavy=("part",)), view(spark, sf_dir, "v_poi"), leaf_points=12)
    return found.withColumn("km", F.round("km", 6))


@query(
    "nearest_pivot",
    f"WITH {NEAREST_SQL} SELECT listing_id, "
    + ", ".join(
        f"max(CASE WHEN category = '{c}' THEN name END) AS nearest_{c}, "
        f"round(max(CASE WHEN category = '{c}' THEN km END), 6) AS nearest_{c}_km"
        for c in cat.POI_CATEGORIES
    )
    + " FROM nearest GROUP BY listing_id",
)
def nearest_pivot(spark, sf_dir):
    return nearest.pivot_nearest(nearest_long(spark, sf_dir))


@query(
    "anchor_distance",
    f"SELECT l.listing_id, round({KM_SQL}, 6) AS straight_line_km FROM v_listings l, (SELECT -33.87e0 AS lat, 151.2e0 AS lon) p",
)
def anchor_distance(spark, sf_dir):
    listings = nearest.with_anchor_distance(view(spark, sf_dir, "v_listings"), -33.87, 151.2)
    return listings.select("listing_id", F.round("straight_line_km", 6).alias("straight_line_km"))


@query(
    "point_distance",
    f"""SELECT s.s_suppkey AS supplier_id, l.n AS place, round({KM_SQL}, 6) AS km
    FROM (SELECT s_suppkey, CAST(s_suppkey % 170 AS DOUBLE) - 85 AS lat, CAST(s_suppkey * 7 % 360 AS DOUBLE) - 180 AS lon FROM supplier) s
    JOIN (SELECT n_nationkey AS n, CAST(n_nationkey * 5 AS DOUBLE) - 60 AS lat, CAST(n_nationkey * 13 AS DOUBLE) - 160 AS lon FROM nation) l
      ON s.s_suppkey % 25 = l.n
    CROSS JOIN LATERAL (SELECT s.lat AS lat, s.lon AS lon) p""",
)
def point_distance(spark, sf_dir):
    from lodestead.functions.geo import haversine_km

    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"), (F.col("s_suppkey") % 25).cast("int").alias("place"),
        ((F.col("s_suppkey") % 170).cast("double") - 85).alias("lat"), ((F.col("s_suppkey") * 7 % 360).cast("double") - 180).alias("lon"),
    )
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("place"), ((F.col("n_nationkey") * 5).cast("double") - 60).alias("plat"),
        ((F.col("n_nationkey") * 13).cast("double") - 160).alias("plon"),
    )
    km = haversine_km("plat", "plon", "lat", "lon")
    return s.join(n, "place").select("supplier_id", "place", F.round(km, 6).alias("km"))


STOP_MODES_SQL = """stop_modes AS (
  SELECT DISTINCT stop_id, CASE route_type WHEN '2' THEN 'train' WHEN '401' THEN 'metro' ELSE 'light_rail' END AS mode
  FROM v_stop_times JOIN v_trips USING (trip_id) JOIN v_routes USING (route_id) WHERE route_type IN ('2', '401', '900')
)"""
STATIONS_SQL = STOP_MODES_SQL + """, resolved AS (
  SELECT m.mode, s.stop_id, coalesce(p.stop_id, s.stop_id) AS station_id,
    coalesce(nullif(CASE WHEN p.stop_id IS NOT NULL THEN p.stop_name ELSE s.stop_name END, ''), nullif(s.stop_name, ''), s.stop_id) AS name,
    TRY_CAST(CASE WHEN p.stop_id IS NOT NULL THEN p.stop_lat ELSE s.stop_lat END AS DOUBLE) AS lat,
    TRY_CAST(CASE WHEN p.stop_id IS NOT NULL THEN p.stop_lon ELSE s.stop_lon END AS DOUBLE) AS lon
  FROM stop_modes m JOIN v_stops s ON m.stop_id = s.stop_id LEFT JOIN v_stops p ON nullif(s.parent_station, '') = p.stop_id
), stations AS (
  SELECT station_id, arg_max(name, stop_id) AS name, any_value(lat) AS lat, any_value(lon) AS lon, mode
  FROM resolved WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY station_id, mode
)"""


def _feed(spark, sf_dir):
    return {t: view(spark, sf_dir, f"v_{t}") for t in points.FEED_COLUMNS}


@query("stop_modes", f"WITH {STOP_MODES_SQL} SELECT * FROM stop_modes")
def stop_modes(spark, sf_dir):
    feed = _feed(spark, sf_dir)
    return stations.stop_modes(feed["routes"], feed["trips"], feed["stop_times"])


@query("station_build", f"WITH {STATIONS_SQL} SELECT name, lat, lon, mode FROM stations")
def station_build(spark, sf_dir):
    return sorted_stations(stations.build_stations(_feed(spark, sf_dir)))


@query("station_counts", f"WITH {STATIONS_SQL} SELECT mode, count(*) AS n FROM stations GROUP BY mode")
def station_counts(spark, sf_dir):
    return stations.count_by(stations.build_stations(_feed(spark, sf_dir)), "mode")


@query(
    "point_union",
    f"""WITH {STATIONS_SQL} SELECT concat(mode, '_station') AS category, name, lat, lon FROM stations
    UNION ALL SELECT category, name, lat, lon FROM v_poi""",
)
def point_union(spark, sf_dir):
    built = stations.build_stations(_feed(spark, sf_dir)).select("name", "lat", "lon", "mode")
    other = built.select("name", "lat", "lon", F.lit("tram").alias("mode"))
    return points.union_points(built.unionByName(other), view(spark, sf_dir, "v_poi"))


@query("point_counts", "SELECT category, count(*) AS n FROM v_poi GROUP BY category")
def point_counts(spark, sf_dir):
    return stations.count_by(points.place_points(view(spark, sf_dir, "v_poi")), "category")


HALVES = """old AS (SELECT category, concat('old ', name) AS name, lat, lon FROM v_poi),
fresh AS (SELECT category, concat('new ', name) AS name, lat, lon FROM v_poi WHERE category <> 'park')"""


@query(
    "poi_category_replace",
    f"""WITH {HALVES} SELECT * FROM old WHERE category NOT IN ('school', 'park')
    UNION ALL SELECT * FROM fresh WHERE category IN ('school', 'park')""",
)
def poi_category_replace(spark, sf_dir):
    """School is refreshed, park comes back empty, stations are left alone."""
    old = run_sql(spark, sf_dir, f"WITH {HALVES} SELECT * FROM old")
    fresh = run_sql(spark, sf_dir, f"WITH {HALVES} SELECT * FROM fresh")
    return replace_categories(old, fresh, ["school", "park"])


@query(
    "map_elements",
    """SELECT category, CASE WHEN s_suppkey % 4 = 0 THEN concat('Unnamed ', category, ' (', kind, '/', CAST(s_suppkey AS VARCHAR), ')') ELSE s_name END AS name,
      lat, lon FROM (
      SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'way' ELSE 'node' END AS kind, 'school' AS category,
        CAST(s_suppkey % 50 AS DOUBLE) + CASE WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE 0 END AS lat, CAST(s_suppkey % 60 AS DOUBLE) AS lon
      FROM supplier WHERE s_suppkey % 5 <> 0)""",
)
def map_elements(spark, sf_dir):
    """Elements rebuilt from suppliers: nodes, ways, nameless and placeless ones."""
    k = F.col("s_suppkey")
    placed, way = k % 5 != 0, k % 3 == 0
    lat, lon = (k % 50).cast("double"), (k % 60).cast("double")
    elements = table(spark, sf_dir, "supplier").select(
        F.when(way, "way").otherwise("node").alias("type"),
        k.alias("id"),
        F.when(placed, lat).alias("lat"),
        F.when(placed, lon).alias("lon"),
        F.when(way & placed, F.struct((lat + 0.5).alias("lat"), lon.alias("lon"))).alias("center"),
        F.when(k % 4 == 0, F.create_map(F.lit("amenity"), F.lit("school"))).otherwise(
            F.create_map(F.lit("name"), F.col("s_name"))
        ).alias("tags"),
        F.lit("school").alias("category"),
    )
    return points.element_points(elements)


ADDRESSED = "SELECT listing_id, concat('addr ', listing_id) AS address, lat, lon, commute_transit_minutes FROM v_listings"


@query(
    "geo_enrich",
    f"""SELECT listing_id, l.address, coalesce(g.lat, l.lat) AS lat, coalesce(g.lon, l.lon) AS lon, g.driving_minutes AS commute_driving_minutes,
      coalesce(g.transit_minutes, l.commute_transit_minutes) AS commute_transit_minutes
    FROM ({ADDRESSED}) l LEFT JOIN v_geo_lookup g ON l.address = g.address""",
)
def geo_enrich(spark, sf_dir):
    return enrich.with_geo_lookup(run_sql(spark, sf_dir, ADDRESSED), view(spark, sf_dir, "v_geo_lookup"))


@query(
    "geo_misses",
    f"SELECT DISTINCT address FROM ({ADDRESSED}) WHERE address NOT IN (SELECT address FROM v_geo_lookup)",
)
def geo_misses(spark, sf_dir):
    return enrich.lookup_misses(run_sql(spark, sf_dir, ADDRESSED), view(spark, sf_dir, "v_geo_lookup"))


@query(
    "walk_minutes",
    f"""WITH {NEAREST_SQL} SELECT concat('addr ', n.listing_id) AS address, n.category, n.name, round(n.km, 6) AS km,
      round(CASE WHEN duration = 'n/a' THEN NULL ELSE CAST(TRY_CAST(rtrim(duration, 's') AS DOUBLE) / 60 AS DOUBLE) END, 6) AS walk_minutes
    FROM nearest n LEFT JOIN v_walks w ON concat('addr ', n.listing_id) = w.address AND n.category = w.category""",
)
def walk_minutes(spark, sf_dir):
    long = nearest.nearest_long(run_sql(spark, sf_dir, ADDRESSED, heavy=("part",)), view(spark, sf_dir, "v_poi"), keys=("address",))
    walked = enrich.with_walk_minutes(long, view(spark, sf_dir, "v_walks"))
    return walked.withColumns({"km": F.round("km", 6), "walk_minutes": F.round("walk_minutes", 6)})


@query(
    "nearest_rail_walk",
    """SELECT c_custkey AS id, least(
        CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 31 AS DOUBLE) END,
        CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 29 AS DOUBLE) END,
        CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 23 AS DOUBLE) END) AS nearest_rail_walk_minutes FROM customer""",
)
def nearest_rail_walk(spark, sf_dir):
    k = F.col("c_custkey")
    walks = table(spark, sf_dir, "customer").select(
        k.alias("id"),
        *[
            F.when(k % every == 0, (k % by).cast("double")).alias(f"nearest_{c}_walk_minutes")
            for c, every, by in zip(cat.RAIL_CATEGORIES, (2, 3, 5), (31, 29, 23))
        ],
    )
    return enrich.nearest_rail_walk(walks).select("id", "nearest_rail_walk_minutes")
