"""Nearest point of every category for every listing, exactly.

The point set is turned into a *cover*: for each cell that holds listings, the
short list of points that can be nearest to some place in that cell. A listing
then looks up one cell and takes the minimum over that list, so listings are
neither multiplied nor regrouped, and no listing meets every point.

The cover is found by walking two quad trees downwards together, one over the
listing cells and one over the point cells. A pair of cells survives a level
only if the point cell may still hold a nearest point: its least possible
distance must not exceed the least guaranteed distance of any other pair of the
same listing cell. Crowded places simply go deeper until their lists are short,
so one cell holding a third of all points or listings costs levels, not pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.checkpoints import cut
from lodestead.functions.geo import EARTH_RADIUS_KM, haversine_km, haversine_sql

# Tree levels. Level k has 2^k by 2^k cells over longitude and latitude.
STRIDE, BASE_LEVEL, DEEPEST = 3, 9, 27
LEAF_POINTS = 256
# Kilometres added to every bound so that rounding can never drop a candidate.
SLACK_KM = 0.001
# A cover with at most this many candidate entries (about 60 bytes each) is
# sent to all executors; a larger one is joined by key.
BROADCAST_ENTRIES = 1_000_000
# Pairs of cells, or of cells and points, that one task is given to bound and sort (some 200 bytes each).
TASK_PAIRS = 500_000

KNOWN = "(lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon))"


def _cell(lat: str, lon: str) -> tuple[str, str]:
    """SQL for the deepest-level cell of a position. Positions outside the usual
    ranges are first brought back onto the sphere."""
    inside = f"({lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180)"
    on_lat = f"CASE WHEN {inside} THEN {lat} ELSE degrees(asin(sin(radians({lat})))) END"
    half_turn = f"CASE WHEN cos(radians({lat})) < 0 THEN 360D ELSE 180D END"
    on_lon = f"CASE WHEN {inside} THEN {lon} ELSE pmod({lon} + {half_turn}, 360D) - 180D END"
    cells = 2**DEEPEST

    def index(share: str) -> str:
        # the null test matters: "least" passes over nulls
        return f"CASE WHEN {share} IS NOT NULL THEN CAST(least(floor({share} * {cells}D), {cells - 1}) AS int) END"

    return index(f"(({on_lon} + 180D) / 360D)"), index(f"(({on_lat} + 90D) / 180D)")


def _up(column: str, level: int, of: int = DEEPEST) -> str:
    """SQL for a cell coordinate at a coarser level."""
    return f"shiftright({column}, {of - level})"


def _centre(x: str, y: str, level: int) -> tuple[str, str]:
    return f"(({y} + 0.5D) * {180.0 / 2**level!r}D - 90D)", f"(({x} + 0.5D) * {360.0 / 2**level!r}D - 180D)"


def _radius(x: str, y: str, level: int) -> str:
    """SQL for the distance from a cell's centre to its farthest corner."""
    lat, lon = _centre(x, y, level)
    south, north, east = (f"({v} {shift!r}D)" for v, shift in (
        (f"{lat} -", 90.0 / 2**level), (f"{lat} +", 90.0 / 2**level), (f"{lon} +", 180.0 / 2**level)
    ))
    return f"greatest({haversine_sql(lat, lon, south, east)}, {haversine_sql(lat, lon, north, east)})"


def _unit(lat: str, lon: str) -> str:
    """SQL for a position as a point on the unit sphere."""
    return (
        f"struct(cos(radians({lat})) * cos(radians({lon})) AS x, cos(radians({lat})) * sin(radians({lon})) AS y,"
        f" sin(radians({lat})) AS z)"
    )


def _chord(a: str, b: str) -> str:
    """SQL for the straight line between two points of the unit sphere."""
    return f"sqrt({' + '.join(f'({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})' for c in 'xyz')})"


def _arc_km(a: str, b: str) -> str:
    """SQL for the distance of two points of the unit sphere, good to 0.0002 km
    (which ``SLACK_KM`` covers): bounds of pairs need one root and one arc sine
    where all that belongs to one side is a column of that side."""
    return f"({2 * EARTH_RADIUS_KM!r}D * asin(least(1D, {_chord(a, b)} / 2)))"


def distinct_sites(points: DataFrame) -> DataFrame:
    """One row per category and position. Points that share a position are at
    equal distance from everywhere, and of equals the first by name is wanted."""
    return (
        points.where(F.col("category").isin(cat.POI_CATEGORIES)).where(KNOWN)
        .groupBy("category", "lat", "lon")
        .agg(F.min("name").alias("name"))
    )


def _tasks(rows: int) -> int:
    return max(1, -(-rows // TASK_PAIRS))


def _dealt(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``rows`` dealt to ``tasks`` places for a join by ``keys``. A sort-merge join keeps a number of places only if
    the session's own is not greater; otherwise both sides are dealt anew and coalesced by compressed bytes, of
    which pairs have very few."""
    if tasks == 1:
        return rows
    return rows.repartition(max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _walk(pairs: DataFrame, count: int, cells: DataFrame, sites: DataFrame, level: int, to: int) -> tuple[DataFrame, int]:
    """``count`` pairs of ``level`` walked down to the listing cells of level ``to``, and how many survive.
    Many pairs go one level at a time, where a pair makes 16 at most, of which few go on."""
    while level < to:
        step = next((n for n in range(to - level, 1, -1) if count * 16**n <= TASK_PAIRS), 1)
        above, level = level, level + step
        within = cells.selectExpr(f"{_up('x', level, to)} AS x", f"{_up('y', level, to)} AS y").distinct()
        pairs = cut(_descend(pairs, within, sites, above, level, _tasks(count * 16**step)))
        count = pairs.count()
    return pairs, count


def _descend(pairs: DataFrame, cells: DataFrame, sites: DataFrame, above: int, level: int, tasks: int) -> DataFrame:
    """Surviving pairs one step further down both trees. Pairs are dealt to
    ``tasks`` places before they multiply: by the size of what goes in, a few
    cells would all be one task, which then sorts all that comes out."""
    listing_side = cells.selectExpr(
        "x AS cx", "y AS cy", f"{_up('x', above, level)} AS lx", f"{_up('y', above, level)} AS ly",
        f"{_unit(*_centre('x', 'y', level))} AS c", f"{_radius('x', 'y', level)} AS reach",
    )
    # occupied point cells with their size and one real point
    point_side = (
        sites.selectExpr("category", f"{_up('x', level)} AS qx", f"{_up('y', level)} AS qy", "u")
        .groupBy("category", "qx", "qy")
        .agg(F.count("*").alias("n"), F.min("u").alias("sample"))
        .selectExpr(
            "*", f"{_up('qx', above, level)} AS px", f"{_up('qy', above, level)} AS py",
            f"{_unit(*_centre('qx', 'qy', level))} AS q", f"{_radius('qx', 'qy', level)} AS spread",
        )
    )
    bounded = (
        _dealt(pairs.select("category", "lx", "ly", "px", "py", F.col("best").alias("bound")), tasks, "lx", "ly")
        .join(listing_side, ["lx", "ly"])
        .repartition(tasks, "cx", "cy", "category")
        .join(point_side, ["category", "px", "py"])
        .selectExpr(
            "category", "cx AS lx", "cy AS ly", "qx AS px", "qy AS py", "n",
            f"{_arc_km('c', 'q')} - reach - spread AS least", f"{_arc_km('c', 'sample')} + reach AS sure", "bound",
        )
        # what is sure for a cell is sure for its parts, so most pairs end before they are shuffled
        .where(f"least <= bound + {SLACK_KM}D")
    )
    return (
        bounded.selectExpr("*", "least(bound, min(sure) OVER (PARTITION BY lx, ly, category)) AS best")
        .where(f"least <= best + {SLACK_KM}D")
        .select("category", "lx", "ly", "px", "py", "n", "best")
    )


def _leaves(pairs: DataFrame, sites: DataFrame, level: int, tasks: int) -> DataFrame:
    """Candidate points per listing cell and category; ``tasks`` as above."""
    from_cells = pairs.selectExpr(
        "category", "lx", "ly", "px", "py", f"{_unit(*_centre('lx', 'ly', level))} AS c", f"{_radius('lx', 'ly', level)} AS reach"
    )
    inside = sites.selectExpr("category", "name", "lat", "lon", "u", f"{_up('x', level)} AS px", f"{_up('y', level)} AS py")
    return (
        _dealt(from_cells, tasks, "category", "px", "py").join(inside, ["category", "px", "py"])
        .selectExpr("*", f"{_arc_km('c', 'u')} AS km")
        .selectExpr("*", "min(km) OVER (PARTITION BY lx, ly, category) AS best")
        .where(f"km <= best + 2 * reach + {SLACK_KM}D")
        .selectExpr(f"{level} AS depth", "lx AS x", "ly AS y", "category", "name", "lat", "lon")
    )


def _cover(located: DataFrame, sites: DataFrame, leaf_points: int) -> tuple[DataFrame, DataFrame]:
    """The cover, and for each base cell the level its cover is kept at."""
    base_cells = cut(located.selectExpr(f"{_up('x', BASE_LEVEL)} AS x", f"{_up('y', BASE_LEVEL)} AS y").distinct())
    pairs = sites.select("category").distinct().selectExpr("category", "0 AS lx", "0 AS ly", "0 AS px", "0 AS py", "1e9D AS best")
    count, level = len(cat.POI_CATEGORIES), BASE_LEVEL
    for above in range(0, BASE_LEVEL, STRIDE):
        cells = base_cells.selectExpr(f"{_up('x', above + STRIDE, BASE_LEVEL)} AS x", f"{_up('y', above + STRIDE, BASE_LEVEL)} AS y").distinct()
        pairs, count = _walk(pairs, count, cells, sites, above, above + STRIDE)

    leaves, depths = [], []
    while True:
        base = [f"{_up('lx', BASE_LEVEL, level)} AS bx", f"{_up('ly', BASE_LEVEL, level)} AS by"]
        load = (
            pairs.groupBy("lx", "ly", "category").agg(F.sum("n").alias("load"), F.count("*").alias("pairs")).selectExpr(*base, "load", "pairs")
            .groupBy("bx", "by").agg(F.max("load").alias("load"), F.sum("load").alias("entries"), F.sum("pairs").alias("pairs"))
        )
        load = cut(load.withColumn("settled", F.expr("true" if level >= DEEPEST else f"load <= {leaf_points}")))
        entries, still = load.selectExpr("coalesce(sum(entries) FILTER (WHERE settled), 0)", "coalesce(sum(pairs) FILTER (WHERE NOT settled), 0)").first()
        done = load.where("settled").select("bx", "by")
        tagged = pairs.selectExpr("*", *base)
        # at most 4^BASE_LEVEL rows, so sending them everywhere is safe; by key, all pairs of a base cell were one task
        leaves.append(_leaves(tagged.join(F.broadcast(done), ["bx", "by"]), sites, level, _tasks(entries)))
        depths.append(done.withColumn("depth", F.lit(level)))
        if still == 0:
            break
        unsettled = load.where("NOT settled").select("bx", "by")
        deeper = level + STRIDE
        cells = cut(
            located.selectExpr("x", "y", f"{_up('x', BASE_LEVEL)} AS bx", f"{_up('y', BASE_LEVEL)} AS by")
            .join(F.broadcast(unsettled), ["bx", "by"], "left_semi")
            .selectExpr(f"{_up('x', deeper)} AS x", f"{_up('y', deeper)} AS y")
            .distinct()
        )
        pairs = tagged.join(F.broadcast(unsettled), ["bx", "by"], "left_semi")
        pairs, _ = _walk(pairs, still, cells, sites, level, deeper)
        level = deeper

    entries, depth_map = leaves[0], depths[0]
    for more, more_depths in zip(leaves[1:], depths[1:]):
        entries, depth_map = entries.unionByName(more), depth_map.unionByName(more_depths)
    return cut(_as_lists(entries)), depth_map


def _as_lists(entries: DataFrame) -> DataFrame:
    """Candidates as one list per category and cell."""
    lists = [
        F.expr(f"collect_list(CASE WHEN category = '{c}' THEN struct(name, lat, lon, {_unit('lat', 'lon')} AS u) END) AS _{c}") for c in cat.POI_CATEGORIES
    ]
    return entries.groupBy(F.expr("depth AS _depth"), F.expr("x AS _cx"), F.expr("y AS _cy")).agg(*lists)


def _closest(category: str) -> str:
    """SQL for the nearest candidate; of equally near ones the first by name,
    then by position. Straight-line chords, which need no trigonometry per
    candidate, find those within a hair of the nearest; the exact distance
    decides among them. The one-element array gives the shortest chord a name,
    so that it is worked out once and not once per candidate."""
    chord = _chord("p.u", "_u")
    km = haversine_sql("lat", "lon", "p.lat", "p.lon")
    found = f"struct({km} AS km, p.name AS name, p.lat AS lat, p.lon AS lon)"
    nearest = f"array_min(transform(filter(_{category}, p -> {chord} <= shortest + 1E-12D), p -> {found}))"
    return f"transform(array(array_min(transform(_{category}, p -> {chord}))), shortest -> {nearest})[0] AS at_{category}"


def _with_nearest(listings: DataFrame, points: DataFrame, leaf_points: int) -> DataFrame:
    """Listings plus one struct column ``at_<category>`` per category."""
    sites = distinct_sites(points)
    largest = sites.groupBy("category").count().agg(F.max("count")).first()[0] or 0
    x, y = _cell("lat", "lon")
    placed = listings.selectExpr(
        "*", f"CASE WHEN {KNOWN} THEN {x} END AS _x", f"CASE WHEN {KNOWN} THEN {y} END AS _y", f"{_unit('lat', 'lon')} AS _u"
    )
    sent = True
    if largest <= leaf_points:
        # few enough points for the whole sphere to be one cell, that of level 0
        cover = F.broadcast(_as_lists(sites.selectExpr("*", "0 AS depth", f"{_up(x, 0)} AS x", f"{_up(y, 0)} AS y")))
        placed = placed.withColumn("_d", F.lit(0))
    else:
        sites = cut(sites.selectExpr("*", f"{x} AS x", f"{y} AS y", f"{_unit('lat', 'lon')} AS u"))
        # one scan of the listings, however deep the trees go
        located = cut(listings.where(KNOWN).selectExpr(f"{x} AS x", f"{y} AS y").distinct())
        cover, depths = _cover(located, sites, leaf_points)
        sizes = " + ".join(f"size(_{c})" for c in cat.POI_CATEGORIES)
        sent = (cover.selectExpr(f"sum({sizes})").first()[0] or 0) <= BROADCAST_ENTRIES
        if sent:
            cover = F.broadcast(cover)
        # at most 4^BASE_LEVEL rows
        depths = F.broadcast(depths.selectExpr("bx AS _bx", "by AS _by", "depth AS _d"))
        placed = placed.join(depths, F.expr(f"{_up('_x', BASE_LEVEL)} = _bx AND {_up('_y', BASE_LEVEL)} = _by"), "left")
    same_cell = F.expr(f"_d = _depth AND shiftright(_x, {DEEPEST} - _d) = _cx AND shiftright(_y, {DEEPEST} - _d) = _cy")
    if sent:
        found = placed.join(cover, same_cell, "left")
    else:  # without a position there is no cell; such rows would all travel to one task
        nowhere = placed.where("_x IS NULL")
        found = placed.where("_x IS NOT NULL").join(cover, same_cell, "left").unionByName(nowhere, allowMissingColumns=True)
    return found.selectExpr(*[f"`{c}`" for c in listings.columns], *[_closest(c) for c in cat.POI_CATEGORIES])


def nearest_wide(listings: DataFrame, points: DataFrame, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """Listings with ``nearest_<category>`` and ``nearest_<category>_km``. No
    position, or no point of a category, gives nulls."""
    names = {f"nearest_{c}": f"at_{c}.name" for c in cat.POI_CATEGORIES}
    kms = {f"nearest_{c}_km": f"at_{c}.km" for c in cat.POI_CATEGORIES}
    found = {**names, **kms}
    kept = [f"`{c}`" for c in listings.columns if c not in found]
    return _with_nearest(listings, points, leaf_points).selectExpr(*kept, *[f"{v} AS {k}" for k, v in found.items()])


def nearest_long(
    listings: DataFrame, points: DataFrame, leaf_points: int = LEAF_POINTS, keys: tuple[str, ...] = ("listing_id",)
) -> DataFrame:
    """One row per listing and category that has a nearest point."""
    found = _with_nearest(listings.select(*keys, "lat", "lon"), points, leaf_points)
    rows = ", ".join(f"struct('{c}' AS category, at_{c}.name AS name, at_{c}.km AS km)" for c in cat.POI_CATEGORIES)
    return found.selectExpr(*keys, f"inline(array({rows}))").where("name IS NOT NULL")


def pivot_nearest(long: DataFrame) -> DataFrame:
    """Long nearest rows (with optional ``walk_minutes``) to one row per listing."""
    walk = "walk_minutes" if "walk_minutes" in long.columns else None
    values = {"": "name", "_km": "km", **({"_walk_minutes": walk} if walk else {})}
    return long.groupBy("listing_id").agg(
        *[
            F.max(F.when(F.col("category") == c, F.col(source))).alias(f"nearest_{c}{suffix}")
            for suffix, source in values.items()
            for c in cat.POI_CATEGORIES
        ]
    )


def with_anchor_distance(listings: DataFrame, anchor_lat: float | None, anchor_lon: float | None) -> DataFrame:
    """Straight-line distance to a fixed place; null when either is unknown."""
    known = anchor_lat is not None and anchor_lon is not None
    km = haversine_km("lat", "lon", f"{float(anchor_lat)!r}D", f"{float(anchor_lon)!r}D") if known else F.lit(None).cast("double")
    return listings.withColumn("straight_line_km", km)
