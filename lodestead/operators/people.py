"""Filters and fit scores of people who are rows, not columns.

Preferences stay three long tables. Each person becomes one profile row (rules and
weights in their written order, liked suburbs), profiles are dealt to blocks, and every
listing meets every block once by its number; what is said about a listing and a person is
worked out on that row. The plan has the same size for any number of people, nothing
of theirs passes the driver but the names of the columns they use, and a person's range of
scores is a grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.checkpoints import cut
from lodestead.functions.numbers import min_max_scale, round_even
from lodestead.operators.merge import is_small
from lodestead.operators.score import NUMERIC_KINDS, _known, _name, _numeric, _one_row, feature_ranges
from lodestead.sources.preferences import EXAMPLE_PERSON, FILTER_PREFIXES, FILTER_SCHEMA, REQUIRED_SUFFIX, SUBURB_SCHEMA, WEIGHT_SCHEMA, Preferences

#: People of one block.
BLOCK = 200


def tables_of(spark, preferences: list[Preferences]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Preferences in memory as the tables of filters, weights, suburbs and people."""
    prefix = {kind: p for p, kind in FILTER_PREFIXES.items()}
    filters, weights, suburbs = [], [], []
    for p in preferences:
        for i, r in enumerate(p.filters):
            key = f"{r.column}{REQUIRED_SUFFIX}" if r.kind == "required" else f"{prefix[r.kind]}{r.column}"
            on = r.value if isinstance(r.value, bool) else None
            num = float(r.value) if isinstance(r.value, (int, float)) and on is None else None
            values = [str(v) for v in r.value] if isinstance(r.value, (list, tuple)) else None
            text = r.value if isinstance(r.value, str) else None
            filters.append((p.person, key, num, text, values, on, i))
        weights += [(p.person, f, None if w is None else float(w), i) for i, (f, w) in enumerate(p.weights.items())]
        suburbs += [(p.person, s) for s in p.suburbs]
    rows = ((filters, FILTER_SCHEMA), (weights, WEIGHT_SCHEMA), (suburbs, SUBURB_SCHEMA), ([(p.person,) for p in preferences], "person string"))
    return tuple(spark.createDataFrame(r, schema) for r, schema in rows)


def rules_of(filters: DataFrame) -> DataFrame:
    """Filters with ``kind`` and ``column`` from their keys; prefixes are looked at before the
    suffix, and any other key is an error when its row is read."""
    key, kind, column = F.col("key"), None, None
    for prefix, name in FILTER_PREFIXES.items():
        is_it, rest = key.startswith(prefix), F.substring(key, len(prefix) + 1, 1 << 20)
        kind = F.when(is_it, name) if kind is None else kind.when(is_it, name)
        column = F.when(is_it, rest) if column is None else column.when(is_it, rest)
    required = key.endswith(REQUIRED_SUFFIX)
    wrong = F.raise_error(F.concat(F.lit("unknown hard filter "), F.coalesce(key, F.lit("null")))).cast("string")
    named = F.expr(f"left(key, length(key) - {len(REQUIRED_SUFFIX)})")
    return filters.withColumn("kind", kind.when(required, "required").otherwise(wrong)).withColumn("column", column.when(required, named))


def unknown_columns(filters: DataFrame, columns: list[str]) -> DataFrame:
    """Rules on columns that a table does not have: they never fail (or, when required, always do)."""
    return rules_of(filters).where((F.col("person") != EXAMPLE_PERSON) & ~F.col("column").isin(columns)).select("person", "kind", "column")


def _present(name: str, kind: str) -> str:
    value = _known(name, kind)
    if kind == "string":
        return f"{value} <> ''"
    if kind.startswith("array"):
        return f"size({value}) > 0"
    if kind in ("date", "timestamp"):
        return f"{value} IS NOT NULL"
    return value if kind == "boolean" else f"{value} <> 0"


def _cell(name: str, kind: str) -> Column:
    """What rules look at: the value as a number or as text, as it is shown, and whether it is there."""
    text = f"CAST({_name(name)} AS string)" if kind in ("string", "date", "timestamp") else "CAST(NULL AS string)"
    number = _numeric({name: kind}, name) if kind in NUMERIC_KINDS else "CAST(NULL AS double)"
    shown = "CAST(NULL AS string)" if kind.startswith(("array", "map", "struct")) else f"CAST({_known(name, kind)} AS string)"
    sort = "number" if kind in NUMERIC_KINDS else kind if kind in ("string", "date", "timestamp") else "other"
    return F.expr(f"named_struct('sort', '{sort}', 'num', {number}, 'text', {text}, 'shown', {shown}, 'there', coalesce({_present(name, kind)}, false))")


def _quoted(value: Column) -> Column:
    mark = F.when(value.contains("'") & ~value.contains('"'), '"').otherwise("'")
    return F.concat(mark, value, mark)


def _failure(rule: Column, cells: Column) -> Column:
    """Why the listing fails the rule, null where it passes. A missing value passes every rule but ``required``; so does
    that of a column the table does not have (a rule's ``place`` is then null)."""
    cell = F.get(cells, rule["place"])
    sort, name, kind = cell["sort"], rule["column"], rule["kind"]
    on = F.coalesce(rule["num"] != 0, rule["text"] != "", F.size(rule["list"]) > 0, rule["on"], F.lit(False))
    required = F.when(on & ~F.coalesce(cell["there"], F.lit(False)), F.concat(name, F.lit(" required but missing/false")))

    limit = F.coalesce(rule["num"].cast("string"), rule["text"])
    number = F.coalesce(rule["num"], rule["text"].try_cast("double"))
    text = F.when(sort == "date", limit.try_cast("date").cast("string")).when(sort == "timestamp", limit.try_cast("timestamp").cast("string")).otherwise(limit)
    above = F.when(sort == "number", cell["num"] > number).otherwise(cell["text"] > text)
    below = F.when(sort == "number", cell["num"] < number).otherwise(cell["text"] < text)
    told = lambda sign: F.concat(name, F.lit(" = "), cell["shown"], F.lit(f" {sign} "), limit)

    listed = F.when(sort == "string", F.array_contains(rule["list"], cell["text"])).when(sort == "number", F.exists(rule["list"], lambda v: v.try_cast("double") == cell["num"]))
    values = F.when(sort == "string", F.transform(rule["list"], _quoted)).otherwise(F.transform(rule["list"], lambda v: v.try_cast("double").cast("string")))
    shown = F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))
    own = F.concat(name, F.lit(" = "), F.when(sort == "string", _quoted(cell["text"])).otherwise(cell["shown"]))
    some = F.coalesce(F.size(rule["list"]) > 0, F.lit(False))
    return (
        F.when(kind == "required", required)
        .when((kind == "max") & above, told("> max")).when((kind == "min") & below, told("< min"))
        .when((kind == "allowed") & some & ~listed, F.concat(own, F.lit(" not in allowed "), shown))
        .when((kind == "excluded") & some & listed, F.concat(own, F.lit(" is in excluded list "), shown))
    )


def profiles_of(filters: DataFrame, weights: DataFrame, suburbs: DataFrame, people: DataFrame | None, ruled: list[str], weighted: list[str]) -> DataFrame:
    """One row a person: ``rules`` and ``weights`` in their order, and ``suburbs``. ``ruled`` and ``weighted`` are the columns
    whose places rules and weights get; -1 is the place of the preferred suburbs."""

    def place(column: str, names: list[str]) -> Column:
        return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col(column)), F.lit(0)).cast("int") - 1

    names = filters.select("person").union(weights.select("person")).union(suburbs.select("person"))
    names = (names if people is None else names.union(people.select("person"))).where(F.col("person") != EXAMPLE_PERSON).distinct()
    kept = ["pos", "kind", "column", "num", "text", "list", "on"]
    rules = rules_of(filters).withColumn("place", place("column", ruled)).groupBy("person").agg(F.array_sort(F.collect_list(F.struct(*kept, "place"))).alias("rules"))
    spot = F.when(F.col("feature") == cat.PREFERRED_SUBURBS_FEATURE, -1).otherwise(place("feature", weighted))
    own = weights.groupBy("person", "feature").agg(F.min("pos").alias("pos"), F.max_by("weight", "pos").alias("weight"))
    own = own.withColumn("place", spot).where((F.col("weight") != 0) & ~F.isnan("weight") & F.col("place").isNotNull())
    own = own.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("pos", "place", "weight"))).alias("weights"))
    liked = suburbs.groupBy("person").agg(F.collect_set("suburb").alias("suburbs"))
    return names.join(rules, "person", "left").join(own, "person", "left").join(liked, "person", "left")


def _met(listings: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Every listing with every profile."""
    spread = listings.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return spread.join(blocks, "block").withColumn("p", F.explode("profiles")).drop("profiles", "block")


def score_people(listings: DataFrame, filters: DataFrame, weights: DataFrame, suburbs: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """``listing_id``, ``person``, ``hard_filter_pass``, ``hard_filter_reasons``, ``raw_score`` and ``fit_score`` for every listing and
    person (the example person is left out). No people, no rows."""
    kinds = dict(listings.dtypes)
    columns = list(kinds)
    named = rules_of(filters).select(F.lit("rule").alias("use"), F.col("column").alias("name")).union(weights.select(F.lit("weight"), "feature"))
    used = {(r[0], r[1]) for r in named.where(F.col("name").isin(columns)).distinct().collect()}
    ruled, weighted = (sorted(n for use, n in used if use == u) for u in ("rule", "weight"))
    profiles = profiles_of(filters, weights, suburbs, people, ruled, weighted)
    n_blocks = max(1, -(-profiles.select("person").count() // BLOCK))
    block = F.pmod(F.xxhash64("person"), F.lit(n_blocks)).cast("int").alias("block")
    blocks = cut(profiles.groupBy(block).agg(F.collect_list(F.struct(*profiles.columns)).alias("profiles")))
    # ranges of scores are smaller than the profiles
    send = F.broadcast if is_small(blocks) else (lambda df: df)
    blocks = send(blocks)

    scaled = [f for f in weighted if f not in cat.BOOLEAN_COLUMNS]
    ranges = _one_row(feature_ranges(listings, scaled)) if scaled else F.lit(None)

    def value(feature: str) -> Column:
        x = F.expr(_numeric(kinds, feature))
        if feature in cat.BOOLEAN_COLUMNS:
            return F.coalesce(x, F.lit(0.5))
        lo, hi = F.col(f"_ranges.`{feature}_lo`"), F.col(f"_ranges.`{feature}_hi`")
        return F.when(hi > lo, F.coalesce((x - lo) / (hi - lo), F.lit(0.5))).otherwise(F.lit(0.5))

    suburb = F.col("suburb") if "suburb" in columns else F.lit(None).cast("string")
    ranged = listings.withColumn("_ranges", ranges)
    values = F.array(*[value(f) for f in weighted]).cast("array<double>").alias("values")
    cells = (F.array(*[_cell(c, kinds[c]) for c in ruled]) if ruled else F.expr("CAST(array() AS array<struct<sort: string, num: double, text: string, shown: string, there: boolean>>)")).alias("cells")

    def term(total: Column, w: Column) -> Column:
        liked = F.when(F.coalesce(F.array_contains(F.col("p.suburbs"), F.col("suburb")), F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))
        return total + w["weight"] * F.when(w["place"] == -1, liked).otherwise(F.get(F.col("values"), w["place"]))

    raw = F.coalesce(F.aggregate("p.weights", F.lit(0.0), term), F.lit(0.0)).alias("raw_score")
    short = _met(ranged.select(suburb.alias("suburb"), values), blocks, n_blocks)
    spans = short.select(F.col("p.person").alias("person"), raw).groupBy("person").agg(F.min("raw_score").alias("_lo"), F.max("raw_score").alias("_hi"))
    whole = _met(ranged.select("listing_id", suburb.alias("suburb"), values, cells), blocks, n_blocks)
    told = F.filter(F.transform("p.rules", lambda r: _failure(r, F.col("cells"))), lambda x: x.isNotNull())
    reasons = F.coalesce(F.array_join(told, "; "), F.lit("")).alias("hard_filter_reasons")
    rows = whole.select("listing_id", F.col("p.person").alias("person"), reasons, raw).join(send(spans), "person")
    fit = round_even(min_max_scale(F.col("raw_score"), F.col("_lo"), F.col("_hi")) * 10.0, 1)
    return rows.select("listing_id", "person", (F.col("hard_filter_reasons") == "").alias("hard_filter_pass"), "hard_filter_reasons", "raw_score", fit.alias("fit_score"))
