"""Hard filters and fit scores, as expressions over the listing columns that the
preferences name. Nothing is joined and nothing but two one-row aggregates is
shuffled: feature ranges, then raw-score ranges.

Expressions are written as SQL text: one person's score is a sum of dozens of
terms, and a text reaches the session in one call."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.functions.numbers import min_max_scale, round_even
from lodestead.sources.preferences import HardFilter, Preferences

NUMERIC_KINDS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "void")


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(value: float) -> str:
    return f"{float(value)!r}D"


def _known(column: str, kind: str) -> str:
    """A column with NaN taken for missing."""
    return f"nanvl({_name(column)}, NULL)" if kind in ("double", "float") else _name(column)


def _threshold(value: object, kind: str) -> str:
    if kind in ("string", "date", "timestamp"):
        return f"CAST({_text(str(value))} AS {kind})"
    return _number(value)


def _quoted(column: str) -> str:
    """Text in the quotes a list shows it in."""
    mark = f"CASE WHEN contains({column}, '\\'') AND NOT contains({column}, '\"') THEN '\"' ELSE '\\'' END"
    return f"concat({mark}, {column}, {mark})"


def filter_failure(kinds: dict[str, str], rule: HardFilter) -> str | None:
    """SQL for why a listing fails the rule, null where it passes. ``kinds`` are
    the table's column types. A missing value passes every rule but
    ``required``; a column the table does not have is a missing value. None for
    a rule that nothing can fail."""
    name, kind = rule.column, kinds.get(rule.column)
    if rule.kind == "required":
        if not rule.value:
            return None
        told = _text(f"{name} required but missing/false")
        if kind is None:
            return told
        value = _known(name, kind)
        if kind == "string":
            present = f"{value} <> ''"
        elif kind.startswith("array"):
            present = f"size({value}) > 0"
        elif kind == "boolean":
            present = value
        elif kind in ("date", "timestamp"):
            present = f"{value} IS NOT NULL"
        else:
            present = f"{value} <> 0"
        return f"CASE WHEN NOT coalesce({present}, false) THEN {told} END"
    if kind is None or rule.value is None:
        return None
    value = _known(name, kind)
    if rule.kind in ("max", "min"):
        sign = ">" if rule.kind == "max" else "<"
        limit = str(float(rule.value)) if isinstance(rule.value, (int, float)) else str(rule.value)
        told = f"concat({_text(f'{name} = ')}, CAST({value} AS string), {_text(f' {sign} {rule.kind} {limit}')})"
        return f"CASE WHEN {value} {sign} {_threshold(rule.value, kind)} THEN {told} END"
    values = list(rule.value)
    if not values:
        return None
    shown = [str(v) for v in values] if kind == "string" else [float(v) for v in values]
    listed = f"{value} IN ({', '.join(_text(v) if kind == 'string' else _number(v) for v in shown)})"
    fails, words = (f"NOT {listed}", "not in allowed") if rule.kind == "allowed" else (listed, "is in excluded list")
    told = _quoted(value) if kind == "string" else f"CAST({value} AS string)"
    return f"CASE WHEN {fails} THEN concat({_text(f'{name} = ')}, {told}, {_text(f' {words} {shown}')}) END"


def failure_reasons(kinds: dict[str, str], rules: list[HardFilter]) -> str:
    """SQL for all failures in rule order, joined; empty when everything passes."""
    reasons = [r for r in (filter_failure(kinds, rule) for rule in rules) if r]
    return f"concat_ws('; ', {', '.join(reasons)})" if reasons else "''"


def unknown_columns(listings: DataFrame, preferences: list[Preferences]) -> DataFrame:
    """Rules on columns the table does not have: they never fail (or, when
    required, always do), which is nearly always a slip worth telling."""
    rows = [
        (p.person, r.kind, r.column)
        for p in preferences
        for r in p.filters
        if r.column not in listings.columns
    ]
    return listings.sparkSession.createDataFrame(rows, "person string, kind string, column string")


def _numeric(kinds: dict[str, str], name: str) -> str:
    """A column as a number; text that is no number, and dates, are missing."""
    kind = kinds[name]
    if kind in NUMERIC_KINDS:
        return f"nanvl(CAST({_name(name)} AS double), NULL)"
    return f"nanvl(try_cast(trim({_name(name)}) AS double), NULL)" if kind == "string" else "CAST(NULL AS double)"


def _weighted(kinds: dict[str, str], person: Preferences) -> list[tuple[str, float]]:
    return [
        (f, w)
        for f, w in person.weights.items()
        if w and not math.isnan(w) and (f == cat.PREFERRED_SUBURBS_FEATURE or f in kinds)
    ]


def scaled_features(kinds: dict[str, str], preferences: list[Preferences]) -> list[str]:
    """Columns that some person's weights scale by the range of the data."""
    named = {f for p in preferences for f, _ in _weighted(kinds, p)}
    return sorted(named - set(cat.BOOLEAN_COLUMNS) - {cat.PREFERRED_SUBURBS_FEATURE})


def feature_ranges(listings: DataFrame, features: list[str]) -> DataFrame:
    """One row with ``<feature>_lo`` and ``<feature>_hi`` over the whole table."""
    kinds = dict(listings.dtypes)
    return listings.selectExpr(
        *[f"{end}({_numeric(kinds, f)}) AS {_name(f'{f}_{side}')}" for f in features for end, side in (("min", "lo"), ("max", "hi"))]
    )


def _one_row(df: DataFrame) -> Column:
    return df.select(F.struct("*").alias("row")).scalar()


def raw_score(kinds: dict[str, str], person: Preferences, ranges: str) -> str:
    """SQL for the sum of weight times value, in the order the weights are
    written. ``ranges`` names the struct column with the feature ranges."""
    terms = ["0.0D"]
    for feature, weight in _weighted(kinds, person):
        if feature == cat.PREFERRED_SUBURBS_FEATURE:
            liked = ", ".join(_text(s) for s in person.suburbs)
            value = f"CASE WHEN suburb IN ({liked}) THEN 1.0D ELSE 0.0D END" if liked else "0.0D"
        elif feature in cat.BOOLEAN_COLUMNS:
            value = f"coalesce({_numeric(kinds, feature)}, 0.5D)"
        else:
            x, lo, hi = _numeric(kinds, feature), f"{ranges}.{_name(f'{feature}_lo')}", f"{ranges}.{_name(f'{feature}_hi')}"
            value = f"CASE WHEN {hi} > {lo} THEN coalesce(({x} - {lo}) / ({hi} - {lo}), 0.5D) ELSE 0.5D END"
        terms.append(f"{_number(weight)} * {value}")
    return " + ".join(terms)


def score_wide(listings: DataFrame, preferences: list[Preferences], population: DataFrame | None = None) -> DataFrame:
    """Listings plus, per person, ``<p>_hard_filter_pass``,
    ``<p>_hard_filter_reasons``, ``<p>_raw_score`` and ``<p>_fit_score``. Where
    the listings carry the results of costly steps, ``population`` is the same
    table without them, and the ranges are taken from there."""
    if not preferences:
        return listings
    kinds = dict(listings.dtypes)
    features = scaled_features(kinds, preferences)
    population = listings if population is None else population
    ranges = _one_row(feature_ranges(population, features)) if features else F.lit(None)

    def ranged(df: DataFrame) -> DataFrame:
        # the row becomes one column, so its subquery is planned and run once
        return df.withColumn("_ranges", ranges)

    raws = {p.person: f"{raw_score(kinds, p, '_ranges')} AS {_name(f'{p.person}_raw_score')}" for p in preferences}
    spans = ranged(population).selectExpr(*raws.values()).selectExpr(
        *[
            f"{end}({_name(f'{p}_raw_score')}) AS {_name(f'{p}_{side}')}"
            for p in raws
            for end, side in (("min", "lo"), ("max", "hi"))
        ]
    )
    reasons = [f"{failure_reasons(kinds, p.filters)} AS {_name(f'{p.person}_hard_filter_reasons')}" for p in preferences]
    scored = ranged(listings).selectExpr(*map(_name, kinds), *reasons, *raws.values()).withColumn("_span", _one_row(spans))
    out = {}
    for p in raws:
        scaled = min_max_scale(F.col(f"{p}_raw_score"), F.col(f"_span.{p}_lo"), F.col(f"_span.{p}_hi"))
        out[f"{p}_hard_filter_pass"] = F.col(f"{p}_hard_filter_reasons") == ""
        out[f"{p}_fit_score"] = round_even(scaled * 10.0, 1)
    return scored.withColumns(out).drop("_span")


SCORE_FIELDS = ["hard_filter_pass", "hard_filter_reasons", "raw_score", "fit_score"]


def scores_long(wide: DataFrame, names: list[str]) -> DataFrame:
    """Wide scores as one row per listing and person."""
    rows = F.array(
        *[F.struct(F.lit(p).alias("person"), *[F.col(f"{p}_{f}").alias(f) for f in SCORE_FIELDS]) for p in names]
    )
    return wide.select("listing_id", F.inline(rows))


def score_all(listings: DataFrame, preferences: list[Preferences]) -> DataFrame:
    return scores_long(score_wide(listings, preferences), [p.person for p in preferences])


def harmonic_mean(scores: list[Column]) -> Column:
    """Mean that a single low score drags down; any zero makes it zero."""
    if not scores:
        return F.lit(None).cast("double")
    reciprocals = F.lit(0.0)
    for s in scores:
        reciprocals = reciprocals + F.try_divide(F.lit(1.0), s)
    return F.when(F.least(*scores, F.lit(math.inf)) == 0, F.lit(0.0)).otherwise(
        round_even(F.lit(float(len(scores))) / reciprocals, 1)
    )


def combined_fit(long: DataFrame) -> DataFrame:
    """The same mean over long scores, for any number of people."""
    zero = F.min("fit_score") == 0
    reciprocals = F.sum(F.try_divide(F.lit(1.0), F.col("fit_score")))
    mean = round_even(F.count("fit_score") / reciprocals, 1)
    return long.groupBy("listing_id").agg(F.when(zero, F.lit(0.0)).otherwise(mean).alias("combined_fit_score"))
