"""Exact medians of many columns without gathering any column in one task."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
# The range around the middle that is looked into first, and the accuracy of its ends.
NEAR = 0.01
ACCURACY = 1000


@dataclass
class _Search:
    """Looking for the value of one rank among the values in ``[lo, hi]``."""

    column: str
    rank: int
    lo: float
    hi: float


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Median per column over its known values, the mean of the middle two when
    their number is even; null for a column without any. Approximate percentiles
    around the middle, a count of what is below and between them, and histograms
    of that narrow range: a few passes for a table of any size."""
    if not columns:
        return {}
    values = df.select(*[_finite(F.col(c).cast("double")).alias(c) for c in columns])
    near = [0.5 - NEAR, 0.5 + NEAR]
    stats = values.agg(
        *[
            a
            for c in columns
            for a in (
                F.count(c).alias(f"{c}_n"),
                F.min(c).alias(f"{c}_lo"),
                F.max(c).alias(f"{c}_hi"),
                F.percentile_approx(c, near, ACCURACY).alias(f"{c}_near"),
            )
        ]
    ).first()
    known = [c for c in columns if stats[f"{c}_n"]]
    if not known:
        return dict.fromkeys(columns)
    ranges = {c: stats[f"{c}_near"] for c in known}
    counts = values.agg(
        *[
            a
            for c, (lo, hi) in ranges.items()
            for a in (F.count_if(F.col(c) < lo).alias(f"{c}_below"), F.count_if(F.col(c).between(lo, hi)).alias(f"{c}_in"))
        ]
    ).first()

    def start(c: str, rank: int) -> _Search:
        below, within = counts[f"{c}_below"], counts[f"{c}_in"]
        if below <= rank < below + within:
            return _Search(c, rank - below, *ranges[c])
        return _Search(c, rank, stats[f"{c}_lo"], stats[f"{c}_hi"])  # the percentiles missed the middle

    searches = {c: [start(c, rank) for rank in ((stats[f"{c}_n"] - 1) // 2, stats[f"{c}_n"] // 2)] for c in known}
    while open_searches := [s for pair in searches.values() for s in pair if s.lo < s.hi]:
        _narrow(values, open_searches)
    middle = {c: [_restored(s.lo) for s in pair] for c, pair in searches.items()}
    return {c: middle[c][0] / 2 + middle[c][1] / 2 if c in middle else None for c in columns}


def _finite(x: Column) -> Column:
    """NaN as unknown, and the infinities as the ends of the finite numbers, so
    that every range has a width."""
    largest = F.lit(sys.float_info.max)
    return F.when(x > largest, F.when(~F.isnan(x), largest)).when(x < -largest, -largest).otherwise(x)


def _restored(x: float | None) -> float | None:
    return x if x is None or abs(x) < sys.float_info.max else math.copysign(math.inf, x)


def _narrow(values: DataFrame, searches: list[_Search]) -> None:
    """One pass: a histogram of every open range, then each search moves into
    the bin its rank falls in. The two middle ranks of a column mostly share
    their range. A pass sends back at most ``BINS`` rows per range, and a range
    is a thousandth of what it was or holds one value."""
    ranges = list(dict.fromkeys((s.column, s.lo, s.hi) for s in searches))

    def entry(i: int, column: str, lo: float, hi: float) -> Column:
        x = F.col(column)
        # halves where the width itself would overflow
        scale = 0.5 if math.isinf(hi - lo) else 1.0
        share = (x * scale - F.lit(lo * scale)) / F.lit(hi * scale - lo * scale) * BINS
        bin_ = F.least(F.floor(share), F.lit(BINS - 1)).cast("int")
        return F.when(x.between(lo, hi), F.struct(F.lit(i).alias("i"), bin_.alias("bin"), x.alias("x")))

    entries = F.array_compact(F.array(*[entry(i, *r) for i, r in enumerate(ranges)]))
    bins = (
        values.select(F.inline(entries))
        .groupBy("i", "bin")
        .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .orderBy("i", "bin")
        .collect()
    )
    for search in searches:
        mine = ranges.index((search.column, search.lo, search.hi))
        for row in bins:
            if row["i"] != mine:
                continue
            if search.rank < row["n"]:
                search.lo, search.hi = row["lo"], row["hi"]
                break
            search.rank -= row["n"]
