"""Numeric column functions: rounding, reading numbers out of text, scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestead import catalog as cat


_WHOLE_NUMBER = r"(?i)^[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"


def round_even(x: Column, places: int) -> Column:
    """Round half to even; Spark's own ``round`` rounds half up."""
    scale = float(10**places)
    return F.rint(x * scale) / scale


def to_number(x: Column) -> Column:
    """Whole-cell number; unreadable text and NaN become null. A cast alone would
    also read the number literals of programming languages, such as ``5d``."""
    text = F.trim(x.cast("string"))
    number = F.when(text.rlike(_WHOLE_NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def first_number_text(text: Column) -> Column:
    found = F.regexp_extract(text, cat.NUMBER_PATTERN, 0)
    return F.when(found != "", found)


def first_float(text: Column) -> Column:
    """First number in the text, thousands separators ignored."""
    return first_number_text(F.regexp_replace(text, ",", "")).try_cast("double")


def first_int(text: Column) -> Column:
    """First number in the text, cut toward zero; a comma ends the number."""
    return first_number_text(text).try_cast("double").try_cast("int")


def min_max_scale(x: Column, lo: Column, hi: Column) -> Column:
    """Scale to 0..1. A missing value, and every value of a flat or empty
    column, is a neutral 0.5."""
    flat = lo.isNull() | hi.isNull() | (lo == hi)
    return F.when(flat, F.lit(0.5)).otherwise(F.coalesce((x - lo) / (hi - lo), F.lit(0.5)))


def duration_minutes(text: Column) -> Column:
    """``'1234s'`` to minutes; anything unreadable is null."""
    return to_number(F.regexp_replace(text, "s+$", "")) / 60.0


def sheet_weight(raw: Column, scale: int = cat.SHEET_WEIGHT_SCALE) -> Column:
    """A -scale..scale sheet entry as a -1..1 weight, held inside the range."""
    value, most = to_number(raw), F.lit(float(scale))
    return F.when(value.isNotNull(), F.least(F.greatest(value, -most), most) / most)
