"""Reading and canonical text of spreadsheet-like cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestead.functions.numbers import to_number
from lodestead.functions.text import trimmed_or_null

# Date spellings, tried in order, by what a text must look like for any of them to
# read it: a spelling that fails costs far more than the look. Days come before months
# unless the cell is written with dashes; a time of day is ignored.
DATE_FORMATS = [
    (r"^[0-9+-]+$", [
        (r"^[+-]?[0-9]{4,}-", "yyyy-M-d"), (r"-[+-]?[0-9]{4,}$", "M-d-yyyy"), (r"-[+-]?[0-9]{4,}$", "d-M-yyyy"),
    ]),
    (r"^[0-9+/-]+$", [
        (r"/[+-]?[0-9]{4,}$", "d/M/yyyy"), (r"/[+-]?[0-9]{4,}$", "M/d/yyyy"), (r"/[0-9]{2}$", "d/M/yy"), (r"^[+-]?[0-9]{4,}/", "yyyy/M/d"),
    ]),
    (r"^[0-9+-]+ [A-Za-z]+ [0-9+-]+$", [("", "d MMM yyyy"), ("", "d MMMM yyyy")]),
    (r"^[A-Za-z]+ [0-9+-]+, [0-9+-]+$", [("", "MMM d, yyyy"), ("", "MMMM d, yyyy")]),
]
TRUE_WORDS = ["true", "yes", "1"]


def number_cell(raw: Column) -> Column:
    return to_number(trimmed_or_null(raw))


def boolean_cell(raw: Column) -> Column:
    """Null for a blank cell; any text that is not a yes is a no."""
    return F.lower(trimmed_or_null(raw)).isin(TRUE_WORDS)


def list_cell(raw: Column) -> Column:
    """Comma list without blank items; null when nothing is left."""
    items = F.filter(F.transform(F.split(raw, ","), trimmed_or_null), lambda item: item.isNotNull())
    return F.when(F.size(items) > 0, items)


def date_cell(raw: Column) -> Column:
    text = F.regexp_replace(trimmed_or_null(raw), r"[T ]\d{1,2}:.*$", "")

    def read(day: Column) -> Column:
        found = None
        for looks, spellings in DATE_FORMATS:
            tried = F.coalesce(*[F.when(day.rlike(own), F.try_to_date(day, f)) if own else F.try_to_date(day, f) for own, f in spellings])
            found = F.when(day.rlike(looks), tried) if found is None else found.when(day.rlike(looks), tried)
        return found

    # the one-element array gives the text a name, so that it is trimmed once and not once per look
    return F.get(F.transform(F.array(text), read), 0)


def canonical_number(value: Column) -> Column:
    """One spelling per number, so that 12 and 12.0 compare equal."""
    return (value.cast("double") + F.lit(0.0)).cast("string")


def canonical_cell(raw: Column, value_type: str) -> Column:
    """A raw text cell in the spelling stored values use; null if blank or
    unreadable."""
    if value_type == "number":
        return canonical_number(number_cell(raw))
    if value_type == "boolean":
        return canonical_number(boolean_cell(raw).cast("int"))
    if value_type == "date":
        return date_cell(raw).cast("string")
    raise ValueError(f"no stored spelling for a {value_type!r} cell")


def canonical_stored(value: Column, value_type: str) -> Column:
    """A typed table value in the same spelling."""
    return value.cast("string") if value_type == "date" else canonical_number(value)
