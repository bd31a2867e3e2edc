"""Column functions that read listing facts out of text.

Patterns carry ``(?U)`` so that word boundaries, digits and white space follow
Unicode, as they do in the saved pages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.functions.numbers import first_float


def strip(text: Column) -> Column:
    """Trim every kind of white space (``trim`` alone only knows blanks)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def trimmed_or_null(text: Column) -> Column:
    return blank_to_null(strip(text))


def _group(text: Column, pattern: str, index: int) -> Column:
    return blank_to_null(F.regexp_extract(text, "(?U)" + pattern, index))


def address_suburb(address: Column, structured: Column) -> Column:
    """Suburb from structured data when present, else from the address line."""
    return F.coalesce(blank_to_null(structured), _group(strip(address), cat.ADDRESS_PATTERN, 2))


def address_postcode(address: Column, structured: Column) -> Column:
    return F.coalesce(blank_to_null(structured), _group(strip(address), cat.ADDRESS_PATTERN, 4))


def price_text(shown: Column, meta_description: Column) -> Column:
    """The shown price, else the first weekly amount of the page summary."""
    return F.coalesce(blank_to_null(shown), _group(meta_description, cat.WEEKLY_PRICE_PATTERN, 0))


def price_value(text: Column) -> Column:
    unpriced = F.lower(text).rlike("|".join(cat.UNPRICED_WORDS))
    return F.when(~unpriced, first_float(text))


def available_from(footer: Column, captured_on: Column) -> Column:
    """A stated date, the capture date for "now", null for impossible dates."""
    stated = _group(footer, cat.AVAILABLE_PATTERN, 1)
    return F.when(stated == "now", captured_on).otherwise(F.try_to_date(stated, "d MMM yyyy"))


def lease_months(text_lower: Column) -> Column:
    """The longest lease the text offers, in months. Number words count as their
    digits; they are read where the patterns want a number, so the text is not
    rewritten first. Years are one digit: of a longer number the last."""
    words = F.create_map(*[F.lit(x) for pair in cat.NUMBER_WORDS.items() for x in pair])
    spelled = r"\b(?:" + "|".join(cat.NUMBER_WORDS) + r")\b"

    def found(pattern: str, digits: str, read, noun: str) -> Column:
        worded = "(?U)" + pattern.replace(f"({digits})", f"({digits}|{spelled})")
        # no pattern matches without its noun, and most texts do not have it
        hits = F.when(text_lower.contains(noun), F.regexp_extract_all(text_lower, F.lit(worded), F.lit(1)))
        numbers = F.transform(hits, lambda hit: read(F.coalesce(F.try_element_at(words, hit), hit)))
        return F.coalesce(numbers, F.array().cast("array<int>"))

    months = [found(p, r"\d{1,2}", lambda n: n.try_cast("int"), "month") for p in cat.LEASE_MONTH_PATTERNS]
    years = found(cat.LEASE_YEAR_PATTERN, r"\d", lambda n: F.right(n, F.lit(1)).try_cast("int") * 12, "year")
    return F.array_max(F.concat(*months, years))


def description_lines(body: Column) -> Column:
    lines = F.transform(F.split(body, r"<br\s*/?>|\n"), strip)
    return F.filter(lines, lambda line: line != "")


def _is_bullet(line: Column) -> Column:
    return line.startswith("-") | line.startswith("•")


def prose(lines: Column) -> Column:
    """All lines that are not bullets as one text; null when there are none."""
    return blank_to_null(F.array_join(F.filter(lines, lambda line: ~_is_bullet(line)), " "))


def bullets(lines: Column) -> Column:
    """Marked lines without their marker, else the sentences of the prose."""
    marked = F.transform(F.filter(lines, _is_bullet), lambda line: F.regexp_replace(line, r"(?U)^[-•]\s*", ""))
    sentences = F.filter(
        F.transform(F.split(F.coalesce(prose(lines), F.lit("")), r"(?U)(?<=[.!?])\s+"), strip),
        lambda sentence: F.length(sentence) > 3,
    )
    found = F.when(F.size(marked) > 0, marked).otherwise(sentences)
    return F.coalesce(found, F.array().cast("array<string>"))


def feature_text(bullet_list: Column, description: Column) -> Column:
    """The lower-case text amenities and lease terms are looked for in."""
    joined = F.coalesce(F.array_join(bullet_list, " | "), F.lit(""))
    return F.concat(F.lower(joined), F.lit(" "), F.lower(F.coalesce(description, F.lit(""))))


def amenity_flag(text_lower: Column, column: str) -> Column:
    """1 where the amenity's pattern matches. Every alternative of a pattern has
    a stretch of plain letters; a text with none of them needs no regex."""
    hints = [text_lower.contains(h) for h in cat.amenity_hints(column)]
    matches = text_lower.rlike(cat.amenity_regex(column))
    if hints:
        hinted = hints[0]
        for h in hints[1:]:
            hinted = hinted | h
        matches = hinted & matches
    return matches.cast("int")


def listing_id(url: Column, source_file: Column) -> Column:
    """Digits that end the canonical address, else the file name's stem."""
    stem = F.regexp_replace(source_file, r"(?<=.)\.[^.]+$", "")
    return F.coalesce(_group(url, cat.URL_ID_PATTERN, 1), stem)
