"""Worked examples of the text rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.functions import cells, numbers, text


def table(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def run(spark, make, values, kind="string"):
    rows = table(spark, values, kind).select("i", make(F.col("v")).alias("out")).orderBy("i").collect()
    return [r["out"] for r in rows]


def test_prices(spark):
    shown = ["$1,150 per week", "Contact Agent", "AUCTION $900", "", None, "POA"]
    assert run(spark, lambda v: text.price_value(v), shown) == [1150.0, None, None, None, None, None]


def test_leases(spark):
    words = [
        "6 months lease only", "12 month lease term", "lease of 12 months", "6 months lease or 12 month term",
        "a two year lease", "eighteen-month tenancy", "leases available", None,
    ]
    assert run(spark, lambda v: text.lease_months(v), words) == [6, 12, 12, 12, 24, 18, None, None]


def test_availability(spark):
    captured = F.lit(dt.date(2026, 7, 1))
    footers = ["Available 30 Sep 2026", "Available now", "Available 31 Feb 2026", "available now", None]
    expected = [dt.date(2026, 9, 30), dt.date(2026, 7, 1), None, None, None]
    assert run(spark, lambda v: text.available_from(v, captured), footers) == expected


@pytest.mark.parametrize(
    "column, words, expected",
    [
        ("furnished", ["unfurnished", "furnished", "part-furnished", "éfurnished"], [0, 1, 1, 0]),
        ("balcony", ["victorian terrace", "rooftop terrace", "back yard"], [0, 1, 1]),
        ("gym", ["gyms nearby", "communal gym"], [0, 1]),
        ("pool", ["poolside", "pool", "carpool"], [0, 1, 0]),
        ("modern_kitchen", ["new kitchen", "stylish open plan kitchen", "new one two three kitchen"], [1, 1, 0]),
    ],
)
def test_amenities(spark, column, words, expected):
    assert run(spark, lambda v: text.amenity_flag(v, column), words) == expected


def test_addresses(spark):
    lines = ["3/22 High St, St Peters, NSW 2044", " 9 Low Rd, Ultimo NSW 2007 ", "Ultimo", None]
    nothing = F.lit(None).cast("string")
    assert run(spark, lambda v: text.address_suburb(v, nothing), lines) == ["St Peters", "Ultimo", None, None]
    assert run(spark, lambda v: text.address_postcode(v, nothing), lines) == ["2044", "2007", None, None]
    assert run(spark, lambda v: text.address_suburb(v, F.lit("Glebe")), lines) == ["Glebe"] * 4
    assert run(spark, lambda v: text.address_suburb(v, F.lit("")), lines[:1]) == ["St Peters"]


def test_listing_ids(spark):
    urls = ["https://x/y-123", "https://x/y-123/", "https://x/y-123?z", None]
    assert run(spark, lambda v: text.listing_id(v, F.lit("a.b.html")), urls) == ["123", "123", "a.b", "a.b"]


def test_numbers(spark):
    words = ["1,200.5 sqm", "-3.9", ".5", "none", None]
    assert run(spark, lambda v: numbers.first_float(v), words) == [1200.5, -3.9, 0.5, None, None]
    assert run(spark, lambda v: numbers.first_int(v), words) == [1, -3, 0, None, None]
    assert run(spark, lambda v: numbers.duration_minutes(v), ["1234s", "90", "x", "", None]) == [1234 / 60, 1.5, None, None, None]


def test_rounding_is_half_even(spark):
    assert run(spark, lambda v: numbers.round_even(v, 1), [0.25, 0.35, 0.75, -0.25], "double") == [0.2, 0.4, 0.8, -0.2]


def test_bullets(spark):
    bodies = ["A flat.<br/>- One\n•Two<br>-", "Nice. Ok.  Really nice!", "", None]
    lines = text.description_lines
    assert run(spark, lambda v: text.bullets(lines(v)), bodies) == [["One", "Two", ""], ["Nice.", "Really nice!"], [], []]
    assert run(spark, lambda v: text.prose(lines(v)), bodies) == ["A flat.", "Nice. Ok.  Really nice!", None, None]


def test_date_spellings_are_tried_only_where_they_can_fit(spark):
    """A try that fails costs far more than a look at the text, and the text is trimmed once for all of them."""
    plan = spark.createDataFrame([("1",)], "v string").select(cells.date_cell(F.col("v")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("nullif(") <= 2  # before: once for each of eleven spellings
    dates = ["-1995-01-13", "1/1/-1995", "+12026-1-2", "2026/1/2", "25/12/95", "13/25/2026", "12-25-2026", "25-12-2026", "5 October 2026", "may 5, 2026", "October 5, 2026", "2026-1/2", "5  Oct 2026"]
    assert run(spark, lambda v: cells.date_cell(v).cast("string"), dates) == [
        "-1995-01-13", "-1995-01-01", "+12026-01-02", "2026-01-02", "2095-12-25", None, "2026-12-25", "2026-12-25", "2026-10-05", "2026-05-05", "2026-10-05", None, None,
    ]


def test_cells(spark):
    dates = ["2026-09-30", "30/09/2026", " 5 Oct 2026 ", "2026-09-30 00:00:00", "soon", "", "09/30/2026", "3/4/26"]
    day = dt.date(2026, 9, 30)
    assert run(spark, lambda v: cells.date_cell(v), dates) == [day, day, dt.date(2026, 10, 5), day, None, None, day, dt.date(2026, 4, 3)]
    assert run(spark, lambda v: cells.boolean_cell(v), ["TRUE", " yes ", "1", "no", "", "x"]) == [True, True, True, False, None, False]
    assert run(spark, lambda v: cells.list_cell(v), ["a, b ,,", " , ", "", None]) == [["a", "b"], None, None, None]
    assert run(spark, lambda v: cells.number_cell(v), [" 12 ", "nan", "x", ""]) == [12.0, None, None, None]


def test_sheet_weights(spark):
    assert run(spark, lambda v: numbers.sheet_weight(v), ["7", "-9", "2.5", "abc", "", "nan"]) == [1.0, -1.0, 0.5, None, None, None]


def test_catalogue_shape():
    assert len(cat.CORE_COLUMNS) == 26 and len(cat.AMENITY_COLUMNS) == 16 and len(cat.POI_COLUMNS) == 21
    assert len(cat.LISTING_COLUMNS) == 63
    labels = [label for label, _ in cat.DETAIL_COLUMNS.values()]
    assert len(labels) == len(set(labels)) == 21
    assert set(cat.AMENITY_COLUMNS) <= set(cat.DETAIL_COLUMNS)
