"""Page walking and whole-page extraction."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestead.operators.extract import coverage, extract
from lodestead.operators.locate import FIELDS, _walk
from lodestead.sources.pages import read_pages

BITS = [
    "<", ">", "<!", "<![", "<![x[", "<![CDATA[", "]]>", "<!--", "-->", "--!>", "<?", "</", "</p>", "<p>", "<p/>", "&", "&#", "&#x;", "&amp", ";", "a", " ", "\n",
    "<script>", "</script>", "<style>", "<title>", "<textarea>", "<template>", '<ul class="property-info__primary-features">', "<li aria-label=", '"', "'",
    "<h1 class=property-info-address>", "</h1>", '<script type="application/ld+json">', "{", "<meta name=og:title content=x>", "<a b=c b=d>", "\x00", "é",
]

FULL = """<!DOCTYPE html><html><head>
<title>x</title><script>var a = "<h1 class='property-info-address'>no</h1>";</script>
<link rel="canonical" href="https://homes.example/property-unit-nsw-glebe-4242">
<meta property="og:title" content="wrong"><meta name="og:title" content="right">
<meta property="og:description" content="Cosy home.&lt;br/&gt;- Air con&lt;br/&gt;- Pets considered">
<script type="application/ld+json">{broken</script>
<script type="application/ld+json">[{"a": 1}, {"address": {"addressLocality": "Glebe", "postalCode": "2037"}}]</script>
</head><body>
<h1 class="big property-info-address">12 Bay St, <span>Glebe</span>, NSW 2037</h1>
<ul class="property-info__primary-features"><li aria-label="3 bedrooms"><li aria-label="1 bathroom"><li aria-label="Land size 1,250.5 m2"></ul>
<div class="property-info__property-attributes">3 <b>1</b><span> &bull; </span><p>Townhouse<p>x</div>
<p class="property-info__footer-content">Available <b>now</b></p>
<!-- <span class="property-price">$1</span> -->
<span class="property-price">$1,150 per week</span>
</body></html>"""


def page(spark, html, name="page-7.html"):
    pages = spark.createDataFrame([(name, html, dt.date(2026, 7, 1))], "source_file string, html string, captured_on date")
    return extract(pages).first()


def walked(html):
    return dict(zip(FIELDS, _walk(html)))


def test_full_page(spark):
    row = page(spark, FULL)
    assert row["listing_id"] == "4242"
    assert row["address"] == "12 Bay St,Glebe, NSW 2037"
    assert (row["suburb"], row["postcode"]) == ("Glebe", "2037")
    assert (row["bedrooms"], row["bathrooms"], row["parking_spaces"]) == (3, 1, 0)
    assert (row["land_size_sqm"], row["floor_size_sqm"]) == (1250.5, None)
    assert row["property_type"] == "Townhouse"
    assert row["weekly_rent_aud"] == 1150.0
    assert row["available_from"] == dt.date(2026, 7, 1)
    assert row["features_raw"] == ["Air con", "Pets considered"]
    assert row["description"] == "Cosy home."
    assert (row["air_conditioning"], row["pet_friendly"], row["pool"]) == (1, 1, 0)


def test_empty_pages(spark):
    for html in ("", None, "<html", "plain text", "<p>unclosed <b>markup"):
        row = page(spark, html)
        assert row["listing_id"] == "page-7" and row["address"] is None and row["parking_spaces"] is None
        assert row["features_raw"] == [] and row["air_conditioning"] == 0


def test_meta_name_beats_property():
    assert walked(FULL)["og_title"] == "right"
    assert walked('<meta name="og:title"><meta property="og:title" content="p">')["og_title"] is None
    assert walked('<meta property="og:title" content="p">')["og_title"] == "p"


def test_text_nodes():
    found = walked('<div class="property-price"> $9 <b>00</b><script>1</script><br>pw</div><div class="property-price">$1</div>')
    assert found["price"] == ["$9", "00", "pw"]
    assert walked("<span class='property-price-x'>1</span>")["price"] is None
    assert walked("<div data-testid=PropertyDescription>a<br>b</div>")["body"] == ["a", "b"]


def test_labels_only_inside_the_list():
    html = '<li aria-label="9 bathrooms"></li><ul class="property-info__primary-features"><li><li aria-label="2 beds"></ul><li aria-label="x">'
    assert walked(html)["labels"] == ["", "2 beds"]
    assert walked("<ul></ul>")["labels"] is None


def test_price_from_summary_and_contact(spark):
    assert page(spark, '<meta name="description" content="Only $1,150.50 per week now">')["weekly_rent_aud"] == 1150.5
    assert page(spark, '<span class="property-price">Contact</span><meta name="description" content="$9 per week">')["weekly_rent_aud"] is None


def test_coverage(spark):
    pages = spark.createDataFrame(
        [("a.html", FULL, dt.date(2026, 7, 1)), ("b.html", "", dt.date(2026, 7, 1))], "source_file string, html string, captured_on date"
    )
    counts = {r["field"]: (r["missing"], r["total"]) for r in coverage(extract(pages)).collect()}
    assert counts == {f: (1, 2) for f in ("address", "property_type", "bedrooms", "bathrooms", "weekly_rent_aud")}


def test_one_python_pass(spark):
    pages = spark.createDataFrame([("a.html", FULL, dt.date(2026, 7, 1))], "source_file string, html string, captured_on date")
    plan = extract(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_reading_files(spark, tmp_path):
    (tmp_path / "b c.html").write_bytes("Café <h1 class=property-info-address>".encode() + b"\xff\xfe1 X St</h1>")
    (tmp_path / "a.htm").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    rows = {r["source_file"]: r for r in read_pages(spark, str(tmp_path)).collect()}
    assert set(rows) == {"b c.html", "a.htm"}
    assert rows["b c.html"]["html"] == "Café <h1 class=property-info-address>1 X St</h1>"
    assert extract(read_pages(spark, str(tmp_path))).where("source_file = 'b c.html'").first()["address"] == "1 X St"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=25))
def test_no_markup_breaks_the_walk(bits):
    assert len(_walk("".join(bits))) == len(FIELDS)


def test_pages_go_to_python_in_small_batches(spark):
    """However many rows a session's batches have, a worker holds few whole pages at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", "500"), ("0", "500"), ("20", "20")):
            spark.conf.set(key, given)
            pages = spark.createDataFrame([("a.html", "<p>x</p>", None)], "source_file string, html string, captured_on date")
            assert extract(pages).count() == 1
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)
