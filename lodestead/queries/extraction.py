"""Page extraction: listing pages rendered from tables and read back, real
noisy pages, and the text rules over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.functions import numbers as nb
from lodestead.functions import text as tx
from lodestead.operators import extract as ex
from lodestead.queries.registry import query
from lodestead.queries.views import run_sql, table, view
from lodestead.sources.tables import conform

# What a page says, by key k. One text per fact; the page below shows them and
# the twin reads them directly.
FACTS = {
    "street": "concat(CAST(k AS STRING), ' Example St')",
    "suburb": "concat('Old ', CASE WHEN k % 3 = 0 THEN 'Glebe' ELSE 'Newtown Park' END)",
    "postcode": "CAST(2000 + k % 900 AS STRING)",
    "kind": "CASE k % 3 WHEN 0 THEN 'House' WHEN 1 THEN 'Apartment & Unit' ELSE NULL END",
    "bedrooms": "CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN NULL ELSE CAST(k % 5 AS INT) END",
    "bathrooms": "CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k % 3 + 1 AS INT) END",
    "parking": "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN 0 ELSE CAST(k % 4 AS INT) END",
    "land": "CASE WHEN k % 7 <> 0 AND k % 4 = 1 THEN CAST(1200 + k % 99 AS DOUBLE) + 0.5 END",
    "floor": "CASE WHEN k % 7 <> 0 AND k % 6 = 1 THEN CAST(80 + k % 50 AS DOUBLE) END",
    "rent": "CASE k % 5 WHEN 0 THEN 1000 + CAST(k % 800 AS DOUBLE) WHEN 1 THEN 400 + CAST(k % 500 AS DOUBLE) + 0.5 END",
    "lease": "CASE k % 4 WHEN 0 THEN 12 WHEN 1 THEN 24 WHEN 2 THEN 6 END",
    "available": "CASE k % 4 WHEN 0 THEN DATE '2026-08-01' WHEN 1 THEN DATE '2026-10-05' END",
}
# Structured data: none; one block; a broken block then a list; an address that
# is no object. The second kind names a suburb the address line does not.
PAGE_SQL = """SELECT k, CAST(concat('page-', CAST(k AS STRING), '.html') AS STRING) AS source_file, DATE '2026-08-01' AS captured_on, concat(
  CASE k % 4 WHEN 1 THEN concat('<script type="application/ld+json">{{"@type":"Place","address":{{"addressLocality":"', suburb, '","postalCode":"', postcode, '"}}}}</script>')
    WHEN 2 THEN concat('<script type="application/ld+json">{{"address": oops</script><script type="application/ld+json"></script><script type="application/ld+json">[{{"x":1}},{{"address":{{"addressLocality":"Structured Bay","postalCode":', postcode, '}}}}]</script>')
    WHEN 3 THEN '<script type="application/ld+json">{{"address":"plain text"}}</script>' ELSE '' END,
  CASE WHEN k % 6 = 0 THEN '' ELSE concat('<link rel="canonical" href="https://homes.example/rent-', CASE WHEN k % 6 = 1 THEN 'house' ELSE concat('house-', CAST(k + 5000000 AS STRING), CASE WHEN k % 2 = 0 THEN '/' ELSE '' END) END, '">') END,
  '<meta name="description" content="', CASE WHEN k % 5 = 1 THEN concat('For rent at $', CAST(rent AS STRING), ' per week &amp; bills') ELSE 'For rent' END, '">',
  '<meta property="og:title" content="', street, ', ', suburb, ', NSW ', postcode, '">',
  CASE WHEN k % 5 = 4 THEN '' ELSE concat('<meta property="og:description" content="', body, '">') END,
  CASE WHEN k % 2 = 0 THEN concat('<h1 class="title property-info-address"> ', street, ', <b>', suburb, ', NSW ', postcode, '</b></h1>') ELSE '<h1>Other heading</h1>' END,
  CASE WHEN k % 7 = 0 THEN '' ELSE concat('<ul class="property-info__primary-features">', CASE WHEN bedrooms IS NULL THEN '' ELSE concat('<li aria-label="9 bedrooms"><li aria-label="', CAST(bedrooms AS STRING), ' Bedrooms">') END,
    '<li aria-label="', CAST(bathrooms AS STRING), ' bathroom"></li>', CASE WHEN k % 3 = 0 THEN '' ELSE concat('<li aria-label="', CAST(parking AS STRING), ' car spaces"></li>') END,
    CASE WHEN land IS NULL THEN '' ELSE concat('<li aria-label="Land size 1,', CAST(land - 1000 AS STRING), ' sqm"></li>') END,
    CASE WHEN floor IS NULL THEN '' ELSE concat('<li aria-label="Building size ', CAST(floor AS STRING), ' sqm"></li>') END, '<li>icon</li></ul><li aria-label="7 bathrooms"></li>') END,
  CASE WHEN kind IS NULL THEN '<div class="property-info__property-attributes"><span>3</span></div>' ELSE concat('<div class="property-info__property-attributes"><span>3</span><i>2<!-- x --></i><span>•</span><p>', replace(kind, '&', '&amp;'), '<p>more</div>') END,
  '<div class="property-info__footer-content">', CASE k % 4 WHEN 0 THEN '<b>Available</b> <i>now</i>' WHEN 1 THEN 'Available 5 Oct 2026' WHEN 2 THEN 'Available 31 Feb 2026' ELSE 'Call us' END, '</div>',
  CASE k % 5 WHEN 0 THEN concat('<span class="x property-price">$1,', substr(CAST(CAST(rent AS INT) AS STRING), 2), ' per week</span>') WHEN 2 THEN '<span class="property-price">Contact Agent $900</span>' ELSE '' END,
  CASE WHEN k % 5 = 4 THEN concat('<div data-testid="PropertyDescription">Quiet home. ', lease_words, '<br>- near <b>the</b> lawn</div>') ELSE '' END
) AS markup FROM facts"""
BODY = "CASE k % 3 WHEN 0 THEN concat('Sunny home.&lt;br/&gt;- Reverse cycle air&lt;br /&gt;• Dishwasher&lt;BR&gt;&#10;', lease_words) ELSE concat('Unfurnished flat! ', lease_words, ' Ok.  A stylish new kitchen?') END"
LEASE_WORDS = "CASE k % 4 WHEN 0 THEN 'A twelve month lease or 6 months term.' WHEN 1 THEN 'Lease of 9 months, or 2 year lease.' WHEN 2 THEN 'six-month tenancy only.' ELSE 'Ask about lease terms.' END"


def _facts(source: str, more: str = "") -> str:
    facts = ", ".join(f"{expression} AS {name}" for name, expression in FACTS.items())
    worded = f"SELECT k, {more}{facts}, {LEASE_WORDS} AS lease_words FROM ({source})"
    return f"SELECT *, {BODY} AS body FROM ({worded})"


LISTING_KEYS = "SELECT p_partkey AS k FROM part"
PAGE_KEYS = "SELECT page_id AS k FROM pages"


def _pages(keys: str, more: str = "") -> str:
    return f"WITH facts AS ({_facts(keys, more)}) {PAGE_SQL.replace('SELECT k,', f'SELECT k, {more}', 1)}"


def _twin(keys: str) -> str:
    return f"""WITH facts AS ({_facts(keys).replace('STRING', 'VARCHAR')})
    SELECT CASE WHEN k % 6 < 2 THEN concat('page-', CAST(k AS VARCHAR)) ELSE CAST(k + 5000000 AS VARCHAR) END AS listing_id,
      CASE WHEN k % 6 = 0 THEN NULL ELSE concat('https://homes.example/rent-', CASE WHEN k % 6 = 1 THEN 'house' ELSE concat('house-', CAST(k + 5000000 AS VARCHAR), CASE WHEN k % 2 = 0 THEN '/' ELSE '' END) END) END AS url,
      concat(street, CASE WHEN k % 2 = 0 THEN ',' ELSE ', ' END, suburb, ', NSW ', postcode) AS address,
      CASE WHEN k % 4 = 2 THEN 'Structured Bay' ELSE suburb END AS suburb, postcode, kind AS property_type, bedrooms, bathrooms, parking AS parking_spaces,
      land AS land_size_sqm, floor AS floor_size_sqm, rent AS weekly_rent_aud, lease AS lease_term_months, available AS available_from,
      CASE WHEN k % 5 = 4 THEN 'near' WHEN k % 3 = 0 THEN 'Reverse cycle air | Dishwasher<BR>'
        ELSE concat_ws(' | ', 'Unfurnished flat!', lease_words, 'A stylish new kitchen?') END AS bullets,
      CASE WHEN k % 5 <> 4 AND k % 3 = 0 THEN 1 ELSE 0 END AS air_conditioning, CASE WHEN k % 5 <> 4 AND k % 3 = 0 THEN 1 ELSE 0 END AS dishwasher,
      CASE WHEN k % 5 = 4 THEN 1 ELSE 0 END AS balcony, 0 AS furnished, CASE WHEN k % 5 <> 4 AND k % 3 <> 0 THEN 1 ELSE 0 END AS modern_kitchen,
      CASE WHEN k % 5 <> 4 AND k % 3 = 0 THEN 1 ELSE 0 END AS natural_light FROM facts"""


SHOWN = [
    "listing_id", "url", "address", "suburb", "postcode", "property_type", "bedrooms", "bathrooms", "parking_spaces", "land_size_sqm",
    "floor_size_sqm", "weekly_rent_aud", "lease_term_months", "available_from", "bullets", "air_conditioning", "dishwasher", "balcony",
    "furnished", "modern_kitchen", "natural_light",
]


def _shown(listings):
    return listings.withColumn("bullets", F.array_join("features_raw", " | ")).select(*SHOWN)


@query("extract_rendered", _twin(LISTING_KEYS))
def extract_rendered(spark, sf_dir):
    """One rendered page per part, read back."""
    pages = run_sql(spark, sf_dir, _pages(LISTING_KEYS), heavy=("part",)).withColumnRenamed("markup", "html")
    return _shown(ex.extract(pages))


@query("extract_noisy_pages", _twin(PAGE_KEYS))
def extract_noisy_pages(spark, sf_dir):
    """The same facts planted in the real pages, noise and all."""
    # the facts are functions of the key, so they are put on the page's own row
    planted = run_sql(spark, sf_dir, _pages("SELECT page_id AS k, html AS page FROM pages", "page, "), heavy=("pages",))
    pages = planted.withColumn("html", F.replace("page", F.lit("<article>"), F.concat(F.lit("<article>"), F.col("markup"))))
    return _shown(ex.extract(pages))


@query(
    "page_locate",
    """SELECT concat('page-', CAST(page_id AS VARCHAR)) AS listing_id, 0 AS known_fields, 0 AS bullets, 0 AS amenities FROM pages""",
)
def page_locate(spark, sf_dir):
    """Real pages that hold no listing at all: nothing must be made up."""
    pages = table(spark, sf_dir, "pages", heavy=True).select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("source_file"),
        "html",
        F.current_date().alias("captured_on"),
    )
    found = ex.extract(pages)
    made_up = [c for c in ex.EXTRACTED_COLUMNS if c not in ("listing_id", "source_file", "features_raw")]
    return found.select(
        "listing_id",
        sum(F.col(c).isNotNull().cast("int") for c in made_up).alias("known_fields"),
        F.size("features_raw").alias("bullets"),
        sum(F.col(c) for c in cat.AMENITY_COLUMNS).alias("amenities"),
    )


@query(
    "extract_coverage",
    """SELECT 'address' AS field, count(*) AS missing, count(*) AS total FROM v_listings
    UNION ALL SELECT 'property_type', count(*) FILTER (WHERE property_type IS NULL), count(*) FROM v_listings
    UNION ALL SELECT 'bedrooms', count(*) FILTER (WHERE bedrooms IS NULL), count(*) FROM v_listings
    UNION ALL SELECT 'bathrooms', count(*) FILTER (WHERE bathrooms IS NULL), count(*) FROM v_listings
    UNION ALL SELECT 'weekly_rent_aud', count(*) FILTER (WHERE weekly_rent_aud IS NULL), count(*) FROM v_listings""",
)
def extract_coverage(spark, sf_dir):
    return ex.coverage(conform(view(spark, sf_dir, "v_listings")))


# --- text rules over whole documents ------------------------------------------

# Every document gets one phrase, from a different amenity by its id.
PHRASES = [
    "A/C throughout", "built-in robes", "dishwasher", "rooftop terrace", "pool table", "residents gym", "lock-up garage", "unfurnished",
    "pets considered", "sun room", "north-facing", "video entry", "flyscreens", "renovated open-plan kitchen", "new ensuite", "upstairs",
    "Victorian terrace", "furnished", "two storey", "poolside gyms",
]
DOC_TEXT = "concat(text, ' ', CASE doc_id % " + str(len(PHRASES)) + " " + " ".join(
    f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)
) + " END)"
DOCS = f"SELECT doc_id, {DOC_TEXT} AS text FROM documents"


def _re2(column: str) -> str:
    """The amenity pattern with its boundary spelled out for all of Unicode."""
    alternatives = "|".join(cat.AMENITY_PATTERNS[column]).replace("'", "''")
    return f"(^|[^\\p{{L}}\\p{{N}}_])(?:{alternatives})"


@query(
    "extract_amenities",
    "SELECT doc_id, " + ", ".join(
        f"CAST(regexp_matches(lower(text), '{_re2(c)}') AS INT) AS {c}" for c in cat.AMENITY_COLUMNS
    ) + f" FROM ({DOCS})",
)
def extract_amenities(spark, sf_dir):
    docs = run_sql(spark, sf_dir, DOCS, heavy=("documents",)).select("doc_id", F.lower("text").alias("words"))
    return docs.select("doc_id", *ex.amenity_flags(F.col("words")))


SPACE = r"^\s+|\s+$"
# A third of the documents has its lines marked as bullets.
LINED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), concat('<br/>', chr(10), ' - ')) ELSE text END AS text FROM documents"


@query(
    "extract_bullets",
    f"""WITH lined AS ({LINED}), lines AS (
      SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '<br\\s*/?>|\\n'), lambda x: regexp_replace(x, '{SPACE}', '', 'g')), lambda x: x <> '') AS ls FROM lined
    ), split AS (
      SELECT doc_id, list_transform(list_filter(ls, lambda x: x[1] IN ('-', '•')), lambda x: regexp_replace(x, '^[-•]\\s*', '')) AS marked,
        array_to_string(list_filter(ls, lambda x: x[1] NOT IN ('-', '•')), ' ') AS prose FROM lines
    ), found AS (
      SELECT doc_id, nullif(prose, '') AS prose, CASE WHEN len(marked) > 0 THEN marked ELSE
        list_filter(list_transform(string_split(regexp_replace(prose, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '{SPACE}', '', 'g')), lambda x: length(x) > 3) END AS bullets FROM split
    ) SELECT doc_id, CAST(len(bullets) AS INT) AS n, md5(array_to_string(bullets, '|')) AS bullets, md5(prose) AS prose,
      md5(concat(lower(array_to_string(bullets, ' | ')), ' ', lower(coalesce(prose, '')))) AS feature_text FROM found""",
)
def extract_bullets(spark, sf_dir):
    lines = run_sql(spark, sf_dir, LINED, heavy=("documents",)).select("doc_id", tx.description_lines(F.col("text")).alias("lines"))
    found = lines.select("doc_id", tx.bullets(F.col("lines")).alias("b"), tx.prose(F.col("lines")).alias("p"))
    return found.select(
        "doc_id",
        F.size("b").alias("n"),
        F.md5(F.array_join("b", "|")).alias("bullets"),
        F.md5("p").alias("prose"),
        F.md5(tx.feature_text(F.col("b"), F.col("p"))).alias("feature_text"),
    )


LEASES = """SELECT doc_id, concat(text, CASE doc_id % 8 WHEN 0 THEN ' 6 months lease only' WHEN 1 THEN ' twelve month fixed lease' WHEN 2 THEN ' lease of 12 months'
  WHEN 3 THEN ' 2 year lease or 18 month term' WHEN 4 THEN ' tenancy term of nine-months' WHEN 5 THEN ' twelvemonth lease' WHEN 6 THEN ' a 3-month or six  months tenancy' ELSE '' END) AS text FROM documents"""


def _worded(text: str) -> str:
    for word, digits in cat.NUMBER_WORDS.items():
        text = f"regexp_replace({text}, '\\b{word}\\b', '{digits}', 'g')"
    return text


@query(
    "extract_lease_terms",
    f"""SELECT doc_id, CAST(list_max(list_concat(list_concat(
        list_transform(regexp_extract_all(t, '{cat.LEASE_MONTH_PATTERNS[0]}', 1), lambda x: CAST(x AS INT)),
        list_transform(regexp_extract_all(t, '{cat.LEASE_MONTH_PATTERNS[1]}', 1), lambda x: CAST(x AS INT))),
        list_transform(regexp_extract_all(t, '{cat.LEASE_YEAR_PATTERN}', 1), lambda x: CAST(x AS INT) * 12))) AS INT) AS lease_term_months
      FROM (SELECT doc_id, {_worded('lower(text)')} AS t FROM ({LEASES}))""",
)
def extract_lease_terms(spark, sf_dir):
    return run_sql(spark, sf_dir, LEASES, heavy=("documents",)).select("doc_id", tx.lease_months(F.lower("text")).alias("lease_term_months"))


PRICES = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat('$1,', CAST(100 + o_orderkey % 800 AS STRING), ' per week')
  WHEN 1 THEN 'Contact Agent' WHEN 2 THEN concat('AUCTION $', CAST(o_orderkey AS STRING)) WHEN 3 THEN concat('from ', CAST(o_orderkey % 900 AS STRING), '.50 pw')
  WHEN 4 THEN 'POA' ELSE '' END AS shown,
  CASE WHEN o_orderkey % 4 < 2 THEN concat('Home for $', CAST(300 + o_orderkey % 99 AS STRING), '.25 per week, was $9') ELSE 'Home' END AS summary FROM orders"""


@query(
    "extract_prices",
    """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 1100e0 + o_orderkey % 800 WHEN 3 THEN o_orderkey % 900 + 0.5e0
      WHEN 5 THEN CASE WHEN o_orderkey % 4 < 2 THEN 300.25e0 + o_orderkey % 99 END END AS weekly_rent_aud FROM orders""",
)
def extract_prices(spark, sf_dir):
    prices = run_sql(spark, sf_dir, PRICES)
    return prices.select("id", tx.price_value(tx.price_text(F.col("shown"), F.col("summary"))).alias("weekly_rent_aud"))


NUMBERS = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN concat('Land 1,', CAST(200 + o_orderkey % 700 AS STRING), '.75 sqm') WHEN 1 THEN concat('-', CAST(o_orderkey % 90 AS STRING), '.9 below 7')
  WHEN 2 THEN 'no number' WHEN 3 THEN concat(CAST(o_orderkey % 9 AS STRING), ' bedrooms') ELSE concat('about .5 of ', CAST(o_orderkey AS STRING)) END AS words FROM orders"""


@query(
    "extract_numbers",
    """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 1200.75e0 + o_orderkey % 700 WHEN 1 THEN CAST(concat('-', CAST(o_orderkey % 90 AS VARCHAR), '.9') AS DOUBLE)
      WHEN 3 THEN CAST(o_orderkey % 9 AS DOUBLE) WHEN 4 THEN 0.5e0 END AS as_float,
      CAST(CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN -(o_orderkey % 90) WHEN 3 THEN o_orderkey % 9 WHEN 4 THEN 0 END AS INT) AS as_int FROM orders""",
)
def extract_numbers(spark, sf_dir):
    words = run_sql(spark, sf_dir, NUMBERS)
    return words.select("id", nb.first_float(F.col("words")).alias("as_float"), nb.first_int(F.col("words")).alias("as_int"))


FOOTERS = """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS captured_on, CASE o_orderkey % 5 WHEN 0 THEN 'Property Available now, call'
  WHEN 1 THEN concat('Available ', date_format(o_orderdate, 'd MMM yyyy'), ' or later') WHEN 2 THEN 'Available 31 Feb 2026' WHEN 3 THEN 'available soon'
  ELSE concat('Available  ', date_format(o_orderdate, 'dd MMM yyyy')) END AS footer FROM orders"""


@query(
    "extract_availability",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 IN (0, 1, 4) THEN CAST(o_orderdate AS DATE) END AS available_from FROM orders",
)
def extract_availability(spark, sf_dir):
    footers = run_sql(spark, sf_dir, FOOTERS)
    return footers.select("id", tx.available_from(F.col("footer"), F.col("captured_on")).alias("available_from"))


LINKS = """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN concat('https://homes.example/a-b-', CAST(c_custkey AS STRING)) WHEN 1 THEN concat('https://homes.example/x-12-', CAST(c_custkey AS STRING), '/')
  WHEN 2 THEN 'https://homes.example/plain' ELSE NULL END AS url, concat('saved.', c_name, '.htm') AS source_file,
  CASE c_custkey % 3 WHEN 0 THEN concat(' ', CAST(c_custkey AS STRING), ' High St, St Peters NSW 2044 ') WHEN 1 THEN concat('Unit 1, ', CAST(c_custkey AS STRING), ' Low Rd, Ultimo, VIC 3007') ELSE 'somewhere' END AS address,
  CASE WHEN c_custkey % 5 = 0 THEN 'Told' WHEN c_custkey % 5 = 1 THEN '' END AS told FROM customer"""


@query(
    "extract_identity",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 < 2 THEN CAST(c_custkey AS VARCHAR) ELSE concat('saved.', c_name) END AS listing_id,
      CASE WHEN c_custkey % 5 = 0 THEN 'Told' WHEN c_custkey % 3 = 0 THEN 'St Peters' WHEN c_custkey % 3 = 1 THEN 'Ultimo' END AS suburb,
      CASE c_custkey % 3 WHEN 0 THEN '2044' WHEN 1 THEN '3007' END AS postcode FROM customer""",
)
def extract_identity(spark, sf_dir):
    """Listing ids out of addresses or file names; suburbs and postcodes."""
    rows = run_sql(spark, sf_dir, LINKS)
    return rows.select(
        "id",
        tx.listing_id(F.col("url"), F.col("source_file")).alias("listing_id"),
        tx.address_suburb(F.col("address"), F.col("told")).alias("suburb"),
        tx.address_postcode(F.col("address"), F.lit(None).cast("string")).alias("postcode"),
    )
