"""Saved pages to listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.functions import text as tx
from lodestead.functions.numbers import first_float, first_int
from lodestead.operators.locate import locate

EXTRACTED_COLUMNS = [
    "listing_id", "url", "address", "suburb", "postcode", "property_type", "bedrooms", "bathrooms",
    "parking_spaces", "land_size_sqm", "floor_size_sqm", "features_raw", "description", "weekly_rent_aud",
    "lease_term_months", "available_from", "source_file",
]
# Pages that go to a Python worker at once: whole documents, of which ten thousand would be held together.
BATCH_PAGES = 500
COVERAGE_FIELDS = ["address", "property_type", "bedrooms", "bathrooms", "weekly_rent_aud"]

# Feature labels in the order they are tried, and how each value is read.
LABEL_KINDS = [
    ("bedrooms", ["bedroom"], first_int),
    ("bathrooms", ["bathroom"], first_int),
    ("parking_spaces", ["car space", "carspace"], first_int),
    ("land_size_sqm", ["land size"], first_float),
    ("floor_size_sqm", ["building size"], first_float),
]


def structured_address(blocks: Column) -> Column:
    """First postal address with a locality among the structured data blocks,
    in page order; blocks that are empty or not valid JSON are passed over."""

    def items(block: Column) -> Column:
        parsed = F.try_parse_json(block)
        return F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.array(parsed))

    def address(item: Column) -> Column:
        return F.struct(
            F.try_variant_get(item, "$.address.addressLocality", "string").alias("suburb"),
            F.try_variant_get(item, "$.address.postalCode", "string").alias("postcode"),
        )

    found = F.flatten(F.transform(blocks, lambda block: F.transform(items(block), address)))
    return F.get(F.filter(found, lambda a: F.coalesce(a["suburb"] != "", F.lit(False))), 0)


def primary_features(labels: str) -> dict[str, Column]:
    """Rooms and sizes from the feature list in column ``labels``; a later label
    of a kind replaces an earlier one. A list without a car entry means no
    parking, a page without a list means nothing is known."""
    tests = " ".join(
        f"WHEN {' OR '.join(f"""contains(lower(label), '{w}')""" for w in words)} THEN '{name}'" for name, words, _ in LABEL_KINDS
    )
    values = {}
    for name, _, read in LABEL_KINDS:
        value = read(F.expr(f"lower(try_element_at(filter({labels}, label -> CASE {tests} ELSE '' END = '{name}'), -1))"))
        if name == "parking_spaces":
            listed = F.expr(f"exists({labels}, label -> CASE {tests} ELSE '' END = '{name}')")
            value = F.when(listed, value).when(F.col(labels).isNotNull(), F.lit(0))
        values[name] = value
    return values


def property_type(pieces: Column) -> Column:
    """The token that follows the bullet sign."""
    tokens = F.transform(F.split(F.array_join(pieces, "|"), r"\|"), tx.strip)
    position = F.array_position(tokens, "•").cast("int")
    return F.when(position > 0, F.get(tokens, position))


def extract(pages: DataFrame) -> DataFrame:
    """``(source_file, html, captured_on)`` to typed listing rows: the extracted
    columns followed by the amenity flags."""
    conf = pages.sparkSession.conf
    before = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if before <= 0 or before > BATCH_PAGES:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_PAGES))
    raw = pages.select("source_file", "captured_on", locate(F.col("html")).alias("at"))
    located = raw.select(
        "source_file",
        "captured_on",
        F.coalesce(F.array_join("at.address", ""), F.col("at.og_title")).alias("address"),
        structured_address(F.col("at.json_ld")).alias("structured"),
        F.col("at.labels").alias("labels"),
        property_type(F.col("at.attributes")).alias("property_type"),
        F.array_join("at.footer", " ").alias("footer"),
        tx.price_text(F.array_join("at.price", ""), F.col("at.meta_description")).alias("price_text"),
        tx.description_lines(
            F.coalesce(tx.blank_to_null(F.col("at.og_description")), F.array_join("at.body", "\n"))
        ).alias("lines"),
        F.col("at.canonical").alias("url"),
    )
    described = located.withColumns({"features_raw": tx.bullets(F.col("lines")), "description": tx.prose(F.col("lines"))})
    worded = described.withColumn("feature_text", tx.feature_text(F.col("features_raw"), F.col("description")))
    values = {
        "listing_id": tx.listing_id(F.col("url"), F.col("source_file")),
        "suburb": tx.address_suburb(F.col("address"), F.col("structured.suburb")),
        "postcode": tx.address_postcode(F.col("address"), F.col("structured.postcode")),
        **primary_features("labels"),
        "weekly_rent_aud": tx.price_value(F.col("price_text")),
        "lease_term_months": tx.lease_months(F.col("feature_text")),
        "available_from": tx.available_from(F.col("footer"), F.col("captured_on")),
    }
    return worded.select(
        *[values[c].alias(c) if c in values else F.col(c) for c in EXTRACTED_COLUMNS], *amenity_flags(F.col("feature_text"))
    )


def amenity_flags(feature_text: Column) -> list[Column]:
    return [tx.amenity_flag(feature_text, c).alias(c) for c in cat.AMENITY_COLUMNS]


def coverage(listings: DataFrame, fields: list[str] = COVERAGE_FIELDS) -> DataFrame:
    """How often each required field could not be extracted."""
    counted = listings.agg(F.count("*").alias("total"), *[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    return counted.unpivot("total", fields, "field", "missing").select("field", "missing", "total")
