"""The feature catalogue: column names, types, vocabularies and labels.

Data only. Adding an amenity, a point category or an editable detail column is
a change to this file and to nothing else.
"""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, DOUBLE, DATE, TIMESTAMP = (
    T.StringType(),
    T.IntegerType(),
    T.DoubleType(),
    T.DateType(),
    T.TimestampType(),
)

# --------------------------------------------------------------------------
# Fixed values. Names, word lists, patterns and labels below are part of the
# data contract with existing listing tables and edit sheets.
# --------------------------------------------------------------------------

CORE_COLUMNS = {
    "listing_id": STRING,
    "url": STRING,
    "address": STRING,
    "suburb": STRING,
    "postcode": STRING,
    "lat": DOUBLE,
    "lon": DOUBLE,
    "property_type": STRING,
    "bedrooms": INT,
    "bathrooms": INT,
    "parking_spaces": INT,
    "land_size_sqm": DOUBLE,
    "floor_size_sqm": DOUBLE,
    "features_raw": T.ArrayType(STRING),
    "description": STRING,
    "weekly_rent_aud": DOUBLE,
    "lease_term_months": INT,
    "available_from": DATE,
    "commute_driving_minutes": DOUBLE,
    "commute_transit_minutes": DOUBLE,
    "straight_line_km": DOUBLE,
    "date_captured": TIMESTAMP,
    "source_file": STRING,
    "status": STRING,
    "fits_two_desks_3rd_bedroom": INT,
    "manual_notes": STRING,
}

# Wording that announces a renovated room, up to two words before the noun.
_RENOVATED = r"(?:modern|renovated|contemporary|updated|designer|new|stylish|refurbished)\s+(?:[\w-]+\s+){0,2}"

AMENITY_PATTERNS = {
    "air_conditioning": [r"air[ -]?con", r"a/c", r"ducted air", r"reverse cycle", r"split[ -]system"],
    "built_in_wardrobes": [r"(?:built[ -]?in|inbuilt|walk[ -]in) (?:ward)?robe", r"birs?\b"],
    "dishwasher": [r"dishwasher"],
    "balcony": [
        r"balcon", r"courtyard", r"(?:private|rooftop|rear|sun|alfresco|entertainer'?s) terrace",
        r"back ?yard", r"rear yard", r"(?:rear|private|front) garden", r"garden beds", r"lawn",
        r"deck", r"alfresco", r"patio", r"outdoor (?:area|entertaining|space|dining)",
    ],
    "pool": [r"swimming pool", r"pool\b"],
    "gym": [
        r"gymnasium", r"(?:on-?site|communal|residents'?|building|private|in-house) gym",
        r"fitness (?:centre|center|room)",
    ],
    "secure_parking": [r"secure (?:parking|car ?space)", r"garage", r"carport", r"lock[ -]up"],
    "furnished": [r"furnished"],
    "pet_friendly": [r"pet[ -]friendly", r"pets (?:allowed|considered|welcome|negotiable)"],
    "study": [r"study", r"sun ?room", r"home office", r"second living", r"working from home"],
    "natural_light": [
        r"north(?:[ -]east)?[ -]facing", r"sun[ -]drenched", r"light[ -]filled", r"sunny",
        r"natural light", r"north(?:erly)? aspect", r"north to (?:the )?rear",
    ],
    "security_features": [r"intercom", r"secure building", r"alarm system", r"security system", r"video entry"],
    "fly_screens": [r"fly[ -]?screen"],
    "modern_kitchen": [_RENOVATED + r"kitchen"],
    "modern_bathroom": [_RENOVATED + r"(?:bathroom|ensuite)"],
    "second_storey": [
        r"(?:two|three|double|multi|split|tri|2|3)[ -]?(?:storey|story|level)",
        r"(?:two|three|2|3)\s+(?:[\w-]+\s+){0,2}levels", r"upstairs", r"downstairs",
    ],
}

POI_CATEGORIES = [
    "train_station", "metro_station", "light_rail_station", "school", "supermarket", "park", "beach",
]
RAIL_CATEGORIES = ["train_station", "metro_station", "light_rail_station"]

# Station file mode -> point category.
MODE_CATEGORY = {"train": "train_station", "metro": "metro_station", "light_rail": "light_rail_station"}

# Transit feed route type -> mode; every other route type is left out.
ROUTE_TYPE_MODE = {"2": "train", "401": "metro", "900": "light_rail"}

# Number words understood in lease terms.
NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "six": "6", "nine": "9", "twelve": "12", "eighteen": "18"}

# Text patterns (group 1, or the named position, holds the value).
NUMBER_PATTERN = r"[-+]?\d*\.?\d+"
ADDRESS_PATTERN = r"^(.+?),\s*([^,]+?)(?:,)?\s+([A-Z]{2,3})\s+(\d{4})$"
LEASE_MONTH_PATTERNS = [
    r"(\d{1,2})[\s-]*months?\s+(?:fixed\s+)?(?:lease|tenancy|term)",
    r"(?:lease|tenancy)\s+(?:term\s+)?(?:of\s+)?(\d{1,2})[\s-]*months?",
]
LEASE_YEAR_PATTERN = r"(\d)[\s-]*years?\s+(?:fixed\s+)?(?:lease|tenancy)"
AVAILABLE_PATTERN = r"Available\s+(now|\d{1,2} \w{3} \d{4})"
WEEKLY_PRICE_PATTERN = r"\$[\d,]+(?:\.\d+)?\s*per week"
URL_ID_PATTERN = r"-(\d+)/?$"
UNPRICED_WORDS = ["contact", "auction"]

# Editable detail columns: column -> (label shown to people, value type).
DETAIL_COLUMNS = {
    "air_conditioning": ("Air conditioning", "boolean"),
    "built_in_wardrobes": ("Built-in wardrobes", "boolean"),
    "dishwasher": ("Dishwasher", "boolean"),
    "balcony": ("Outdoor space (balcony, courtyard, deck, garden or backyard)", "boolean"),
    "pool": ("Swimming pool", "boolean"),
    "gym": ("Building gym", "boolean"),
    "secure_parking": ("Secure parking (garage/carport)", "boolean"),
    "furnished": ("Furnished", "boolean"),
    "pet_friendly": ("Pet friendly", "boolean"),
    "study": ("Study, sunroom or other home-office space", "boolean"),
    "natural_light": ("Light-filled / north-facing", "boolean"),
    "security_features": ("Security features (intercom/alarm/etc)", "boolean"),
    "fly_screens": ("Fly screens", "boolean"),
    "modern_kitchen": ("Modern / renovated kitchen", "boolean"),
    "modern_bathroom": ("Modern / renovated bathroom", "boolean"),
    "second_storey": ("Two-storey / multi-level", "boolean"),
    "fits_two_desks_3rd_bedroom": ("Smallest bedroom fits two desks (WFH)", "boolean"),
    "lease_term_months": ("Lease term (months)", "number"),
    "available_from": ("Available from", "date"),
    "land_size_sqm": ("Land size (sqm)", "number"),
    "floor_size_sqm": ("Internal floor size (sqm)", "number"),
}

# Hard filters people may set in the filter sheet: key -> value type.
SHEET_FILTERS = {
    "max_weekly_rent_aud": "number",
    "min_bedrooms": "number",
    "max_commute_transit_minutes": "number",
    "max_commute_driving_minutes": "number",
    "min_lease_term_months": "number",
    "excluded_suburb": "list",
    "pet_friendly_required": "boolean",
}
PREFERRED_SUBURBS_ROW = "preferred_suburbs_list"
PREFERRED_SUBURBS_FEATURE = "preferred_suburbs"
SHEET_WEIGHT_SCALE = 5

RATING_GOOD, RATING_LOW, RATING_DIVERGE = 7, 4, 3
MIN_SUBURB_COUNT = 3
MIN_ROWS_FOR_FOLDS = 10
FOLDS = 5

# Report order of the suggested actions; anything else comes last.
ACTION_ORDER = {
    "discuss -- scores diverge": 0,
    "worth inspecting": 1,
    "maybe": 2,
    "awaiting rating": 3,
}

# --------------------------------------------------------------------------
# Derived from the values above.
# --------------------------------------------------------------------------

AMENITY_COLUMNS = list(AMENITY_PATTERNS)
BOOLEAN_COLUMNS = [*AMENITY_COLUMNS, "fits_two_desks_3rd_bedroom"]

POI_COLUMNS = {
    **{f"nearest_{c}": STRING for c in POI_CATEGORIES},
    **{f"nearest_{c}_km": DOUBLE for c in POI_CATEGORIES},
    **{f"nearest_{c}_walk_minutes": DOUBLE for c in POI_CATEGORIES},
}
LISTING_COLUMNS = {**CORE_COLUMNS, **{c: INT for c in AMENITY_COLUMNS}, **POI_COLUMNS}
LISTING_SCHEMA = T.StructType([T.StructField(n, t) for n, t in LISTING_COLUMNS.items()])

MODEL_NUMERIC_COLUMNS = [
    "bedrooms", "bathrooms", "parking_spaces",
    "land_size_sqm", "floor_size_sqm",
    "commute_driving_minutes", "commute_transit_minutes", "straight_line_km",
    *[f"nearest_{c}_km" for c in POI_CATEGORIES],
    *[f"nearest_{c}_walk_minutes" for c in POI_CATEGORIES],
]
MODEL_FLAGGED_COLUMNS = ["land_size_sqm", "floor_size_sqm"]
TARGET_COLUMN = "weekly_rent_aud"

GEO_LOOKUP_SCHEMA = T.StructType(
    [
        T.StructField("address", STRING),
        T.StructField("lat", DOUBLE),
        T.StructField("lon", DOUBLE),
        T.StructField("driving_minutes", DOUBLE),
        T.StructField("transit_minutes", DOUBLE),
        *[T.StructField(n, t) for n, t in POI_COLUMNS.items()],
        T.StructField("computed_at", TIMESTAMP),
    ]
)
RATING_SCHEMA = T.StructType(
    [
        T.StructField("listing_id", STRING),
        T.StructField("person", STRING),
        T.StructField("score", DOUBLE),
        T.StructField("comment", STRING),
        T.StructField("rated_at", TIMESTAMP),
    ]
)
OVERRIDE_SCHEMA = T.StructType(
    [
        T.StructField("listing_id", STRING),
        T.StructField("column_name", STRING),
        T.StructField("value", STRING),
        T.StructField("set_at", TIMESTAMP),
    ]
)
SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("listing_id", STRING),
        T.StructField("column_name", STRING),
        T.StructField("value", STRING),
    ]
)
POINT_SCHEMA = T.StructType(
    [
        T.StructField("category", STRING),
        T.StructField("name", STRING),
        T.StructField("lat", DOUBLE),
        T.StructField("lon", DOUBLE),
    ]
)


def _plain_stretch(pattern: str) -> str:
    """Longest run of characters every match of a pattern must contain: what is
    left outside groups, classes, escapes and optional characters."""
    runs, depth, skip = [""], 0, 0
    for i, ch in enumerate(pattern):
        if skip:
            skip -= 1
            continue
        if ch == "|" and not depth:
            return ""
        if ch == "\\":
            skip = 1
            runs.append("")
        elif ch in "([":
            depth += 1
            runs.append("")
        elif ch in ")]":
            depth -= 1
        elif ch in "{?*+" or depth or ch in "}.,0123456789":
            runs.append("")
        elif pattern[i + 1 : i + 2] in tuple("?*{"):
            runs.append("")
        else:
            runs[-1] += ch
    return max(runs, key=len)


def amenity_hints(column: str) -> list[str]:
    """One plain stretch per alternative, or nothing when one has none."""
    hints = [_plain_stretch(p) for p in AMENITY_PATTERNS[column]]
    return sorted(set(hints)) if all(hints) else []


def amenity_regex(column: str) -> str:
    """One alternation per amenity; only the start is tied to a word boundary."""
    return r"(?U)\b(?:" + "|".join(AMENITY_PATTERNS[column]) + ")"
