"""People's preferences: three long tables and their checked, in-memory form.

Any number of people are scored as tables (``operators.people``). The wide report
gives each of its people columns of their own; only what these people prefer is
read to the driver, and becomes expressions over the listing columns they name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_SCHEMA = "person string, key string, num double, text string, list array<string>, `on` boolean, pos int"
WEIGHT_SCHEMA = "person string, feature string, weight double, pos int"
SUBURB_SCHEMA = "person string, suburb string"
DOCUMENT_SCHEMA = "person string, hard_filters map<string,string>, preferred_suburbs array<string>, weights map<string,double>"
EXAMPLE_PERSON = "example"

# Key prefixes are looked at before the suffix.
FILTER_PREFIXES = {"max_": "max", "min_": "min", "allowed_": "allowed", "excluded_": "excluded"}
REQUIRED_SUFFIX = "_required"


@dataclass(frozen=True)
class HardFilter:
    kind: str
    column: str
    value: object

    @classmethod
    def parse(cls, key: str, value: object) -> HardFilter:
        for prefix, kind in FILTER_PREFIXES.items():
            if key.startswith(prefix):
                return cls(kind, key[len(prefix):], value)
        if key.endswith(REQUIRED_SUFFIX):
            return cls("required", key[: -len(REQUIRED_SUFFIX)], value)
        raise ValueError(
            f"unknown hard filter {key!r}: expected a prefix {'/'.join(FILTER_PREFIXES)} or the suffix {REQUIRED_SUFFIX}"
        )


@dataclass(frozen=True)
class Preferences:
    person: str
    filters: list[HardFilter] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)
    suburbs: list[str] = field(default_factory=list)


def people(preferences: list[Preferences]) -> list[str]:
    return [p.person for p in preferences]


def select_person(preferences: list[Preferences], person: str) -> Preferences:
    for p in preferences:
        if p.person == person:
            return p
    raise LookupError(f"no preferences stored for {person!r}")


def load_preferences(
    filters: DataFrame | None, weights: DataFrame | None, suburbs: DataFrame | None, persons: DataFrame | None = None,
    names: list[str] | None = None,
) -> list[Preferences]:
    """Preferences of the named people (None: of every person, by name; the example person is left
    out). A section nobody filled in is empty, and a person listed in ``persons`` or named counts
    even without any."""

    def rows(df: DataFrame | None) -> list:
        if df is None:
            return []
        return (df.where(F.col("person").isin(names)) if names is not None else df.where(F.col("person") != EXAMPLE_PERSON)).collect()

    listed, filter_rows, weight_rows, suburb_rows = (rows(df) for df in (persons, filters, weights, suburbs))
    found = {r.person for r in [*filter_rows, *weight_rows, *suburb_rows, *listed]} | set(names or ())
    loaded = []
    for person in sorted(found - {EXAMPLE_PERSON}):
        mine = sorted((r for r in filter_rows if r.person == person), key=lambda r: r.pos)
        weighted = sorted((r for r in weight_rows if r.person == person), key=lambda r: r.pos)
        loaded.append(
            Preferences(
                person,
                [HardFilter.parse(r["key"], _filter_value(r)) for r in mine],
                {r.feature: r.weight for r in weighted},
                sorted({r.suburb for r in suburb_rows if r.person == person}),
            )
        )
    return loaded


def _filter_value(row) -> object:
    for name in ("num", "text", "list", "on"):
        if row[name] is not None:
            return row[name]
    return None


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Preference documents, one JSON object per person, as the three long
    tables. Missing sections count as empty."""
    docs = spark.read.schema(DOCUMENT_SCHEMA).json(path)
    # the text of a filter value keeps its JSON form, so its type can be told
    as_list = F.from_json(F.col("value"), "array<string>")
    is_list = F.col("value").startswith("[")
    filters = (
        docs.select("person", F.posexplode(F.map_entries("hard_filters")))
        .select("person", F.col("col.key").alias("key"), F.col("col.value").alias("value"), F.col("pos").cast("int"))
        .select(
            "person",
            "key",
            F.when(~is_list, F.col("value").try_cast("double")).alias("num"),
            F.when(
                ~is_list & F.col("value").try_cast("double").isNull() & ~F.col("value").isin("true", "false"), F.col("value")
            ).alias("text"),
            F.when(is_list, as_list).alias("list"),
            F.when(F.col("value").isin("true", "false"), F.col("value") == "true").alias("on"),
            "pos",
        )
    )
    weights = docs.select("person", F.posexplode(F.map_entries("weights"))).select(
        "person", F.col("col.key").alias("feature"), F.col("col.value").alias("weight"), F.col("pos").cast("int")
    )
    suburbs = docs.select("person", F.explode("preferred_suburbs").alias("suburb"))
    return filters, weights, suburbs
