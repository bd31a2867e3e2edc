"""Keeping the listing table current: skip, fold, upsert, override."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead import catalog as cat


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


# A side of at most this many bytes (as text) is sent to all executors.
BROADCAST_BYTES = 64 * 1024 * 1024


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether measuring ``df`` shows that it may be sent to every executor."""
    return (df.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0) <= limit


def send_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked to be sent to every executor, if measuring it shows that it
    is small; otherwise as it is, to be joined by key."""
    return F.broadcast(df) if is_small(df, limit) else df


def skip_ingested(
    pages: DataFrame, ledger: DataFrame, with_enrichment: bool = True, force: bool = False, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Pages still to be read: those not in the ledger, and, when enrichment is
    wanted, those whose listing has no position yet. File names alone decide, and
    pages are read once: the new names are sent to them, or, beyond ``limit`` bytes,
    a bitmap of the ledger's names with the few names that it claims wrongly."""
    if force:
        return pages
    done = (ledger.where("lat is not null") if with_enrichment else ledger).select("source_file")
    names = pages.select("source_file").where(F.col("source_file").isNotNull()).distinct()
    fresh = names.join(done, "source_file", "left_anti").withColumn("_fresh", F.lit(True))
    if is_small(fresh, limit):
        return pages.join(F.broadcast(fresh), "source_file", "left").where(F.col("_fresh") | F.col("source_file").isNull()).select(pages.columns)
    claimed, width = claims(done)
    wrong = claimed(names).where("_claimed").select("source_file").join(done, "source_file", "left_anti").withColumn("_wrong", F.lit(True))
    marked = claimed(pages).join(send_if_small(wrong), "source_file", "left")
    return marked.where(~F.col("_claimed") | F.col("_wrong") | F.col("source_file").isNull()).select(pages.columns)


# Bits of a name bitmap for each name, and in all (128 MB).
BITS_PER_NAME = 32
MOST_BITS = 1 << 30


def claims(names: DataFrame, most_bits: int = MOST_BITS):
    """A function that adds ``_claimed`` to rows with ``source_file``: false only for names that ``names``
    does not hold. One bit a name, in rows of 4 KB that are sent to all executors; with it the number of bits.
    A name is claimed wrongly once in ``BITS_PER_NAME`` times, and more often beyond ``most_bits``."""
    bits = 1 << 15
    while bits < min(most_bits, BITS_PER_NAME * names.count()):
        bits *= 2
    place = F.pmod(F.xxhash64("source_file"), F.lit(bits))
    spots = names.where(F.col("source_file").isNotNull()).select(F.bitmap_bucket_number(place).alias("_part"), F.bitmap_bit_position(place).alias("_bit"))
    table = spots.groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_map"))

    def add(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("_part", F.bitmap_bucket_number(place)).withColumn("_bit", F.bitmap_bit_position(place))
        met = placed.join(F.broadcast(table), "_part", "left")
        byte = F.conv(F.hex(F.expr("substring(_map, CAST(_bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
        hit = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
        return met.select(*[F.col(_name(c)) for c in rows.columns], F.coalesce(hit, F.lit(False)).alias("_claimed"))

    return add, bits


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key. Folds before the shuffle, so a key with very many
    rows costs no more than any other."""
    values = ", ".join(_name(c) for c in df.columns if c not in keys)
    last = F.expr(f"max_by(struct({values}), struct({', '.join(map(_name, order))})) AS last")
    return df.groupBy(*keys).agg(last).selectExpr(*[_name(c) if c in keys else f"last.{_name(c)}" for c in df.columns])


def fold_batch(batch: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key out of a batch: for every column the last value, in
    ``order``, that is not null."""
    values = [_name(c) for c in batch.columns if c != key]
    last = [F.expr(f"max_by({c}, _order) FILTER (WHERE {c} IS NOT NULL) AS {c}") for c in values]
    return batch.withColumn("_order", order).groupBy(key).agg(*last).select(*batch.columns)


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "listing_id") -> DataFrame:
    """Stored rows with every known incoming value laid over them, plus new
    rows. Nulls never erase; stored rows the batch does not mention stay.

    A batch is normally far smaller than the table. Written as an update join
    and an insert, the small side can be sent to the executors and the table is
    neither shuffled nor sorted; a full outer join would always shuffle it."""
    have, fresh = stored.columns, set(incoming.columns) - {key}
    renamed = incoming.selectExpr(_name(key), *[f"{_name(c)} AS {_name(f'_new_{c}')}" for c in incoming.columns if c != key])
    merged = [f"coalesce({_name(f'_new_{c}')}, {_name(c)}) AS {_name(c)}" if c in fresh else _name(c) for c in have]
    added = [f"{_name(f'_new_{c}')} AS {_name(c)}" for c in incoming.columns if c not in have]
    updated = stored.join(renamed, key, "left").selectExpr(*merged, *added)
    matched = stored.select(key).join(incoming.select(key), key, "left_semi")
    inserted = incoming.join(matched, key, "left_anti")
    return updated.unionByName(inserted, allowMissingColumns=True)


def _typed_override(value: str, column: str) -> str:
    """SQL for an override's text as the type of the column it corrects."""
    kind = cat.LISTING_COLUMNS[column].simpleString()
    if kind == "int":
        return f"try_cast(try_cast({value} AS double) AS int)"
    if kind == "date":
        return f"try_to_date({value}, 'yyyy-MM-dd')"
    if kind.startswith("array"):
        return f"from_json({value}, '{kind}')"
    return f"try_cast({value} AS {kind})"


def apply_overrides(listings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Human corrections over everything else. The column list is the table's
    own, so no extra pass is needed to find the columns."""
    columns = [c for c in listings.columns if c in cat.LISTING_COLUMNS and c != "listing_id"]
    order = "struct(set_at, value)" if "set_at" in overrides.columns else "value"
    wide = overrides.where(F.col("column_name").isin(columns)).groupBy("listing_id").agg(
        *[
            F.expr(f"max_by(value, {order}) FILTER (WHERE column_name = '{c}' AND value IS NOT NULL) AS _set_{c}")
            for c in columns
        ]
    )
    corrected = {c: f"coalesce({_typed_override(f'_set_{c}', c)}, {c}) AS {c}" for c in columns}
    return listings.join(wide, "listing_id", "left").selectExpr(*[corrected.get(c, _name(c)) for c in listings.columns])


def apply_status(listings: DataFrame, edits: DataFrame) -> DataFrame:
    """Non-blank status edits ``(listing_id, status)`` onto the listings."""
    edited = edits.select("listing_id", F.col("status").alias("_status"))
    return (
        listings.join(send_if_small(edited), "listing_id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .select(*listings.columns)
    )


def run_counters(pages: DataFrame, todo: DataFrame) -> DataFrame:
    """How many pages a run reads and how many it leaves alone."""
    marked = pages.select("source_file").join(todo.select("source_file").withColumn("_todo", F.lit(True)), "source_file", "left")
    return marked.agg(
        F.count_if(F.col("_todo")).alias("processed"), F.count_if(F.col("_todo").isNull()).alias("skipped")
    )


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket of a row by its key alone."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
