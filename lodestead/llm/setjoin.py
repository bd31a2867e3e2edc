"""N-gram Jaccard join by groups of equal prefixes.

A document's set is its distinct runs of ``SIZE`` words (`[^\\x20\\x09-\\x0D]+`, A-Z
lower-cased; fewer words, but not none: the whole sequence). Two documents link when
100 * intersection >= ``PERCENT`` * union. The result is each document's set size and
the smallest id that links lead to; pairs are never listed in full.

1. Shingle frequencies over the whole corpus are counted in a table of fixed size
   (``SLOTS``); it only orders shingles, rare ones first, so collisions cost time, never
   links.
2. Equal sets form a class. A set's prefix holds its rarest shingles, as many that two
   linked sets must share one. Classes of equal prefix and size form a group, and only
   groups enter the lists of prefix shingles.
   Of the lists, which are dealt by shingle, those of one group only are dropped where they lie.
3. Stars: in each list (of a shingle, within a band of sizes) every group meets the list's first
   group and the one before it.
   Pairs that sizes, the positions in the prefixes and parity bitmaps (which bound the
   difference of two sets from below) allow are verified on the whole sets, and linked
   classes contracted to components.
4. The rest: lists whose groups' members are still of several components are expanded to
   these members, and members of different components meet under the same filters, are
   verified, and contracted. Nothing that can link is left out; what a list holds of one
   component meets no more. A long list is cut into blocks, and each block meets all
   of the list's members in a place of its own, so that one list is the work of many tasks.

Shingles, and classes, are told apart by 64-bit hashes. Sets are read again only of
documents in surviving pairs, by a bitmap that grows with their number up to ``MOST_WANTED`` bits (a
full one costs time, never links). Results between steps are
checkpointed; nothing but tables of fixed size and counts passes the driver.

Defined results: documents without words (null, empty, blank) have size 0 and are their own
component; repeated rows repeat, and rows of one id with different texts are placed by
their texts; a row without an id is placed like any other, and a component all of whose
ids are null has a null id; an empty table gives an empty one. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.llm.blocks import pack, unpack
from lodestead.llm.frames import ids_and_text, keep, map_batches, release
from lodestead.llm.words import Words, hash_words, mix, rows_by_bytes, shingles, utf8

SIZE = 4
PERCENT = 85
#: Counters of the frequency table. What shares a counter by chance grows with the input as common shingles do.
SLOTS = 1 << 22
#: Bits for each wanted document (by its id and by its class), and in all.
WANTED = 16
MOST_WANTED = 1 << 28
#: Ranges in which tables of fixed size are summed.
RANGES = 16
#: 64-bit words of a parity bitmap.
PARITY = 16
#: Places among which the groups of a list of more than ``HOT`` are dealt out.
SALTS = 4
HOT = 64
#: Members of a block of a long list.
BLOCK = 2000


def _pieces(batches, column: int):
    for batch in batches:
        raw, offsets = utf8(batch.column(column))
        for a, b in rows_by_bytes(offsets):
            yield batch.slice(a, b - a), hash_words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _sets(words: Words, size: int):
    for a, b in zip(words.bounds, words.bounds[1:]):
        yield np.unique(shingles(words.hashes[a:b], size))


def _levels(sums: np.ndarray) -> np.ndarray:
    return np.minimum(4 * np.log2(sums + np.float32(1)), 255).astype(np.uint8)


def _at_least(least: int):
    return lambda sums: np.packbits(sums >= least)


def _table(rows: DataFrame, work, slots: int, finish) -> np.ndarray:
    """``finish`` of the sum of the tables (``slots`` numbers) that ``work`` makes of each task's batches,
    saturating at 255 within a task. Only what ``finish`` gives (bytes) comes to the driver."""
    part = slots // RANGES
    empty = finish(np.zeros(part, np.uint32))

    def local(batches):
        table = np.minimum(work(batches), 255).astype(np.uint8)
        some = [i for i in range(RANGES) if table[i * part : (i + 1) * part].any()]
        yield {"part": some, "data": [pack(table[i * part : (i + 1) * part]) for i in some]}

    def merged(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + unpack(data).astype(np.uint32)
        yield {"part": list(sums), "data": [pack(finish(s)) for s in sums.values()]}

    out = np.tile(empty, RANGES)
    sent = map_batches(rows, local, "part int, data binary").repartition(RANGES, "part")
    for row in map_batches(sent, merged, "part int, data binary").collect():
        out[row["part"] * len(empty) : (row["part"] + 1) * len(empty)] = unpack(bytes(row["data"]))
    return out


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """The level (four times the binary logarithm) of each slot's number of shingles."""

    def work(batches):
        total = np.zeros(SLOTS, np.int64)
        for _, words in _pieces(batches, 0):
            h, n = words.hashes, len(words.hashes)
            if n < size:
                continue
            runs = shingles(h, size)
            inside = np.ones(n, bool)
            for back in range(1, size):
                at = words.bounds[1:] - back
                inside[at[at >= words.bounds[:-1]]] = False
            total += np.bincount((runs[inside[: len(runs)]] & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        return total

    return _table(docs.select("text"), work, SLOTS, _levels)


def signature(found: np.ndarray) -> int:
    """A hash of a whole set."""
    return int(mix(np.array([mix(found ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) + np.uint64(len(found))], np.uint64))[0].view(np.int64))


def describe(docs: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """For each row a hash of its text and its set's size, class, prefix, group and parity bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def work(batches):
        level = shared.value
        for part, words in _pieces(batches, 1):
            rows = {c: [] for c in ("n", "class", "group", "prefix", "parity")} | {"print": part.column(2)}
            for found in _sets(words, size):
                n = len(found)
                keep = n - -(-percent * n // 100) + 1 if n else 0
                token = (level[(found & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (found >> np.uint64(8))
                prefix = np.sort(token)[:keep].view(np.int64)
                odd = np.bincount((found >> np.uint64(54)).astype(np.int64), minlength=64 * PARITY) & 1
                rows["n"].append(n)
                rows["class"].append(signature(found))
                rows["group"].append(signature(prefix.view(np.uint64)) ^ n)
                rows["prefix"].append(prefix)
                rows["parity"].append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            yield {"doc_id": part.column(0), **rows}

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    return map_batches(rows, work, "doc_id long, print long, n long, class long, group long, prefix array<long>, parity array<long>")


def _merged(side: DataFrame) -> DataFrame:
    """The side of a join that is shuffled and sorted at any size: many small broadcasts would fill the driver."""
    return side.hint("merge")


def _possible(a: str, b: str, percent: int) -> Column:
    """What sizes and positions of a shared prefix shingle allow."""
    n, m, i, j = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.at", f"{b}.at"))
    rest = 1 + F.least(n - i - 1, m - j - 1)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (rest * (100 + percent) >= percent * (n + m))


def _differ(a: Column, b: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether the parity bitmaps allow a link: they differ in no more places than linked sets can."""
    places = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int"))
    far = F.aggregate(places, F.lit(0), lambda total, x: total + x)
    return far * (100 + percent) <= (100 - percent) * (n + m)


def verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().join(_merged(classes.select("class", "head")), "class")
    wanted = keep(wanted)
    bits = min(MOST_WANTED, max(1 << 7, 1 << (2 * WANTED * wanted.count()).bit_length()))

    def places(numbers, what: int):
        ids = np.array([0 if i is None else i for i in numbers], np.int64).view(np.uint64)
        return (mix(mix(ids) + np.uint64(what)) & np.uint64(bits - 1)).astype(np.int64)

    def mark(batches):
        table = np.zeros(bits, np.uint8)
        for batch in batches:
            for what in (0, 1):
                table[places(batch.column(what).to_pylist(), what)] = 1
        return table

    shared = docs.sparkSession.sparkContext.broadcast(_table(wanted.select("head", "class"), mark, bits, _at_least(1)))

    def marked(table, numbers, what: int):
        at = places(numbers, what)
        return (table[at >> 3] >> (7 - (at & 7))) & 1 == 1

    def read(batches):
        table = shared.value
        for batch in batches:
            part = batch.filter(pa.array(marked(table, batch.column(0).to_pylist(), 0)))
            for _, words in _pieces([part], 1):
                sets = list(_sets(words, size))
                names = [signature(s) for s in sets]
                own = np.flatnonzero(marked(table, names, 1)) if names else ()
                yield {"class": [names[i] for i in own], "found": [sets[i].tobytes() for i in own]}

    sets = map_batches(docs, read, "class long, found binary").groupBy("class").agg(F.first("found").alias("found"))
    sets = keep(sets)
    both = pairs.join(_merged(sets.select(F.col("class").alias("a"), F.col("found").alias("x"))), "a")
    both = both.join(_merged(sets.select(F.col("class").alias("b"), F.col("found").alias("y"))), "b")

    def compare(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            part = batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))
            yield {"a": part.column(0), "b": part.column(1)}

    return keep(map_batches(both.select("a", "b", "x", "y"), compare, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """``class`` and ``root`` for every class with an edge: in each round, all point to their least
    neighbour, and what points to the same merges. Classes are hashes, so rounds are few."""
    mapping = None
    edges = edges.where("a <> b").distinct()
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        parent = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        if mapping is None:
            mapping = parent.select(F.col("a").alias("class"), F.col("p").alias("root"))
        else:
            step = parent.select(F.col("a").alias("root"), F.col("p"))
            mapping = mapping.join(_merged(step), "root", "left").select("class", F.coalesce("p", "root").alias("root"))
        mapping = keep(mapping)
        edges = edges.join(_merged(parent), "a").select("b", F.col("p").alias("a")).join(_merged(parent.withColumnsRenamed({"a": "b", "p": "q"})), "b")
        edges = keep(edges.select("a", F.col("q").alias("b")).where("a <> b").distinct())
        if edges.isEmpty():
            return mapping


def _allowed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose parity bitmaps allow a link."""
    one = classes.select(F.col("class").alias("a"), F.col("n").alias("n"), F.col("parity").alias("x"))
    two = classes.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("parity").alias("y"))
    both = pairs.join(_merged(one), "a").join(_merged(two), "b")
    return both.where(_differ(F.col("x"), F.col("y"), F.col("n"), F.col("m"), percent)).select("a", "b")


def posted(groups: DataFrame) -> DataFrame:
    """``token``, ``at``, ``n``, ``class`` and ``nth`` (the row's place among those of its token) of the groups' prefixes,
    without tokens that are in one prefix only. Neighbours in the sorted stream tell, so a list of any length passes by."""

    def post(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = pc.list_value_length(lists).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield {"token": lists.flatten(), "at": at.astype(np.int32), "n": batch.column(1).to_numpy()[row].astype(np.int32), "class": batch.column(0).to_numpy()[row]}

    def alone(batches):
        """Rows whose token is that of the row before or after."""
        held, place = None, 0
        for batch in batches:
            if not len(batch):
                continue
            own = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own)]
            token = own[0]
            new = np.append(True, token[1:] != token[:-1])
            starts = np.flatnonzero(new)
            nth = np.arange(len(token)) - starts[np.cumsum(new) - 1]
            nth[: starts[1] if len(starts) > 1 else len(token)] += place
            several = ~new | np.append(~new[1:], False)
            several[0] |= place > 0
            last = len(token) - 1
            out = np.flatnonzero(several[:last])
            if len(out):
                yield {c: x[out] for c, x in zip(names, own)} | {"nth": nth[out]}
            held, place = [x[last:] for x in own], int(nth[last])
        if held is not None and place > 0:
            yield {c: x for c, x in zip(names, held)} | {"nth": [place]}

    names = ["token", "at", "n", "class"]
    rows = map_batches(groups.select("class", "n", "prefix"), post, "token long, at int, n int, class long")
    dealt = rows.repartition("token").sortWithinPartitions("token")
    return map_batches(dealt, alone, "token long, at int, n int, class long, nth long")


def stars(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link: in each list every class with the list's first and with the one
    before it. A long list is dealt out to ``SALTS`` places, differently for each shingle."""

    def pair(batches):
        held = None
        for batch in batches:
            token, band, salt, group, n, at = (batch.column(i).to_numpy() for i in range(6))
            if not len(token):
                continue
            if held is not None:
                token, band, salt, group, n, at = (np.concatenate(x) for x in zip(held, (token, band, salt, group, n, at)))
            new = np.append(True, (token[1:] != token[:-1]) | (band[1:] != band[:-1]) | (salt[1:] != salt[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            out_a, out_b = [], []
            for other in (first, np.maximum(np.arange(len(token)) - 1, first)):
                rest = 1 + np.minimum(n - at - 1, n[other] - at[other] - 1).astype(np.int64)
                fits = 100 * np.minimum(n, n[other]).astype(np.int64) >= percent * np.maximum(n, n[other]).astype(np.int64)
                fits &= (rest * (100 + percent) >= percent * (n.astype(np.int64) + n[other])) & (group != group[other])
                out_a.append(np.minimum(group, group[other])[fits])
                out_b.append(np.maximum(group, group[other])[fits])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            yield {"a": both[:, 0], "b": both[:, 1]}
            last = len(token) - 1
            keep_rows = [first[last], last]
            held = tuple(x[keep_rows] for x in (token, band, salt, group, n, at))

    salted = lists.select("token", "band", F.when(F.col("hot"), F.pmod(F.xxhash64("class", "token"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"), "class", "n", "at")
    key = ["token", "band", "salt"]
    dealt = salted.repartition(*key).sortWithinPartitions(*key, "class")
    return map_batches(dealt, pair, "a long, b long").distinct()


def similar(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row."""
    return placed(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def placed(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The same with ``print`` (xxhash64 of the text) and ``root``, which all rows of a component share and no others (null
    without words): it tells components apart also where ids are missing or repeated."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    docs = ids_and_text(docs)
    spark = docs.sparkSession
    rows = keep(describe(docs, frequencies(docs, size), size, percent))
    release(spark)
    words = rows.where("n > 0")
    classes = keep(words.groupBy("class").agg(F.min("doc_id").alias("head"), F.first("n").alias("n"), F.first("group").alias("group"), F.first("parity").alias("parity")))
    groups = words.groupBy("group").agg(F.min("class").alias("class"), F.max("class").alias("last"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    groups = keep(groups.select("group", "class", (F.col("class") != F.col("last")).alias("several"), "n", "prefix"))
    several = keep(groups.where("several").select("group", F.col("class").alias("first")))
    inside = keep(classes.join(_merged(several), "group").select("group", "first", "class", F.col("n").cast("int").alias("n")))
    postings = keep(posted(groups))
    hot = keep(postings.where(F.col("nth") == HOT).select("token", F.lit(True).alias("hot")))
    lists = postings.join(_merged(hot), "token", "left").select("token", "n", "at", "class", F.coalesce("hot", F.lit(False)).alias("hot"), F.lit(False).alias("alike"))
    alike = inside.select(F.col("group").alias("token"), "n", F.lit(0).alias("at"), "class", F.lit(True).alias("hot"), F.lit(True).alias("alike"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int") if percent < 100 else F.col("n")
    lists = keep(lists.unionByName(alike)).withColumn("band", F.explode(F.array(band, band + 1)))

    release(spark)
    key = ["token", "band"]
    links = verify(docs, classes, keep(_allowed(stars(lists, percent), classes, percent)), size, percent)
    release(spark)
    roots = components(links)
    release(spark)

    # lists that still hold several components, with all members of their groups; what one group alone
    # holds meets in its own list
    spread = inside.join(_merged(roots), "class", "left").withColumn("root", F.coalesce("root", "class"))
    spread = spread.groupBy(F.col("first").alias("class")).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
    spots = lists.join(_merged(roots), "class", "left").withColumn("root", F.coalesce("root", "class"))
    spots = keep(spots.join(_merged(spread), "class", "left"))
    mixed = spots.groupBy(*key).agg(
        F.min(F.coalesce("low", "root")).alias("r"), F.max(F.coalesce("high", "root")).alias("s"), F.count("*").alias("groups"),
        F.sum(F.coalesce("members", F.lit(1))).alias("members"), F.max("hot").alias("hot"),
    ).where("r <> s AND groups > 1 AND (members > 2 OR hot)").select(*key)
    left = keep(spots.join(_merged(mixed), key))
    others = inside.where("class <> first").select(F.col("first").alias("class"), F.col("class").alias("other"))
    more = left.where("NOT alike").join(_merged(others), "class").select(*key, "n", "at", F.col("other").alias("class"))
    more = more.join(_merged(roots), "class", "left").withColumn("root", F.coalesce("root", "class"))
    left = left.select(*key, "n", "at", "class", "root").unionByName(more.select(*key, "n", "at", "class", "root"))
    left = keep(left.join(_merged(classes.select("class", "parity")), "class"))
    blocks = keep(left.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    left = left.join(_merged(blocks), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    x = left.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).alias("x")
    y = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    meet = F.col("x.token") == F.col("y.token")
    meet &= (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.class") < F.col("y.class"))
    meet &= (F.col("x.root") != F.col("y.root")) & _possible("x", "y", percent)
    meet &= _differ(F.col("x.parity"), F.col("y.parity"), F.col("x.n"), F.col("y.n"), percent)
    rest = x.hint("merge").join(y, meet).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    rest = keep(rest.join(_merged(links), ["a", "b"], "left_anti"))
    release(spark)
    if not rest.isEmpty():
        more = verify(docs, classes, rest, size, percent)
        release(spark)
        if not more.isEmpty():
            roots = components(links.union(more))

    release(spark)
    whole = classes.select("class", "head").join(_merged(roots), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = whole.groupBy("root").agg(F.min("head").alias("component_id"))
    component = keep(whole.join(_merged(least), "root").select("class", "root", "component_id"))
    full = rows.where("n > 0").join(_merged(component), "class").select("doc_id", "print", F.col("n").alias("n_shingles"), "root", "component_id")
    none = rows.where("n = 0").select("doc_id", "print", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return full.unionByName(none)
