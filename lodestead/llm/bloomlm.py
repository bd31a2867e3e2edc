"""Language model scoring by a log-frequency Bloom filter.

Counts of words and word pairs over all training texts are quantised to their
binary logarithm, and filters (one for words, one for pairs) hold a key (n-gram, j) for each j up to that
level: asking for j = 1, 2, ... until one is missing gives back the level, so
a count costs few probes and the filter stores no n-gram. Counting is
distributed by segments (see ``blocks``): every block of texts sends its distinct n-grams to their segments, and a
segment's task adds their counts up, builds its own part of the filter, whose bits grow with its keys, and answers each
block with the levels that the part gives. A filter of what a growing corpus knows has no bound under which it could be
sent to every worker, so at no size does a part leave its task: one exchange of a block's n-grams brings counts there
and levels back.

The probability of a word after another mixes the pair's count over the first
one's count (``SHARE``) with the word's own add-one probability; a text's score is
the sum of log10 over its words and one end. Words count from their first
occurrence, pairs from ``LEAST_PAIR`` (1 counts every pair). The same blocks give the exact add-one
unigram score (``base_score``).

Defined results: null text is the empty text, which has the end as its only
token; without any training text, probabilities are 1 (score 0); repeated rows
repeat; an empty table gives an empty one. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.checkpoints import cut
from lodestead.llm.blocks import dictionary, grouped, new_block, pack, segment_of, segments, unpack
from lodestead.llm.frames import keep, map_batches, release
from lodestead.llm.words import hash_words, mix, utf8

#: Bits of a filter for each key (rounded up to a power of two for each part), probes for each key.
BITS = 10
PROBES = 4
#: Occurrences in training texts from which a word pair counts.
LEAST_PAIR = 2
#: Share of a pair's relative frequency in a probability; the rest is the word's own.
SHARE = 0.3
#: N-grams that a segment merges, about.
EACH = 4 << 20
#: Hash bits that identify an n-gram in the filter.
KEY = 48

END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_C = np.uint64(0x9E3779B97F4A7C15)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _C + second)


@dataclass
class Filter:
    """One segment's part of a filter."""

    bits: np.ndarray

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """The quantised level of each n-gram, 0 if it is not there."""
        out = np.zeros(len(hashes), np.int64)
        live, j = np.arange(len(hashes)), 1
        while len(live) and len(self.bits):
            live = live[self._has(hashes[live], j)]
            out[live] = j
            j += 1
        return out

    def _has(self, hashes: np.ndarray, j: int) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        live = np.arange(len(hashes))
        for at in places(hashes, j, 8 * len(self.bits)):
            at = at[live]
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            found[live[~hit]] = False
            live = live[hit]
        return found


def filled(hashes: np.ndarray, counts: np.ndarray, bits: int) -> Filter:
    """The part that holds distinct n-grams with their counts, ``bits`` for each of its keys at least."""
    top = np.log2(counts).astype(np.int64) + 1
    if not len(top):
        return Filter(np.zeros(0, np.uint8))
    size = max(64, 1 << (int(top.sum()) * bits - 1).bit_length())
    found = np.zeros(size, bool)
    for j in range(1, int(top.max()) + 1):
        for at in places(hashes[top >= j], j, size):
            found[at] = True
    return Filter(np.packbits(found, bitorder="little"))


def counts_of(level: np.ndarray) -> np.ndarray:
    """The mean of the counts that share a level."""
    return np.where(level > 0, 1.5 * 2.0 ** (level - 1) - 0.5, 0.0)


def places(hashes: np.ndarray, j: int, size: int) -> list[np.ndarray]:
    """Bits of key (n-gram, j) in a part of ``size`` bits."""
    key = mix((hashes >> np.uint64(64 - KEY)) * _C + np.uint64(j))
    step = (key >> np.uint64(32)) | np.uint64(1)
    return [((key + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(PROBES)]


def _unkeys(gaps: bytes) -> np.ndarray:
    return np.cumsum(unpack(gaps).astype(np.uint64)) << np.uint64(64 - KEY)


def to_blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Blocks of index sequences, written to the shared folder as they are read several times, by columns."""

    def work(batches):
        partition = TaskContext.get().partitionId()
        for seq, table in enumerate(grouped(batches, 1)):
            raw, offsets = utf8(table.column(1))
            words = hash_words(raw, offsets)
            distinct, tokens, _ = dictionary(words.hashes)
            held = table.column(2).to_numpy(zero_copy_only=False).astype(bool)
            size = np.diff(words.bounds)
            counts = np.bincount(tokens[np.repeat(~held, size)], minlength=len(distinct)) if len(distinct) else np.zeros(0, np.int64)
            # the end is one more word of the dictionary
            distinct, counts = np.append(distinct, END), np.append(counts, (~held).sum())
            yield {
                "block": [new_block([], partition, seq)], "ids": [table.column(0).to_pylist()], "held": [pack(held.astype(np.uint8))], "bounds": [pack(words.bounds)],
                "tokens": [pack(tokens)], "words": [distinct.tobytes()], "counts": [pack(counts.astype(np.int64))], "n": [len(tokens) + len(held)], "n_words": [len(distinct)],
            }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held"))
    return keep(map_batches(rows, work, "block long, ids array<long>, held binary, bounds binary, tokens binary, words binary, counts binary, n long, n_words long"))


#: What a segment answers a block: exact counts (words) and the filter's levels of the n-grams that the block sent, in
#: that order. The segment's numbers of distinct and of all tokens stand on its first row.
ANSWER = "block long, kind int, segment int, data binary, levels binary, types long, total long"


def _answers(blocks: list[int], kind: int, segment: int, data: list[bytes], levels: list[bytes], types: int = 0, total: int = 0) -> pa.Table:
    rest = [0] * (len(blocks) - 1)
    return pa.table([
        pa.array(blocks, pa.int64()), pa.array([kind] * len(blocks), pa.int32()), pa.array([segment] * len(blocks), pa.int32()),
        pa.array(data, pa.binary()), pa.array(levels, pa.binary()), pa.array([types, *rest], pa.int64()), pa.array([total, *rest], pa.int64()),
    ], names=["block", "kind", "segment", "data", "levels", "types", "total"])


def count_words(blocks: DataFrame, parts: int, bits: int = BITS) -> DataFrame:
    """For each block and segment the corpus counts and the filter's levels of the block's words there."""

    def send(batches):
        for batch in batches:
            for block, words, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, counts = np.frombuffer(words, np.uint64), unpack(counts)
                segment = segment_of(words, parts)
                order = np.argsort(segment, kind="stable")
                ends = np.searchsorted(segment[order], np.arange(parts + 1))
                some = np.flatnonzero(np.diff(ends))
                yield {
                    "segment": some, "block": [block] * len(some),
                    "words": [words[order[ends[s] : ends[s + 1]]].tobytes() for s in some], "counts": [pack(counts[order[ends[s] : ends[s + 1]]]) for s in some],
                }

    def merge(table: pa.Table) -> pa.Table:
        segment = table.column("segment")[0].as_py()
        blocks = table.column("block").to_pylist()
        words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        counts = [unpack(x) for x in table.column("counts").to_pylist()]
        distinct, back = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, back, np.concatenate(counts))
        known = total > 0
        level = filled(distinct[known], total[known], bits).level(distinct).astype(np.uint8)
        cuts = np.cumsum([len(w) for w in words])[:-1]
        answers, levels = ([pack(a) for a in np.split(x[back], cuts)] for x in (total, level))
        return _answers(blocks, 1, segment, answers, levels, int(known.sum()), int(total.sum()))

    sent = map_batches(blocks.select("block", "words", "counts"), send, "segment int, block long, words binary, counts binary")
    return cut(sent.groupBy("segment").applyInArrow(merge, ANSWER))


def sequences(tokens: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's texts, one after another with their ends: each token's index, its
    hash's predecessor (``BEGIN`` before the first), and the first token of each text."""
    index = np.insert(tokens.astype(np.int64), bounds[1:], len(words) - 1)
    first = bounds[:-1] + np.arange(len(bounds) - 1)
    before = np.empty(len(index), np.uint64)
    before[1:] = words[index[:-1]]
    before[first] = BEGIN
    return index, before, first


def count_pairs(blocks: DataFrame, parts: int, least: int = LEAST_PAIR, bits: int = BITS) -> DataFrame:
    """For each block and segment the filter's levels of the block's word pairs there (in the order of their hashes),
    which the filter holds if training texts have them ``least`` times."""

    def send(batches):
        for batch in batches:
            for block, held, bounds, tokens, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
                held, bounds, tokens, words = unpack(held).astype(bool), unpack(bounds), unpack(tokens), np.frombuffer(words, np.uint64)
                index, before, _ = sequences(tokens, bounds, words)
                pairs, back = np.unique(pair_hash(before, words[index]), return_inverse=True)
                # pairs of texts held out are asked for, and count nothing
                counts = np.bincount(back[np.repeat(~held, np.diff(bounds) + 1)], minlength=len(pairs))
                ends = np.searchsorted(segment_of(pairs, parts), np.arange(parts + 1))
                some = np.flatnonzero(np.diff(ends))
                cut_at = [slice(ends[s], ends[s + 1]) for s in some]
                lead = pairs >> np.uint64(64 - KEY)
                yield {
                    "segment": some, "block": [block] * len(some),
                    "gaps": [pack(_narrow(np.diff(lead[c], prepend=np.uint64(0)))) for c in cut_at], "counts": [pack(_narrow(counts[c])) for c in cut_at],
                }

    def merge(table: pa.Table) -> pa.Table:
        segment = table.column("segment")[0].as_py()
        asked = [_unkeys(x.as_py()) for x in table.column("gaps")]
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        pairs = np.concatenate(asked)
        del asked
        counts = np.concatenate([unpack(x.as_py()).astype(np.int64) for x in table.column("counts")])
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        new = np.append(True, pairs[1:] != pairs[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts[order], first)
        kept = total >= max(1, least)
        distinct = pairs[first]
        levels = np.empty(len(pairs), np.uint8)
        levels[order] = filled(distinct[kept], total[kept], bits).level(distinct).astype(np.uint8)[np.cumsum(new) - 1]
        blocks = table.column("block").to_pylist()
        return _answers(blocks, 2, segment, [b""] * len(blocks), [pack(x) for x in np.split(levels, cuts)])

    sent = map_batches(blocks.select("block", "held", "bounds", "tokens", "words"), send, "segment int, block long, gaps binary, counts binary")
    return cut(sent.groupBy("segment").applyInArrow(merge, ANSWER))


def _narrow(x: np.ndarray) -> np.ndarray:
    """As 32 bits where the values after the first allow it; the first is kept apart by its own width."""
    return x.astype(np.uint32) if len(x) and x.max() < 1 << 32 else x.astype(np.uint64)


def score(docs: DataFrame, held_out: Column, share: float = SHARE, least: int = LEAST_PAIR, bits: int = BITS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every
    row, learning from those where ``held_out`` is false."""
    spark = docs.sparkSession
    blocks = to_blocks(docs, held_out)
    size = int(blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    parts = segments(size, EACH, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = count_pairs(blocks, parts, least, bits)
    release(spark)
    words = count_words(blocks, parts, bits)
    release(spark)
    types, total = words.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    answers = words.unionByName(pairs).select("block", "kind", "segment", "data", "levels")
    norm = float(total + types + 1)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        counts, ones, twos = {}, {}, {}
        for kind, segment, data, levels in zip(*(right.column(c).to_pylist() for c in ("kind", "segment", "data", "levels"))):
            (ones if kind == 1 else twos)[segment] = levels
            if kind == 1:
                counts[segment] = data
        out = {c: [] for c in names}
        for row in left.to_pylist():
            held, bounds, tokens = unpack(row["held"]).astype(bool), unpack(row["bounds"]), unpack(row["tokens"])
            known = np.frombuffer(row["words"], np.uint64)
            order = np.argsort(segment_of(known, parts), kind="stable")
            exact, one = np.empty(len(known), np.int64), np.empty(len(known))
            exact[order] = _joined(counts)
            one[order] = counts_of(_joined(ones).astype(np.int64))
            index, before, first = sequences(tokens, bounds, known)
            sizes = np.diff(bounds) + 1
            log = np.log10((exact + 1) / norm)
            out["doc_id"] += row["ids"]
            out["held_out"] += held.tolist()
            out["n_tokens"] += sizes.tolist()
            out["n_known"] += np.add.reduceat((exact > 0)[index].astype(np.int64), first).tolist()
            out["train_tokens"] += [total] * len(held)
            out["base_score"] += np.add.reduceat(log[index], first).tolist()
            context = np.empty(len(index))
            context[1:] = one[index[:-1]]
            context[first] = one[-1]  # as many beginnings as ends
            _, back = np.unique(pair_hash(before, known[index]), return_inverse=True)
            pair = np.minimum(counts_of(_joined(twos).astype(np.int64))[back], context)
            single = ((one + 1) / norm)[index]
            chance = np.where(context > 0, share * pair / np.maximum(1, context) + (1 - share) * single, single)
            out["score"] += np.add.reduceat(np.log10(chance), first).tolist()
        return pa.table([pa.array(out[c], kinds[c]) for c in names], names=list(names))

    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    names = list(kinds)
    left = blocks.select("block", "ids", "held", "bounds", "tokens", "words").groupBy("block")
    return left.cogroup(answers.groupBy("block")).applyInArrow(work, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _joined(answers: dict[int, bytes]) -> np.ndarray:
    """A block's answers, one segment after another."""
    return np.concatenate([unpack(answers[s]) for s in sorted(answers)])
