"""Token counts without token ids.

Texts are cut into chunks (white space and what follows it up to the next white
space), which no pre-token of a byte-level vocabulary crosses, and chunks into
pre-tokens. Each distinct pre-token is counted once in the corpus: blocks of texts
send their distinct pre-tokens to segments (ranges of their hashes), a segment
counts the pieces of each one and answers the blocks, and a block sums over its
texts' frequencies. Pre-tokens that are themselves a piece (a fixed vocabulary)
count one where they are found. Each block and segment pass one list of numbers.

Blocks are formed twice, when sending and when summing, from the same rows; a
block's name is a hash of its rows, so that a source that gives other rows the
second time fails instead of giving wrong counts.

Defined results: null text is the empty text with 0 bytes and 0 tokens; a
special token's string inside a text is that token; repeated rows repeat; an empty
table gives an empty one. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.blocks import dictionary, grouped, pack, segment_of, segments, unpack
from lodestead.llm.bpe import BYTE_LEVEL_PATTERN, byte_letters
from lodestead.llm.frames import ids_and_text, map_batches
from lodestead.llm.words import BLANKS, hash_words, mix, utf8

#: Bytes of text whose pre-tokens one segment counts, about.
EACH = 32 << 20
#: Bytes of text in a block.
BLOCK = 8 << 20
_C = np.uint64(0x9E3779B97F4A7C15)
_PATTERN = regex.compile(BYTE_LEVEL_PATTERN)
#: UTF-8 of white space that is not ASCII.
_WIDE_BLANKS = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Pieces:
    """Counts the pieces of pre-tokens of one vocabulary."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        if parsed.get("normalizer") or (parsed.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or parsed["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level vocabularies without normalisation are supported")
        self.model = tokenizers.Tokenizer.from_str(spec).model
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        added = [t["content"] for t in parsed.get("added_tokens") or []]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)).encode()) if added else None
        back = {c: b for b, c in enumerate(letters)}
        whole = {bytes(back[c] for c in t) for t in parsed["model"]["vocab"] if all(c in back for c in t)}
        self.whole = {t for t in whole if self.count(t) == 1}

    def count(self, token: bytes) -> int:
        return len(self.model.tokenize(token.decode("latin-1").translate(self.letters)))


_BUILT: dict[int, Pieces] = {}


def built(spec: str) -> Pieces:
    key = hash(spec)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Pieces(spec)
    return _BUILT[key]


class Block:
    """One block: its texts as known pieces and indexes into its other chunks, these as open pre-tokens."""

    def __init__(self, pieces: Pieces, table: pa.Table):
        raw, offsets = utf8(table.column(1))
        self.bytes = np.diff(offsets)
        self.extra = np.zeros(len(self.bytes), np.int64)
        raw, cuts, owner = self._parts(pieces, raw, offsets)
        words = hash_words(raw, cuts, BLANKS, None, spans=True)
        # each word with the white space before it is a chunk, and so is white space at a part's end
        n = len(words.hashes)
        part = np.searchsorted(cuts, words.starts, "right") - 1
        opens = np.where(np.append(True, part[1:] != part[:-1])[:n], cuts[part], np.append(0, words.ends[:-1])[:n])
        tail = np.flatnonzero(words.bounds[1:] > words.bounds[:-1])
        last = cuts[:-1].copy()
        last[tail] = words.ends[words.bounds[1:][tail] - 1]
        rest = np.flatnonzero(last < cuts[1:])
        begin = np.concatenate([opens, last[rest]])
        order = np.argsort(begin, kind="stable")
        begin = begin[order]
        end = np.concatenate([words.ends, cuts[1:][rest]])[order]
        word = np.concatenate([words.hashes, np.zeros(len(rest), np.uint64)])[order]
        gap = np.concatenate([words.starts, cuts[1:][rest]])[order] - begin
        part = np.concatenate([part, rest])[order]
        lead = np.where(gap > 0, raw[np.minimum(begin, max(0, len(raw) - 1))], 0).astype(np.uint64) if len(raw) else np.zeros(0, np.uint64)
        for i in np.flatnonzero(gap > 1):  # seldom: longer white space
            lead[i] = np.uint64(256 + zlib.crc32(raw[begin[i] : begin[i] + gap[i]].tobytes()))
        keys = mix(word * _C + lead)
        joined = np.zeros(len(begin), bool)  # chunks that go on one that ends with other white space
        for at in (m.end() for m in _WIDE_BLANKS.finditer(raw.tobytes())):
            i = int(np.searchsorted(begin, at, "left"))
            if i < len(begin) and begin[i] == at and i and part[i] == part[i - 1]:
                joined[i] = True
        if joined.any():
            first = np.flatnonzero(~joined)
            end = end[np.append(first[1:], len(begin)) - 1]
            begin, part, keys = begin[first], part[first], keys[first]
            for i in np.flatnonzero(np.diff(np.append(first, len(joined))) > 1):
                keys[i] = np.frombuffer(hashlib.blake2b(raw[begin[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
        keys, self.tokens, first = dictionary(keys)
        self.sizes = np.bincount(owner[part], minlength=len(self.bytes)) if len(part) else np.zeros(len(self.bytes), np.int64)
        known, opened, unknown = np.zeros(len(keys), np.int64), [], {}
        whole, of, find = pieces.whole, [], _PATTERN.findall
        for i, (a, b) in enumerate(zip(begin[first].tolist(), end[first].tolist())):
            text = raw[a:b].tobytes()
            if text in whole:
                known[i] = 1
                continue
            simple = text[0] == 32 and text[1:].isalpha() or text.isalpha()  # ASCII letters: one pre-token
            for token in [text] if simple else [t.encode() for t in find(text.decode())]:
                if token in whole:
                    known[i] += 1
                else:
                    opened.append(unknown.setdefault(token, len(unknown)))
                    of.append(i)
        # what is known already is summed here; only chunks with open pre-tokens stay in the sequences
        ends = np.cumsum(self.sizes)
        sums = np.append(0, np.cumsum(known[self.tokens]))
        self.extra += sums[ends] - sums[ends - self.sizes]
        of = np.array(of, np.int64)
        still = np.bincount(of, minlength=len(keys)) > 0
        place = np.cumsum(still) - 1
        left = still[self.tokens]
        sums = np.append(0, np.cumsum(left))
        self.sizes = sums[ends] - sums[ends - self.sizes]
        self.tokens = place[self.tokens[left]]
        self.opened, self.of = np.array(opened, np.int64), place[of]
        self.unknown = list(unknown)
        data = np.frombuffer(b"".join(t + b" " for t in self.unknown), np.uint8)
        bounds = np.cumsum([0, *(len(t) + 1 for t in self.unknown)])
        self.hashes = hash_words(data, bounds, np.zeros(256, bool), None).hashes  # no byte separates them
        ids = np.array([0 if i is None else i for i in table.column(0).to_pylist()], np.int64).view(np.uint64)
        self.name = int(mix(np.array([np.bitwise_xor.reduce(mix(ids * _C + np.arange(len(ids), dtype=np.uint64))) + np.bitwise_xor.reduce(mix(keys)) + np.uint64(len(raw))], np.uint64)).view(np.int64)[0])

    def _parts(self, pieces: Pieces, raw: np.ndarray, offsets: np.ndarray):
        """The texts cut at special tokens, which are counted: (bytes, cuts, row of each part)."""
        found = list(pieces.special.finditer(raw.tobytes())) if pieces.special is not None else []
        inside = []
        for m in found:
            row = int(np.searchsorted(offsets, m.start(), "right")) - 1
            if m.end() <= offsets[row + 1]:
                inside.append((m.start(), m.end(), row))
        if not inside:
            return raw, offsets, np.arange(len(offsets) - 1)
        kept, cuts, owner, at = [], [0], [], 0
        stops = sorted([(int(o), int(o), i) for i, o in enumerate(offsets[1:])] + [(a, b, -1) for a, b, _ in inside])
        row = size = 0
        for a, b, ends in stops:
            kept.append(raw[at:a])
            size += a - at
            cuts.append(size)
            owner.append(row)
            if ends < 0:
                self.extra[row] += 1
            else:
                row += 1
            at = b
        return np.concatenate(kept), np.array(cuts), np.array(owner)

    def split(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the open pre-tokens by segment, and where each segment begins in it."""
        segment = segment_of(self.hashes, parts)
        order = np.argsort(segment, kind="stable")
        return order, np.searchsorted(segment[order], np.arange(parts + 1))

    def totals(self, counts: np.ndarray) -> np.ndarray:
        """Tokens of each text, given the pieces of the open pre-tokens."""
        each = np.bincount(self.of, counts[self.opened]).astype(np.int64)
        sums = np.append(0, np.cumsum(each[self.tokens]))
        ends = np.cumsum(self.sizes)
        return sums[ends] - sums[ends - self.sizes] + self.extra


def count(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.
    ``path`` names the vocabulary on the driver."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    rows = ids_and_text(docs)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = segments(int(size), EACH, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def send(batches):
        pieces = built(shared.value)
        for table in grouped(batches, 1, BLOCK):
            block = Block(pieces, table)
            order, ends = block.split(parts)
            some = np.flatnonzero(np.diff(ends))
            tokens = [block.unknown[i] for i in order]
            yield {"segment": some, "block": [block.name] * len(some), "tokens": [tokens[ends[s] : ends[s + 1]] for s in some]}

    def answer(table: pa.Table) -> pa.Table:
        pieces = built(shared.value)
        lists = table.column("tokens").combine_chunks()
        distinct = lists.flatten().dictionary_encode()
        counts = np.array([pieces.count(t) for t in distinct.dictionary.to_pylist()], np.int64)
        each = counts[distinct.indices.to_numpy()]
        each = each.astype(np.uint8) if each.max(initial=0) < 256 else each
        cuts = np.cumsum(pc.list_value_length(lists).to_numpy())
        return pa.table([table.column("block"), table.column("segment"), pa.array([pack(a) for a in np.split(each, cuts[:-1])], pa.binary())], names=["block", "segment", "counts"])

    def form(batches):
        pieces = built(shared.value)
        for table in grouped(batches, 1, BLOCK):
            block = Block(pieces, table)
            names = "of opened sizes tokens bytes extra".split()
            small = {n: pack(_small(getattr(block, n))) for n in names}
            order, ends = block.split(parts)
            yield {"block": [block.name], "ids": [table.column(0).to_pylist()], "order": [pack(_small(order))], "sent": [np.flatnonzero(np.diff(ends)).tolist()], **{n: [v] for n, v in small.items()}}

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = dict(zip(right.column("segment").to_pylist(), right.column("counts").to_pylist()))
        for row in left.to_pylist():
            block = Block.__new__(Block)
            for n in "of opened sizes tokens bytes extra".split():
                setattr(block, n, unpack(row[n]).astype(np.int64))
            if set(row["sent"]) - set(answers):
                raise RuntimeError("the documents changed between two readings")
            counts = np.zeros(len(row["order"]) and len(order := unpack(row["order"])), np.int64)
            if len(counts):
                counts[order] = np.concatenate([unpack(answers[s]) for s in row["sent"]])
            n = block.totals(counts)
            out.append(pa.table([pa.array(row["ids"], pa.int64()), pa.array(block.bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]))
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
        return pa.concat_tables(out) if out else schema.empty_table()

    sent = map_batches(rows, send, "segment int, block long, tokens array<binary>")
    answers = sent.groupBy("segment").applyInArrow(answer, "block long, segment int, counts binary")
    left = map_batches(rows, form, "block long, ids array<long>, order binary, sent array<int>, of binary, opened binary, sizes binary, tokens binary, bytes binary, extra binary")
    return left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if len(x) and x.max() < 1 << 31 else x
