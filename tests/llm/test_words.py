"""Hashed words, blocks and sets of shingles against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestead.llm import blocks, words

TEXT = st.lists(st.text(st.sampled_from("aB é \n\tß😀"), max_size=30), max_size=8)


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
@given(texts=TEXT)
@settings(max_examples=40, deadline=None)
def test_words_are_those_of_the_pattern(size, texts):
    before, words.SLICE = words.SLICE, size
    try:
        raw, offsets = words.utf8(pa.array([*texts, None], pa.string()))
        found = words.hash_words(raw, offsets, spans=True)
    finally:
        words.SLICE = before
    seen = {}
    for i, text in enumerate([*texts, ""]):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        own = re.findall(r"[^\x20\x09-\x0D]+", low)
        hashes = found.hashes[found.bounds[i] : found.bounds[i + 1]]
        assert len(own) == len(hashes)
        for word, value in zip(own, hashes.tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    for a, b in zip(found.starts, found.ends):
        assert raw[a:b].tobytes().strip() == raw[a:b].tobytes() and b > a


def test_shingles():
    h = np.arange(1, 9, dtype=np.uint64)
    assert len(words.shingles(h, 4)) == 5
    assert len(words.shingles(h[:3], 4)) == 1
    assert len(words.shingles(h[:0], 4)) == 0
    assert words.shingles(h[2:6], 4)[0] == words.shingles(h, 4)[2]
    assert words.shingles(h[:3], 4)[0] != words.shingles(h[:4], 4)[0]


def test_row_ranges_cover_all_rows():
    offsets = np.array([0, 5, 5, 30, 31])
    for limit in (1, 6, 100):
        spans = list(words.rows_by_bytes(offsets, limit))
        assert [a for a, _ in spans][0] == 0 and spans[-1][1] == 4
        assert all(b == c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_packing_and_segments():
    for values in (np.zeros(0, np.uint64), np.arange(1000, dtype=np.int32), np.array([True, False]).astype(np.uint8)):
        back = blocks.unpack(blocks.pack(values))
        assert back.dtype == values.dtype and (back == values).all()
    hashes = words.mix(np.arange(1000, dtype=np.uint64))
    assert blocks.segments(100, 10, 3) == 16 and blocks.segments(0, 10, 1) == 1
    order = np.argsort(hashes)
    assert (np.diff(blocks.segment_of(hashes[order], 8)) >= 0).all() and blocks.segment_of(hashes, 1).max() == 0
    distinct, back, first = blocks.dictionary(np.array([5, 7, 5, 9, 5, 7], np.uint64))
    assert distinct.tolist()[0] == 5 and (distinct[back] == [5, 7, 5, 9, 5, 7]).all() and first[0] == 0


def test_grouping_keeps_rows_in_order():
    rows = [pa.record_batch([pa.array(range(i * 10, i * 10 + 10)), pa.array(["x" * (j % 7) if j % 3 else None for j in range(10)])], names=["i", "t"]) for i in range(4)]
    for limit in (1, 10, 10**6):
        tables = list(blocks.grouped(iter(rows), 1, limit))
        assert [x for t in tables for x in t.column("i").to_pylist()] == list(range(40))
