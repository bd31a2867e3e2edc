"""Blocks of documents as index sequences over their own dictionaries.

A block holds some ``BLOCK`` bytes of consecutive texts: the distinct words once,
and each text as indexes into them. What a whole corpus knows of a word comes to
the blocks by segments, ranges of the words' hashes: every block sends each
segment the words that fall into it, a segment's task merges the blocks' lists and
answers each block with a list in the same order. So a word costs one entry for
each block that has it, however often it occurs, and no word is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 16 << 20


def grouped(batches: Iterator[pa.RecordBatch], text: int, limit: int = BLOCK) -> Iterator[pa.Table]:
    """The rows of a task in tables of about ``limit`` bytes of text, at least one row each."""
    held, size = [], 0
    for batch in batches:
        column = batch.column(text)
        sizes = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            before = int(sizes[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + limit - size, "right")))
            if to < len(batch) or size + int(sizes[to - 1]) - before >= limit:
                yield pa.Table.from_batches([*held, batch.slice(at, to - at)])
                held, size = [], 0
            else:
                held.append(batch.slice(at, to - at))
                size += int(sizes[to - 1]) - before
            at = to
    if held:
        yield pa.Table.from_batches(held)


def pack(values: np.ndarray) -> bytes:
    """An array as compressed bytes, with its type and length."""
    data = np.ascontiguousarray(values)
    head = f"{data.dtype.str}{len(data)};".encode()
    return head + pa.compress(data.tobytes(), codec="zstd", asbytes=True) if len(data) else head


def unpack(data: bytes) -> np.ndarray:
    cut = data.index(b";")
    kind, n = np.dtype(data[:3].decode()), int(data[3:cut])
    if not n:
        return np.zeros(0, kind)
    return np.frombuffer(pa.decompress(data[cut + 1 :], n * kind.itemsize, codec="zstd", asbytes=True), kind)


def segments(total: int, each: int, least: int) -> int:
    """A power of two: enough segments for about ``each`` of ``total`` entries, and ``least`` at least."""
    return 1 << (max(least, total // each, 1) - 1).bit_length()


def segment_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The segment of each hash: its leading bits."""
    bits = n.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def dictionary(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, most frequent first, the index of each value and the place of each distinct one's first."""
    distinct, first, back, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return distinct[order], rank[back], first[order]


def new_block(ids: list, partition: int, seq: int) -> int:
    return (partition << 32) | seq
