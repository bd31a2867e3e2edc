"""Words of Arrow text columns as 64-bit hashes, by numpy over UTF-8 bytes.

Separators are ASCII bytes, so cutting the bytes of a UTF-8 text at them never
cuts a character. Work goes over slices of about ``SLICE`` bytes that end at
separators: temporary memory depends on the slice (and the longest single
word), not on the number or the length of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

#: White space of the contracts' word patterns: blank and \x09-\x0D.
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand and kept for the process."""

    up = _powers(_BASE, SLICE + 4096)
    down = _powers(_INVERSE, SLICE + 4096)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            return _powers(_BASE, n), _powers(_INVERSE, n)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Word hashes of all texts in a row; text i owns ``bounds[i]:bounds[i + 1]``."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(raw: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = BLANKS, fold: np.ndarray | None = LOWER, spans: bool = False) -> Words:
    """Hash every maximal run of bytes that are not ``spaces``, ``fold`` applied
    first. ``spans`` also gives each word's first byte and the byte behind it."""
    hashes, firsts, lasts = [], [], []
    n, at = len(raw), 0
    while at < n:
        to = min(n, at + SLICE)
        if to < n:  # end at a separator or a text's end
            gaps = np.flatnonzero(spaces[raw[at:to]])
            edge = offsets[np.searchsorted(offsets, to, "right") - 1]
            cut = max(int(gaps[-1]) + 1 + at if len(gaps) else at, int(edge))
            if cut > at:
                to = cut
            else:  # one word longer than a slice
                step = to
                while step < n:
                    more = np.flatnonzero(spaces[raw[step : step + SLICE]])
                    if len(more):
                        step += int(more[0])
                        break
                    step = min(n, step + SLICE)
                to = min(step, int(offsets[np.searchsorted(offsets, at, "right")]))
        piece = raw[at:to]
        word = ~spaces[piece]
        inner = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, to, "left")] - at
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        begins[inner] = word[inner]
        closes = word.copy()
        closes[:-1] &= ~word[1:]
        inner = inner[inner > 0] - 1
        closes[inner] = word[inner]
        first, last = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        up, down = _Powers.get(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        values = (fold[piece] if fold is not None else piece).astype(np.uint64)
        values += np.uint64(1)
        values *= up[: len(piece)]
        np.cumsum(values, out=sums[1:])
        hashes.append(mix((sums[last] - sums[first]) * down[first]))
        firsts.append(first + at)
        lasts.append(last + at)
        at = to
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    bounds = np.searchsorted(first, offsets, "left")
    out = Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), bounds)
    if spans:
        out.starts, out.ends = first, np.concatenate(lasts) if lasts else np.zeros(0, np.int64)
    return out


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text. A text with fewer words,
    but not none, has one shingle: the whole sequence."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    out = hashes[: n - width + 1].copy()
    for i in range(1, width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i])
    return out if width == size else mix(out + np.uint64(width))


def rows_by_bytes(offsets: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes, at least one row each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(n, to)
        at = to
