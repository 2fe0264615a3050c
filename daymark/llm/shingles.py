"""Distinct word shingles of many texts at once, as sorted 64-bit hashes.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z in lower case.  A text of
fewer words than a shingle has its whole word sequence as its one shingle; a text without
words, or null, has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import split_points, worker_cache

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_LOWER[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
STEP = 1 << 18  # the tables grow by so many entries
OTHER_BASE = 0xD1342543DE82EF95  # for a second, independent hash
_made: dict[int, list[np.ndarray]] = worker_cache("shingles")
_PLACES = np.array(
    [0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3],
    np.uint64,
)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(size: int, base: int = _BASE) -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, for so many bytes and one."""
    if base not in _made or len(_made[base][0]) <= size:
        length = (size // STEP + 1) * STEP
        _made[base] = []
        for factor in (base, pow(base, -1, 1 << 64)):
            factors = np.full(length, factor, np.uint64)
            factors[0] = 1
            _made[base].append(np.cumprod(factors))
    return _made[base]


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where every word starts and ends, and where each text's words start."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    inside = np.append(~_SPACE[raw], False)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    last = ~inside
    last[heads] = True
    # A word ends at the first white byte or text start behind its own start.
    ends = np.flatnonzero(inside[:-1] & last[1:]) + 1
    return raw, starts, ends, np.searchsorted(starts, bounds)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """The hash of each span of bytes, A-Z taken as lower case."""
    powers, inverse = _tables(len(raw), base)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWER[raw] * powers[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and where each text's words start (one more entry than texts)."""
    raw, starts, ends, at = word_spans(column)
    return span_hashes(raw, starts, ends), at


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes, ascending within each text, and where each text's start."""
    hashes, at = word_hashes(column)
    counts = np.diff(at)
    made = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), made)
    first = np.arange(len(owner)) - np.repeat(split_points(made)[:-1], made) + at[:-1][owner]
    reach = np.minimum(counts, words)[owner]
    total = reach.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(words if len(owner) else 0):
        part = (hashes ^ (hashes >> np.uint64(29))) * _PLACES[k % 5]
        part = part[np.minimum(first + k, len(hashes) - 1)]
        part[reach <= k] = 0
        total = total * np.uint64(_BASE) + part
    total = mixed(total)
    for low, high in zip(*(split_points(made)[k:][: len(made)].tolist() for k in (0, 1))):
        total[low:high].sort()
    keep = np.ones(len(total), bool)
    keep[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    total, owner = total[keep], owner[keep]
    return total, np.searchsorted(owner, np.arange(len(counts) + 1))
