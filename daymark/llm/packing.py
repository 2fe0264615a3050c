"""Packing token sequences into windows by non-negative least squares over length combinations.

A text longer than a window fills windows of its own; what remains of it has a length below the
window.  The histogram of those lengths, at most ``window`` numbers, is all the planner sees:

1. Shallow combinations of lengths that fill a window exactly are enumerated: pairs, triples,
   and one length repeated with another behind it.
2. Non-negative least squares finds how often to repeat each, so that the lengths used up come
   close to the histogram.  The counts are rounded down to what is there.
3. What remains is packed greedily, the longest first, a combination as often as it can be
   repeated.  A gap that no length fits is filled with the start of a longer piece.

The plan says, for the n-th text of a length, in which window it lies and where.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .common import chunks, crc_of, ragged, trimmed
from .tokens import default_path, encoder, with_end

WINDOW = 2048
END = 1
TRIPLES = 1 << 16  # pairs of shorter lengths that are tried for a third one, about
LEAST_CUT = 16  # a gap of so many tokens is worth cutting a piece
GROUP = 1000  # texts of one length that are numbered in one go
GROUPS = 1_000_000  # and about so many groups at most


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to four columns ``a, times of a, b, c`` (0: none) that fill a window."""
    here = np.zeros(window + 1, bool)
    here[lengths] = True
    rows = []
    for times in range(1, window):
        a = lengths[lengths * times <= window]
        if not len(a):
            break
        rest = window - a * times
        ok = (rest == 0) | here[rest] & (rest != a)
        if times == 1:
            ok &= a > rest
        rows.append(np.stack([a, np.full_like(a, times), rest, np.zeros_like(a)], 1)[ok])
    # Triples a < b < c: all, or if there are too many those of every so many-th length a present.
    shortest = lengths[lengths * 3 < window]
    tries = np.searchsorted(lengths, (window - shortest + 1) // 2) - np.arange(len(shortest)) - 1
    step = max(1, -(-int(np.maximum(tries, 0).sum()) // TRIPLES))
    for a in shortest[::step].tolist():
        b = lengths[(lengths > a) & (2 * lengths < window - a)]
        c = window - a - b
        b, c = b[here[c]], c[here[c]]
        rows.append(np.stack([np.full_like(b, a), np.ones_like(b), b, c], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)


def repeats(combos: np.ndarray, histogram: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Non-negative least squares of ``sum(repeat * combination) = histogram``.

    Multiplicative updates keep the counts non-negative and lower the error in every round.
    """
    times = np.stack([combos[:, 1], combos[:, 2] > 0, combos[:, 3] > 0], 1).astype(float)
    at = combos[:, [0, 2, 3]]
    wanted = histogram.astype(float)
    wanted[0] = 0
    pull = (wanted[at] * times).sum(1)
    x = pull / (times.sum(1) ** 2 + 1)
    for _ in range(rounds):
        used = np.bincount(at.ravel(), (times * x[:, None]).ravel(), len(histogram))
        used[0] = 0
        x *= pull / np.maximum((used[at] * times).sum(1), 1e-9)
    return x


class Plan:
    """Where the texts of each length go; filled by ``plan``."""

    def __init__(self, window: int) -> None:
        self.bits = window.bit_length()
        self.rows: list[tuple] = []  # length, part start, first number, end, part length, window, offset
        self.windows = 0

    def key(self, length, start, number):
        """Orders by length, part and number; with a window of 2048 there is room for 2**39 numbers."""
        return ((length << self.bits | start) << 63 - 2 * self.bits) | number

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 7)
        return self.key(rows[:, 0], rows[:, 1], rows[:, 2]), rows


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """``histogram[n]``: how many remainders have length ``n``, below the window."""
    made = Plan(window)
    # For each length what is left: ranges of texts, and where in the remainder the part starts.
    supply: dict[int, deque] = defaultdict(deque)
    left = np.zeros(window + 1, np.int64)
    for n in np.flatnonzero(histogram).tolist():
        supply[n].append((n, 0, 0, int(histogram[n])))
        left[n] = histogram[n]

    def place(parts: list[tuple[int, int]], count: int) -> None:
        """Windows that each take, per part, one piece of the length; shorter by a cut if asked."""
        offset = 0
        for n, size in parts:
            need, first = count, made.windows
            while need:
                origin, start, low, high = supply[n].popleft()
                now = min(need, high - low)
                made.rows.append((origin, start, low, low + now, size, first, offset))
                if low + now < high:
                    supply[n].appendleft((origin, start, low + now, high))
                if size < n:
                    supply[n - size].append((origin, start + size, low, low + now))
                    left[n - size] += now
                need, first = need - now, first + now
            left[n] -= count
            offset += size
        made.windows += count

    lengths = np.flatnonzero(histogram).astype(np.int64)
    combos = combinations(lengths, window)
    if len(combos):
        x = repeats(combos, histogram)
        for k in np.argsort(-x, kind="stable")[: int((x >= 1).sum())].tolist():
            a, times, b, c = combos[k].tolist()
            parts = [(a, a)] * times + [(n, n) for n in (b, c) if n]
            count = min([int(x[k]), left[a] // times, *(left[n] for n in (b, c) if n)])
            if count > 0:
                place(parts, int(count))
    while left.any():
        parts, used, gap = [], defaultdict(int), window
        free = left.copy()
        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            n = int(fits[-1])
            times = min(gap // n, int(free[n]))
            parts += [(n, n)] * times
            used[n] += times
            free[n] -= times
            gap -= n * times
        longer = np.flatnonzero(free[gap + 1 :])
        if gap >= LEAST_CUT and longer.size:
            n = int(gap + 1 + longer[-1])
            parts.append((n, gap))
            used[n] += 1
        place(parts, int(min(left[n] // times for n, times in used.items())))
    return made


# ---- the texts


def _tokenised(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in chunks(batches, "text", 1 << 19):
            ids, at = with_end(*words.encode(batch.column("text")), end)
            kind = np.dtype("<u2") if words.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else np.dtype("<u4")
            data, width = ids.astype(kind).tobytes(), kind.itemsize
            cells = [data[low * width : high * width] for low, high in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(cells, pa.binary())], ["doc_id", "n", "ids"]
            )

    return trimmed(run, "words", "shingles")


def ids_in(cell: bytes, n: int) -> np.ndarray:
    return np.frombuffer(cell, "<u2" if len(cell) == 2 * n else "<u4")


PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pieces(made: Plan, groups: dict, window: int):
    """Rows come by remainder and group, in a fixed order; their numbers go on from the group's first."""

    keys, rows = made.arrays()
    key, windows = made.key, made.windows
    made.rows = []  # they travel as arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, full = None, 0, 0
        for batch in chunks(batches, "ids", 8 << 20):
            columns = [batch.column(k).to_pylist() for k in ("doc_id", "n", "ids", "rest", "bucket")]
            out = []
            for doc, n, cell, rest, bucket in zip(*columns):
                if (rest, bucket) != now:
                    now = (rest, bucket)
                    number, full = groups[now]
                width = len(cell) // n
                for k in range(n // window):
                    low = k * window
                    out.append((doc, low, window, n, windows + full + k, 0, cell[low * width : (low + window) * width]))
                full += n // window
                begin, done = n - rest, 0
                while done < rest:
                    at = np.searchsorted(keys, key(rest, done, number), "right") - 1
                    _, _, low, _, size, first, offset = rows[at].tolist()
                    cut = cell[(begin + done) * width : (begin + done + size) * width]
                    out.append((doc, begin + done, size, n, first + number - low, offset, cut))
                    done += size
                number += 1
            names = [c.split()[0] for c in PIECE.split(", ")]
            kinds = [pa.int64()] * 6 + [pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return trimmed(run)  # no encoder is needed from here on


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    end: int = END,
    window: int = WINDOW,
) -> DataFrame:
    """The pieces of all texts: where they come from, where they lie, and their ids.

    Every text is its ids and ``end``; null text counts as empty, so it is ``end`` alone.  Rows
    that repeat an id are packed each.  A sequence's offsets run from 0 without a gap; what is
    missing to the window is padding.  Texts of one length are numbered in groups of about
    ``GROUP``, so a length that very many texts share does not meet in one task.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tokens = texts.mapInArrow(_tokenised(path or default_path(), end), "doc_id long, n long, ids binary")
    tokens = materialised(tokens.withColumn("rest", (F.col("n") % window).cast("int")), "pack-tokens")

    histogram = np.zeros(window, np.int64)
    for rest, count in tokens.groupBy("rest").count().collect():
        histogram[rest] = count
    per_group = max(GROUP, int(histogram.sum()) // GROUPS)
    split = F.array(*[F.lit(int(max(1, -(-n // per_group)))) for n in histogram])
    bucket = F.pmod(F.xxhash64("doc_id"), split[F.col("rest")]).cast("int")
    tokens = tokens.withColumn("bucket", bucket)
    sizes = tokens.groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.floor(F.col("n") / window)))
    groups, number, full = {}, defaultdict(int), 0
    for rest, k, count, whole in sorted(sizes.collect()):
        groups[rest, k] = (number[rest], full)
        number[rest] += count
        full += whole
    histogram[0] = 0
    made = plan(histogram, window)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartition(width, "rest", "bucket").sortWithinPartitions("rest", "bucket", "doc_id", "n", "ids")
    return ordered.mapInArrow(_pieces(made, groups, window), PIECE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "ids", 1 << 20):
        cells = zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist())
        crc = pa.array([crc_of(ids_in(cell, n)) for cell, n in cells], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], crc], [*batch.schema.names[:6], "ids_crc32"])


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids, as little-endian 32-bit numbers, in place of the ids."""
    return pieces.mapInArrow(_digests, PIECE.replace("ids binary", "ids_crc32 long"))
