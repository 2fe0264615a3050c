"""Documents drawn by importance, towards the word frequencies of a target.

1. Every document and target text is cut into features, runs of words hashed into buckets.  What
   a bucket is worth, the gain, is the logarithm of how much more frequent it is in the target.
2. Numpy arrays of buckets are looked up in the array of gains; their floored mean is a
   document's weight.  The score adds noise from a hash of the id, so that the highest scores
   are a draw without replacement in proportion to the weights.
3. The score down to which documents are drawn is found without sorting them all: a quantile
   sketch gives a bracket around it, counts of the documents outside prove that the cutoff lies
   within or widen the bracket, and only the bracket is sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .common import NULL_ID, chunks, split_points
from .ranked import ranked

BUCKETS = 10_000
ORDER = 1  # words of the longest run
SEED = 2024
LEAST_WORDS = 20  # of a document that may be drawn
PERCENT = 10  # of them that are drawn
ACCURACY = 10_000  # the sketch's rank error is one part in so many
MARGIN = 0.0005  # of the ranks, on each side of the cutoff, that the first bracket takes
SHORT = 32  # bytes of a word that are hashed side by side with the others

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Digits, letters, and all bytes of letters beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_steps() -> np.ndarray:
    """What crc32 does with each value of its lowest byte."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, steps >> 1 ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


_STEPS = _crc_steps()


def words_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, where each word starts, its length, and each text's first word."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    raw, bounds = _LOWER[raw], offsets - offsets[0]
    inside = np.append(_INSIDE[raw], False)
    first, last = inside.copy(), ~inside
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1]
    first[heads] = inside[heads]
    last[heads] = True  # a word ends with its text
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    ends = ends[np.searchsorted(ends, starts, "right")] if len(starts) else starts
    return raw, starts, ends - starts, np.searchsorted(starts, bounds)


def crc_on(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``zlib.crc32`` of many slices at once, each going on from its ``state`` (0 at the beginning)."""
    by_length = np.argsort(-np.minimum(lengths, SHORT + 1).astype(np.int16), kind="stable")
    at = starts[by_length]
    many = np.searchsorted(-lengths[by_length], -np.arange(SHORT), "left")  # so many are longer than n
    value = ~state[by_length]
    longer = np.flatnonzero(lengths[by_length] > SHORT)
    for n, now in enumerate(many.tolist()):
        if not now:
            break
        part = value[:now]
        value[:now] = _STEPS[(part ^ raw[at[:now] + n]) & 0xFF] ^ part >> 8
    value = ~value
    for k in longer.tolist():
        low, size = int(at[k]), int(lengths[by_length[k]])
        value[k] = zlib.crc32(raw[low : low + size].tobytes(), int(state[by_length[k]]))
    result = np.empty_like(value)
    result[by_length] = value
    return result


def buckets_of(column: pa.Array, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features, text by text; where each text's begin; each text's words.

    Features are all runs of 1 to ``order`` words, joined by one space, as often as they come.
    """
    raw, starts, lengths, at = words_in(column)
    words = np.diff(at)
    found, owners = [], []
    state, owner = np.zeros(len(starts), np.uint32), np.repeat(np.arange(len(words)), words)
    space = np.array([0x20], np.uint8)
    for run in range(order):
        if run:
            keep = np.flatnonzero(owner[run:] == owner[: len(owner) - run]) if run < len(owner) else np.zeros(0, int)
            # The runs that have one more word behind them in their text.
            heads = keep if run == 1 else np.intersect1d(keep, heads, assume_unique=True)
            state = full[heads]
            state = crc_on(state, space, np.zeros(len(heads), np.int64), np.ones(len(heads), np.int64))
            value = crc_on(state, raw, starts[heads + run], lengths[heads + run])
        else:
            heads, value = np.arange(len(starts)), crc_on(state, raw, starts, lengths)
        full = np.zeros(len(starts), np.uint32)
        full[heads] = value
        found.append(value % buckets)
        owners.append(owner[heads])
    owner = np.concatenate(owners)
    by_text = np.argsort(owner, kind="stable") if order > 1 else slice(None)
    counts = np.bincount(owner, minlength=len(words))
    return np.concatenate(found)[by_text].astype(np.int64), split_points(counts), words


def _counted(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in chunks(batches, "text", 1 << 20):
            total += np.bincount(buckets_of(batch.column("text"), order, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; each task sends its own sums."""
    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(_counted(order, buckets), "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket
        total[bucket] = n
    return total


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For each bucket the floor of 1000 times the log of its frequency in the target to that in all."""
    size, all_t, all_s = len(raw), int(target.sum()), int(raw.sum())
    pairs = zip(target.tolist(), raw.tolist())
    worth = [1000 * math.log((t + 1) * (all_s + size) / ((s + 1) * (all_t + size))) for t, s in pairs]
    return np.array([math.floor(w) for w in worth], np.int64)


def _weighed(gain: np.ndarray, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            which, at, words = buckets_of(batch.column("text"), order, len(gain))
            total = split_points(gain[which])[at]
            n = np.diff(at)
            weight = np.where(n > 0, np.diff(total) // np.maximum(n, 1), 0)
            columns = [batch.column("doc_id"), pa.array(n), pa.array(weight), pa.array(words.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "weight", "words"])

    return run


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from a hash of the seed and the key; a null key counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    number = F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((number + 0.5) / F.lit(4294967296.0))))


def scored(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    order: int = ORDER,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, words`` of every row."""
    gain = gains(bucket_counts(target, target_col, order, buckets), bucket_counts(docs, text_col, order, buckets))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_weighed(gain, order), "doc_id long, n_features long, weight long, words long")
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    return rows.select("doc_id", "n_features", "weight", score.alias("score"), "words")


def _order() -> list[Column]:
    """The highest score first, then the least id (null before all), then what else tells rows apart."""
    return [F.col("score").desc(), F.coalesce("doc_id", F.lit(NULL_ID)), F.col("n_features"), F.col("words")]


def bracket(rows: DataFrame, wanted: int, size: int) -> tuple[int | None, int | None, int]:
    """Scores between which the ``wanted``-th highest of ``size`` lies, and the rows above them.

    None is no bound.  The sketch only proposes: the rows outside are counted exactly, and the
    bracket is widened until they prove that it holds the cutoff.
    """
    margin = MARGIN
    while margin < 1:
        ranks = [1 - wanted / size + step for step in (-margin, margin)]
        inner = [min(max(r, 0.0), 1.0) for r in ranks]
        low, high = rows.agg(F.percentile_approx("score", inner, ACCURACY)).first()[0]
        low = None if ranks[0] <= 0 else low
        high = None if ranks[1] >= 1 else high
        over = F.lit(False) if high is None else F.col("score") > high
        under = F.lit(False) if low is None else F.col("score") < low
        above, below = rows.agg(F.count_if(over), F.count_if(under)).first()
        if above < wanted <= size - below:
            return low, high, above
        margin *= 8
    return None, None, 0


def drawn(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every row of ``scores`` with its ``rank`` among the drawn, null if it was not drawn.

    ``floor(percent * N / 100)`` of the N documents with enough words are drawn, those of the
    highest score, of equal ones the least id.  Rows alike in all columns are drawn one by one.
    """
    may = F.col("words") >= least_words
    rows = scores.filter(may)
    size = rows.count()
    wanted = percent * size // 100
    out = scores.columns
    if not wanted:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    low, high, above = bracket(rows, wanted, size)
    inside = rows
    if low is not None:
        inside = inside.filter(F.col("score") >= low)
    if high is not None:
        inside = inside.filter(F.col("score") <= high)
    last = ranked(inside.select("score", "doc_id", "n_features", "words"), *_order())
    last = last.filter(F.col("rank") == wanted - above).first()
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate([-F.col("score"), *_order()[1:]])])
    least = F.lit(NULL_ID if last.doc_id is None else last.doc_id)
    edge = [F.lit(-last.score), least, F.lit(last.n_features), F.lit(last.words)]
    taken = may & (key <= F.struct(*[c.cast("long").alias(f"k{i}") for i, c in enumerate(edge)]))
    # Rows like the last one may be more than are wanted.
    first = ranked(scores.filter(taken), *_order())
    first = first.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scores.filter(~taken).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select(*out, "rank")


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, words`` of every row of ``docs``.

    Null and empty texts have no feature, weight 0 and are never drawn; rows that repeat an id
    are rows of their own, with the same noise.  An empty target makes rare buckets worth more,
    empty ``docs`` give no rows.  Other columns of either table are not looked at.
    """
    return drawn(materialised(scored(docs, target, **options), "resampling-scores"))
