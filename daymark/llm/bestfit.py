"""Packing by bulk-synchronous best fit: all documents and gaps are matched at once, round by round.

A text longer than a sequence fills sequences of its own; what remains of it, its first piece, is
shorter than a sequence and has to find a place.  Up to ``window // 2 // n`` remainders of the
same length n go together as one unit, so that very many short texts do not take as many rounds.

In every round units and gaps are put in order by size, a gap before a unit that it just fits,
and swept from the largest size down: a unit takes the nearest gap before it that no larger unit
has taken, which is the smallest one that it fits.  As in matching brackets, the place of a gap
in the stack of open gaps is its rank, and so is that of the gap a unit asks for; so the sweep is
one sort within equal ranks, spread over all tasks.  Only the numbers of units and gaps of each
size, at most twice ``window`` of them, reach the driver.  Each gap is taken once; units that ask
for the same size are told apart by rank, and those left over come again in the next round with
the gaps as they are by then.  A unit of several texts that found no gap is halved.  New
sequences are begun only if the gaps cannot hold what is left, with the largest units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from .bytelevel import byte_encoder
from .common import chunks, crc_of, texts_of
from .tokens import default_path

WINDOW = 1024
END = 2
FILE = "byte_bpe_50k.json"
GROUP = 1_000_000  # rows of one size that are numbered in one task


def _tokenised(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_encoder(path)
        kind = np.dtype("<u2") if max(words.size, end + 1) <= 1 << 16 else np.dtype("<u4")
        for batch in chunks(batches, "text", 1 << 20):
            cells = [np.array([*words.encode(t), end], kind).tobytes() for t in texts_of(batch.column("text"))]
            sizes = pa.array([len(c) // kind.itemsize for c in cells], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(cells, pa.binary())], ["doc_id", "n", "ids"])

    return run


def _numbers(values, size: str) -> Column:
    """The entry of a list for the value of a column ``size``."""
    return F.expr(f"element_at(array({', '.join(f'{v}L' for v in values)}), {size} + 1)")


def numbered(rows: DataFrame, keys: list[str], order: list[str], counts: dict[tuple, int], add: str | None = None):
    """``rows`` with ``rank`` 0, 1, 2... among those of equal ``keys``, and the groups they were
    numbered in: ``keys, bucket`` with ``before``, the rank of their first.

    ``counts`` has the rows of each key, small ones need not be in it; one with more than
    ``GROUP`` is cut into buckets by a hash.  ``add`` is a column whose sums are wanted by group.
    """
    spark = rows.sparkSession
    hot = {k: -(-n // GROUP) for k, n in counts.items() if n > GROUP}
    bucket = F.lit(0)
    for key, parts in hot.items():
        same = F.lit(True)
        for name, value in zip(keys, key):
            same &= F.col(name) == value
        bucket = F.when(same, F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket)
    window = Window.partitionBy(*keys, "bucket").orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(window) - F.lit(1).cast("long"))
    if add:
        ranked = ranked.withColumn("added", F.coalesce(F.sum(add).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    groups = []
    if hot or add:
        sums = F.sum(add) if add else F.lit(0)
        found = rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), sums.alias("add")).collect()
        now, number, total = None, 0, 0
        for r in sorted(tuple(r) for r in found):
            key, (part, n, more) = r[: len(keys)], r[len(keys) :]
            number = number if key == now else 0
            groups.append((*key, part, number, total))
            now, number, total = key, number + n, total + (more or 0)
    if not groups:
        return ranked.drop("bucket")
    schema = ", ".join(f"{k} int" for k in [*keys, "bucket"]) + ", before long, sum_before long"
    # One row a size and a further one for every GROUP rows.
    starts = spark.createDataFrame(groups, schema)
    ranked = ranked.join(F.broadcast(starts) if len(groups) < 100_000 else starts, [*keys, "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    if add:
        ranked = ranked.withColumn("added", F.col("added") + F.col("sum_before"))
    return ranked.drop("bucket", "before", "sum_before")


UNIT, GAP = 1, 0


class Sweep:
    """What the numbers of units and gaps of each size say of a round, before any row is moved."""

    def __init__(self, units: np.ndarray, gaps: np.ndarray, window: int):
        self.top = np.zeros(window + 1, np.int64)  # open gaps when the units of a size come
        self.below = np.zeros(window + 1, np.int64)  # and when the gaps of a size come
        self.left = np.zeros(window + 1, np.int64)  # units without a gap
        depth = 0
        for size in range(window, 0, -1):
            self.below[size] = depth
            depth += int(gaps[size])
            self.top[size] = depth
            taken = min(depth, int(units[size]))
            self.left[size] = units[size] - taken
            depth -= taken
        sizes = np.arange(window + 1)
        rest = int((self.left * sizes).sum())
        free = int((gaps * sizes).sum()) - int(((units - self.left) * sizes).sum())
        matched = int((units - self.left).sum())
        # Two units over half a window never share one, and no gap that is left holds such a unit.
        self.opened = max(int(self.left[window // 2 + 1 :].sum()), -(-max(rest - free, 0) // window))
        self.stuck = matched == 0 and self.opened == 0
        self.rest, self.window = rest, window

    def larger(self) -> np.ndarray:
        """For each size the units without a gap that are larger."""
        return np.cumsum(self.left[::-1])[::-1] - self.left


def _counts(state: DataFrame, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Units and gaps of each size, and the shortest text in a unit."""
    units, gaps, least = np.zeros(window + 1, np.int64), np.zeros(window + 1, np.int64), window
    for r in state.groupBy("kind", "size").agg(F.count(F.lit(1)), F.min("ell"), F.max("cnt")).collect():
        kind, size, n, ell, _ = r
        (units if kind == UNIT else gaps)[size] = n
        least = min(least, ell) if kind == UNIT else least
    return units, gaps, least


def _round(state: DataFrame, sweep: Sweep, units: np.ndarray, gaps: np.ndarray, bins: int) -> DataFrame:
    """The rows of ``state`` with what became of them.

    A unit gets ``bin`` and ``offset``, null if it has no place yet.  A gap's ``size`` is what is
    left of it.  A unit that begins a sequence does not bring the gap behind it.
    """
    window = sweep.window
    counts = {(kind, int(n)): int(held[n]) for kind, held in ((UNIT, units), (GAP, gaps)) for n in np.flatnonzero(held)}
    rows = numbered(state, ["kind", "size"], ["bin", "ell", "first"], counts)
    is_unit = F.col("kind") == UNIT
    # A place in the stack of open gaps; none is open where it is below 1.
    depth = F.when(is_unit, _numbers(sweep.top, "size") - F.col("rank")).otherwise(
        _numbers(sweep.below, "size") + F.col("rank") + 1
    )
    rows = rows.withColumn("depth", depth)
    nearby = Window.partitionBy("depth").orderBy(F.col("size").desc(), "kind")
    rows = rows.select(
        "*",
        F.lag("bin").over(nearby).alias("gap"),
        F.lag("size").over(nearby).alias("gap_size"),
        F.lead("kind").over(nearby).alias("next"),
        F.lead("size").over(nearby).alias("next_size"),
    )
    open_ = F.col("depth") >= 1
    index = _numbers(sweep.larger(), "size") - F.col("depth")  # among the units without a gap
    begun = is_unit & ~open_ & (index < sweep.opened)
    bin_ = F.when(is_unit & open_, F.col("gap")).when(begun, F.lit(bins) + index).when(~is_unit, F.col("bin"))
    offset = F.when(is_unit & open_, window - F.col("gap_size")).when(begun, 0)
    taken = ~is_unit & open_ & (F.col("next") == UNIT)
    size = F.when(taken, F.col("size") - F.col("next_size")).otherwise(F.col("size"))
    return rows.select("kind", size.cast("int").alias("size"), "ell", "first", "cnt", bin_.alias("bin"), offset.cast("int").alias("offset"))


def _halves(units: DataFrame) -> DataFrame:
    """Units cut in two where they have several texts."""
    half = F.ceil(F.col("cnt") / 2).cast("int")
    both = F.array(F.struct(F.col("first"), half.alias("cnt")), F.struct((F.col("first") + half).alias("first"), (F.col("cnt") - half).alias("cnt")))
    cut = units.select("ell", F.explode(both).alias("part")).select("ell", "part.first", "part.cnt").filter("cnt > 0")
    return _as_state(cut, UNIT, F.col("ell") * F.col("cnt"), F.lit(None))


def _as_state(rows: DataFrame, kind: int, size: Column, bin_: Column) -> DataFrame:
    one = kind == UNIT
    return rows.select(
        F.lit(kind).alias("kind"),
        size.cast("int").alias("size"),
        *[(F.col(c) if one else F.lit(None)).cast(k).alias(c) for c, k in (("ell", "int"), ("first", "long"), ("cnt", "int"))],
        bin_.cast("long").alias("bin"),
    )


def placed(units: DataFrame, window: int) -> tuple[DataFrame, int]:
    """``ell, first, cnt, bin, offset`` of all units ``ell, first, cnt``, and the number of bins.

    A unit that is halved on the way has a row for each part.
    """
    state = _as_state(units, UNIT, F.col("ell") * F.col("cnt"), F.lit(None))
    found, bins = [], 0
    while True:
        have, gaps, least = _counts(state, window)
        if not have.any():
            break
        sweep = Sweep(have, gaps, window)
        if sweep.stuck:
            # Nothing fits and there is room in all; unless there are units to halve, the largest begin anew.
            several = state.filter(f"kind = {UNIT} AND cnt > 1").limit(1).count()
            sweep.opened = 0 if several else max(1, -(-sweep.rest // window))
        sweep.opened = min(sweep.opened, int(sweep.left.sum()))
        after = materialised(_round(state, sweep, have, gaps, bins), "best-fit-round")
        bins += sweep.opened
        found.append(after.filter(f"kind = {UNIT} AND bin IS NOT NULL").select("ell", "first", "cnt", "bin", "offset"))
        begun = after.filter(f"kind = {UNIT} AND offset = 0")
        # A gap below the shortest text is done with.
        state = (
            _halves(after.filter(f"kind = {UNIT} AND bin IS NULL"))
            .unionByName(_as_state(after.filter(f"kind = {GAP} AND size >= {least}"), GAP, F.col("size"), F.col("bin")))
            .unionByName(_as_state(begun.filter(f"size <= {window - least}"), GAP, window - F.col("size"), F.col("bin")))
        )
    if not found:
        return units.select("ell", "first", "cnt", F.lit(0).cast("long").alias("bin"), F.lit(0).alias("offset")), 0
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result, bins


def pack_best_fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    end: int = END,
    window: int = WINDOW,
) -> DataFrame:
    """``doc_id, piece, start, length, sequence_id, offset, ids`` of every piece of every text.

    Every text is its ids and ``end``; null text counts as empty, so it is ``end`` alone.  Texts
    longer than ``window`` are cut into pieces of that length, the first of which may be shorter;
    others are whole.  Rows that repeat an id are packed each, an empty table gives no rows, and
    other columns are not looked at.  Offsets in a sequence run from 0 without a gap; ``ids`` are
    little-endian numbers of 16 bits, or 32 where the vocabulary needs them.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = texts.mapInArrow(_tokenised(path or default_path(FILE), end), "doc_id long, n long, ids binary")
    # Numbers that rows keep, as they are written once; equal rows are told apart by them.
    tokens = materialised(tokens.withColumn("row", F.monotonically_increasing_id()), "best-fit-tokens")
    slim = tokens.select("row", (F.col("n") % window).cast("int").alias("ell"), F.floor(F.col("n") / window).alias("whole"))
    counts = {(r[0],): r[1] for r in slim.groupBy("ell").count().collect()}
    items = materialised(numbered(slim, ["ell"], ["row"], counts, add="whole"), "best-fit-items")
    # The first of each unit stands for it.
    several = F.greatest(F.lit(1), F.floor(F.lit(window // 2) / F.col("ell")))
    have = _numbers([counts.get((n,), 0) for n in range(window)], "ell")
    heads = items.filter("ell > 0").withColumn("several", several).filter("rank % several = 0")
    units = heads.select("ell", F.col("rank").alias("first"), F.least("several", have - F.col("rank")).cast("int").alias("cnt"))
    where, bins = placed(units, window)
    one = where.select("ell", "first", "bin", "offset", F.explode(F.sequence(F.lit(0), F.col("cnt") - 1)).alias("k"))
    one = one.select(
        "ell",
        (F.col("first") + F.col("k")).alias("rank"),
        "bin",
        (F.col("offset") + F.col("k") * F.col("ell")).alias("offset"),
    )
    places = items.join(one, ["ell", "rank"], "left").select("row", "ell", "whole", "added", "bin", "offset")
    rows = tokens.join(places, "row")
    # The remainder is the first piece, whole windows follow.
    has_rest = (F.col("ell") > 0).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col("whole") + has_rest - 1).cast("int"))))
    is_rest = (F.col("ell") > 0) & (F.col("piece") == 0)
    number = F.col("piece") - has_rest  # of the whole window
    start = F.when(is_rest, 0).otherwise(F.col("ell") + number * window).cast("long")
    length = F.when(is_rest, F.col("ell")).otherwise(window).cast("long")
    width = (F.length("ids") / F.col("n")).cast("int")
    rows = rows.withColumns({"start": start, "length": length})
    return rows.select(
        "doc_id",
        "piece",
        "start",
        "length",
        F.when(is_rest, F.col("bin")).otherwise(F.lit(bins) + F.col("added") + number).alias("sequence_id"),
        F.when(is_rest, F.col("offset")).otherwise(0).cast("long").alias("offset"),
        F.col("ids").substr((F.col("start") * width + 1).cast("int"), (F.col("length") * width).cast("int")).alias("ids"),
    )


DIGESTED = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids_crc32 long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist())
        crc = [crc_of(np.frombuffer(cell, "<u2" if len(cell) == 2 * n else "<u4")) for cell, n in cells]
        columns = [*batch.columns[:-1], pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "ids_crc32"])


def digested(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids, as little-endian 32-bit numbers, in place of the ids."""
    return pieces.mapInArrow(_digests, DIGESTED)
