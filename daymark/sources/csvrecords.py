"""CSV whose quoted fields hold line breaks, read by as many tasks as its size asks for.

A line of such a file starts either a record or within quotes, and what it does to that one bit
can be told from the line alone, under both assumptions.  So each byte range of a file, read by
its own task, sums up to a function of one bit; a scan over the ranges of each file says how each
starts.  A second reading cuts the lines into records.  The few records that cross ranges are put
together from their pieces.

Quoting: a quote at the start of a field opens it; two quotes in it are one, and any other closes
it.  What follows a closing quote runs to the next comma.  A quote elsewhere is a letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialised

QUOTED = r'"(?:[^"]|"")*"(?:[^",][^,]*)?'
FIELD = rf'(?:{QUOTED}|(?:[^",][^,]*)?)'
# Lines that end outside quotes, begun outside and within.
CLOSED = (
    rf"\A{FIELD}(?:,{FIELD})*\z",
    rf'\A(?:[^"]|"")*"(?:[^",][^,]*)?(?:,{FIELD})*\z',
)

# Whole records, the end of one begun in an earlier range, the start of one, and the mark of a
# range whose start is not known.
WHOLE, HEAD, TAIL, UNKNOWN = range(4)

# Ranges with a long, a long and a bit each: some 30 MB when sent to every executor.
MOST_SENT = 1_000_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line with the byte range that holds it; only line feeds end lines."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


def _ends(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line ends within quotes, if begun outside and if begun within."""
    outside, within = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    at = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(False))
    if len(at):
        some = lines.take(pa.array(at))
        for ends, closed in zip((outside, within), CLOSED):
            ends[at] = ~pc.match_substring_regex(some, closed).to_numpy(False)
    return outside, within


def _states(begun: bool, outside: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Whether each of the lines in a row ends within quotes, the first being begun as said."""
    flips = np.cumsum(outside & ~within)
    fixed = np.maximum.accumulate(np.where(outside == within, np.arange(len(outside)), -1))
    since = np.where(fixed >= 0, flips - flips[fixed], flips)
    return np.where(fixed >= 0, outside[fixed], begun) ^ (since & 1).astype(bool)


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The rows of each range in a batch; a range's lines come in order, in one task."""
    if not batch.num_rows:
        return
    file, start = (batch.column(k).to_numpy(False) for k in ("file", "start"))
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    edges = [0, *cuts.tolist(), len(file)]
    for low, high in zip(edges, edges[1:]):
        yield (int(file[low]), int(start[low])), batch.slice(low, high - low)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: how it ends under both assumptions, and whether lines break a record then."""
    key, ends, broken = None, [False, True], [False, True]

    def row() -> pa.RecordBatch:
        values = dict(zip(("file", "start"), key), outside=ends[0], within=ends[1], broken=broken[0])
        return pa.RecordBatch.from_pylist([values])

    for batch in batches:
        for now, rows in _ranges(batch):
            if now != key:
                if key is not None:
                    yield row()
                key, ends, broken = now, [False, True], [False, True]
            functions = _ends(rows.column("line"))
            for k in (0, 1):
                states = _states(ends[k], *functions)
                ends[k], broken[k] = bool(states[-1]), broken[k] or bool(states.any())
    if key is not None:
        yield row()


def _starts(summed: DataFrame) -> DataFrame:
    """``file, start, inside``: whether each range starts within quotes.

    A range that ends alike under both assumptions forgets its start; since the last of these,
    those that end otherwise than they start are counted.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    flip = F.col("outside") & ~F.col("within")
    counted = summed.withColumn("flips", F.sum(flip.cast("long")).over(upto))
    fixed = F.when(F.col("outside") == F.col("within"), F.col("outside").cast("long") - F.col("flips"))
    counted = counted.withColumn("fixed", fixed)
    base = F.coalesce(F.last("fixed", True).over(before), F.lit(0))
    last = F.coalesce(F.last("flips").over(before), F.lit(0))
    return counted.select("file", "start", (F.pmod(base + last, F.lit(2)) == 1).alias("inside"))


CUT = "file long, start long, kind int, header boolean, record binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each range, the first of each file marked as its header."""
    key, held, begun_here, inside, first = None, [], True, False, False
    names = [c.split()[0] for c in CUT.split(", ")]

    def made(kind: int, records: pa.Array, header: bool = False) -> pa.RecordBatch:
        """A batch of one kind; the first record is the header if said so."""
        size = len(records)
        marks = np.zeros(size, bool)
        marks[:1] = header
        columns = [np.full(size, key[0]), np.full(size, key[1]), np.full(size, kind, np.int32), marks]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), records], names)

    def one(kind: int, header: bool) -> pa.RecordBatch:
        return made(kind, pa.array([b"\n".join(held)], pa.binary()), header)

    for batch in batches:
        for now, rows in _ranges(batch):
            if now != key:
                if held:
                    yield one(TAIL if begun_here else HEAD, first)
                key, held = now, []
                start = rows.column("inside")[0].as_py()
                inside, begun_here, first = bool(start), not start, now[1] == 0
                if start is None:
                    yield made(UNKNOWN, pa.array([b""], pa.binary()))
            lines = rows.column("line")
            if first and not held and lines[0].as_py().startswith(b"\xef\xbb\xbf"):
                lines = pa.array([lines[0].as_py()[3:], *lines[1:].to_pylist()], pa.binary())
            after = _states(inside, *_ends(lines))
            before = np.concatenate([[inside], after[:-1]])
            single = ~before & ~after
            if first:  # up to the header, line by line
                single[:] = False
            elif single.all():
                yield made(WHOLE, lines)
                continue
            for at in np.flatnonzero(~single).tolist():
                if not held and not before[at]:
                    begun_here = True
                held.append(lines[at].as_py())
                if not after[at]:
                    blank = held == [b""] or held == [b"\r"]
                    yield one(WHOLE if begun_here else HEAD, first and not blank)
                    held, first = [], first and blank
            inside = bool(after[-1])
            if single.any():
                yield made(WHOLE, lines.filter(pa.array(single)))
    if held:
        yield one(TAIL if begun_here else HEAD, first)


def _with_starts(lines: DataFrame, starts: DataFrame, sent: bool) -> DataFrame:
    """Each line with its range's start, lines of a range in order and in one task."""
    if sent:
        return lines.join(F.broadcast(starts), ["file", "start"], "left")
    numbered = lines.withColumn("number", F.monotonically_increasing_id())
    joined = numbered.join(starts, ["file", "start"], "left")
    return joined.repartition("file", "start").sortWithinPartitions("file", "start", "number").drop("number")


def broken_records(
    spark: SparkSession, path: str, most_sent: int = MOST_SENT, tries: int = 4
) -> DataFrame | None:
    """The records under ``path`` without headers and blank lines, one string column ``record``.

    None if no field holds a line break: then each line is a record.  The records are written to
    the shared scratch folder once.  Should the ranges have changed between the two readings, as
    Spark cuts files by the cores at hand, both are done again.
    """
    lines = _lines(spark, path)
    if lines.where(F.col("line").contains(F.lit(b'"'))).isEmpty():
        return None
    for _ in range(tries):
        kinds = "file long, start long, outside boolean, within boolean, broken boolean"
        summed = materialised(lines.mapInArrow(_sum_up, kinds), "csv-ranges")
        starts = materialised(_starts(summed), "csv-starts")
        ranges = starts.count()
        if starts.select("file", "start").distinct().count() < ranges:
            raise ValueError(f"two files under {path!r} have one hash: rename one of them")
        if starts.where("inside").isEmpty() and summed.where("broken").isEmpty():
            return None
        cut = _with_starts(lines, starts, ranges <= most_sent).mapInArrow(_cut, CUT)
        cut = materialised(cut, "csv-records")
        if cut.where(F.col("kind") == UNKNOWN).isEmpty():
            break
    else:
        raise RuntimeError(f"the byte ranges of {path!r} changed {tries} times between two readings")
    text = F.col("record").cast("string")
    whole = cut.where((F.col("kind") == WHOLE) & ~F.col("header")).select(text.alias("record"))
    order = Window.partitionBy("file").orderBy("start", "kind")
    pieces = cut.where(F.col("kind").isin(HEAD, TAIL))
    pieces = pieces.withColumn("nth", F.sum((F.col("kind") == TAIL).cast("long")).over(order))
    ordered = F.array_sort(F.collect_list(F.struct("start", "kind", text.alias("record"))))
    joined = pieces.groupBy("file", "nth").agg(
        F.concat_ws("\n", F.transform(ordered, lambda piece: piece["record"])).alias("record"),
        F.max("header").alias("header"),
    )
    records = whole.unionAll(joined.where(~F.col("header")).select("record"))
    bare = F.expr(r"CASE WHEN endswith(record, '\r') THEN left(record, length(record) - 1) ELSE record END")
    return records.select(bare.alias("record")).where("record <> ''")
