"""WARC archives of pages, and reading them back by boundary-chain verification.

Reading takes the archives in byte ranges, one task each.  A task reports every place in its
range that looks like a record's first line and the offset at which the next record would have
to start.  A page may hold such lines itself, so a candidate counts only if the chain from the
start of the file reaches it:

1. within a range, each candidate's successors are followed to the first one outside it;
2. over the ranges of a file, pointer jumping from offset 0 doubles the reach in each round;
3. within each range, the chain from the offset at which it was entered gives its records.

A chain that does not end exactly at the end of its file is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .common import chunks
from .stored import opened, put, shared_dir

MAGIC = b"WARC/1.1\r\n"
RANGE = 4 << 20  # bytes of an archive that one task searches
ARCHIVE = 32 << 20  # bytes after which an archive ends
AHEAD = 1 << 16  # bytes that a task reads behind its range, and again as long as a header goes on
DATE = "1970-01-01T00:00:00Z"  # the pages table has no fetch time


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes | None, digest: str, size: int, first: int | None) -> bytes:
    """A response, or without payload a revisit of the page ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or "about:blank"),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        lines[4:4] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{first}>",
        ]
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _written(folder: str, archive: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Named after the attempt: a second one may get its rows in another order.
        task, part, held = TaskContext.get().taskAttemptId(), 0, bytearray()

        def closed():
            name = f"{task:08d}-{part:06d}.warc"
            put(folder, name, bytes(held))
            return pa.RecordBatch.from_pylist([{"name": name, "bytes": len(held)}])

        for batch in chunks(batches, "payload"):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held += record(*row)
                if len(held) >= archive:
                    yield closed()
                    part, held = part + 1, bytearray()
        if held:
            yield closed()

    return run


def write_archives(
    pages: DataFrame, least: int = 0, archive: int = ARCHIVE, digest: Callable[[Column], Column] = F.sha1
) -> tuple[str, DataFrame]:
    """The folder of the archives, and ``name, bytes`` of each.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest id (null
    first) is written as a response; the others are revisits of it, without payload.  Null html
    counts as empty.  Rows that repeat the first one's id are all responses.

    Payloads are equal if their SHA-256, digest and size are: files that share a SHA-1 are
    public, and a page must not be lost behind a revisit of another.  What counts as an archive
    are the names returned; what a failed task left in the folder is never read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(digest(F.col("payload")))).withColumn("size", F.octet_length("payload"))
    rows = rows.withColumn("content", F.unhex(F.sha2("payload", 256)))
    same = ["content", "digest", "size"]
    first = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("pages"), F.min(F.struct("page_id")).alias("first"))
    # Only payloads that come more than once; where those are few, Spark need not move the others.
    first = materialised(first.filter("pages > 1").drop("pages"), "warc-copies")
    known = F.col("first").isNotNull()
    revisit = known & ~F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("size") >= least)
    made = rows.join(first, same, "left").select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.col("first.page_id").alias("first")
    )
    folder = shared_dir(pages.sparkSession, "warc")
    base32 = made.mapInArrow(_in_base32, "page_id long, url string, payload binary, digest string, size long, first long")
    return folder, materialised(base32.mapInArrow(_written(folder, archive), "name string, bytes long"), "warc-made")


def _in_base32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest = pa.array([base64.b32encode(x).decode() for x in batch.column("digest").to_pylist()], pa.string())
        columns = [*batch.columns[:3], digest, batch.column("size").cast(pa.int64()), batch.columns[5]]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "payload", "digest", "size", "first"])


# ---- reading

_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,15})\r\n")


class Headers:
    """Where records start, ``text`` being what ``file`` holds from ``begin`` on.

    A header ends at the first empty line, however far that is, and more is read until it is
    found; a record has one, so no more than the rest of a record is.  Places are asked for in
    ascending order, and what was searched for one is not searched again for the next.
    """

    def __init__(self, file, begin: int, size: int):
        self.file, self.begin = file, begin
        file.seek(begin)
        self.text = bytearray(file.read(size + AHEAD))
        self.end = self.length = -1  # the last empty line found, and the last length with what it says
        self.says = 0

    def _empty_line(self, at: int) -> int:
        end = self.text.find(b"\r\n\r\n", at)
        more = AHEAD
        while end < 0 and (read := self.file.read(more)):
            done = max(at, len(self.text) - 3)
            self.text += read
            end, more = self.text.find(b"\r\n\r\n", done), 2 * more
        return len(self.text) if end < 0 else end

    def successor(self, at: int) -> int:
        """Where the record behind the one at ``text[at:]`` starts; -1 if that is no record."""
        if self.end < at:
            self.end = self._empty_line(at)
        if self.end == len(self.text):
            return -1
        if self.length < at:
            found = _LENGTH.search(self.text, at, self.end + 2)
            self.length, self.says = (found.start(), int(found[1])) if found else (self.end, 0)
        return -1 if self.length >= self.end else self.begin + self.end + 4 + self.says + 4


def _candidates(folder: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, begin in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(folder, name) as file:
                    headers = Headers(file, begin, size)
                    at, found = headers.text.find(MAGIC), []
                    while 0 <= at < size:
                        found.append((begin + at, headers.successor(at)))
                        at = headers.text.find(MAGIC, at + 1, size + len(MAGIC))
                offset, after = np.array(found, np.int64).reshape(-1, 2).T
                leave = after.copy()  # backwards, so that each successor's way out is known
                index = {int(x): i for i, x in enumerate(offset)}
                for i in range(len(offset) - 1, -1, -1):
                    # A place within the range that is no candidate is where its chain breaks.
                    leave[i] = leave[index[int(after[i])]] if int(after[i]) in index else after[i]
                columns = [pa.array([name] * len(offset), pa.string()), pa.array([begin // size] * len(offset), pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(offset), pa.array(after), pa.array(leave)],
                    ["name", "piece", "offset", "after", "leave"],
                )

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, ascending: keep those that the chain from its entry reaches."""
    here, awaited = None, -1
    for batch in batches:
        keep = []
        for name, piece, offset, after, entry in zip(*(c.to_pylist() for c in batch.columns)):
            if (name, piece) != here:
                here, awaited = (name, piece), entry
            keep.append(offset == awaited)
            if offset == awaited:
                awaited = after
        yield batch.filter(pa.array(keep, pa.bool_())).select(["name", "offset", "after"])


def _parsed(folder: str):
    def field(header: bytes, name: bytes) -> str | None:
        found = re.search(rb"\r\n" + name + rb": ([^\r]*)\r\n", header)
        return found[1].decode() if found else None

    def page(urn: str | None) -> int | None:
        number = urn[len("<urn:page:") : -1] if urn else "None"
        return None if number == "None" else int(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, now, file = [], None, None
            for name, offset, after in zip(*(c.to_pylist() for c in batch.columns)):
                if name != now:
                    now, file = name, opened(folder, name)
                file.seek(offset)
                text = file.read(after - offset)
                cut = text.index(b"\r\n\r\n") + 4
                header, block = text[:cut], text[cut:-4]
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = field(header, b"WARC-Type"), field(header, b"WARC-Payload-Digest")
                size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                digest = digest.removeprefix("sha1:")
                if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                    raise ValueError(f"{name}, offset {offset}: the payload is not what its record says")
                first = page(field(header, b"WARC-Refers-To")) if kind == "revisit" else None
                out.append((page(field(header, b"WARC-Record-ID")), size, digest, kind, first))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    return run


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_offsets(folder: str, files: DataFrame, size: int = RANGE) -> DataFrame:
    """``name, offset, after`` of the records, each proven by the chain from its file's start."""
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = files.select("name", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(size))).alias("begin"))
    found = pieces.repartition(width, "name", "begin").mapInArrow(
        _candidates(folder, size), "name string, piece long, offset long, after long, leave long"
    )
    found = materialised(found, "warc-candidates")
    jumps = found.select("name", "offset", "leave")
    reached = files.select("name", F.lit(0).cast("long").alias("offset"))
    known = -1
    while True:
        ahead = reached.join(jumps, ["name", "offset"]).select("name", F.col("leave").alias("offset"))
        reached = materialised(reached.union(ahead).distinct(), "warc-reached")
        count = reached.count()
        if count == known:
            break
        known = count
        twice = jumps.select("name", F.col("offset").alias("leave"), F.col("leave").alias("further"))
        # A jump that leads to no candidate stays as it is: the file's end, or a broken chain.
        jumps = jumps.join(twice, ["name", "leave"], "left").select(
            "name", "offset", F.coalesce("further", "leave").alias("leave")
        )
        jumps = materialised(jumps, "warc-jumps")
    ends = reached.join(found.select("name", "offset"), ["name", "offset"], "left_anti")
    broken = files.join(ends, (files["name"] == ends["name"]) & (files["bytes"] == ends["offset"]), "left_anti")
    if not broken.isEmpty():
        raise ValueError(f"no chain of records through archive {broken.first()['name']}")
    entries = reached.groupBy("name", F.floor(F.col("offset") / size).alias("piece")).agg(F.min("offset").alias("entry"))
    rows = found.join(entries, ["name", "piece"]).select("name", "piece", "offset", "after", "entry")
    rows = rows.repartition(width, "name", "piece").sortWithinPartitions("name", "piece", "offset")
    return rows.mapInArrow(_chain, "name string, offset long, after long")


def read_archives(folder: str, files: DataFrame, size: int = RANGE) -> DataFrame:
    return record_offsets(folder, files, size).mapInArrow(_parsed(folder), RESULT)


def archived(pages: DataFrame, least: int = 0, archive: int = ARCHIVE, size: int = RANGE) -> DataFrame:
    """Write the pages as WARC archives, read those back, and tell what each record holds."""
    return read_archives(*write_archives(pages, least, archive), size)
