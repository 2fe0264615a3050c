"""Document fingerprints: every shingle hash below a fixed fraction of the hash space.

A sketch keeps each distinct 5-word shingle hash below ``2**64 / SCALE``, whatever the text.  So
that something is left of short texts it also keeps the ``LEAST`` smallest hashes of any text;
those of a union are among those of its parts.  The sketch of a union is therefore exactly what
``merged`` makes of the sketches.  Two sketches compare up to where both know all hashes, so
texts of very unequal length give unbiased estimates of containment.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import NULL_ID, bounds_of, chunks, places, texts_of
from .shingles import shingle_sets

SCALE = 8
LEAST = 64
BELOW = np.uint64((1 << 64) // SCALE)


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """What is kept of ascending distinct hashes."""
    return hashes[: max(int(np.searchsorted(hashes, BELOW)), LEAST)]


def sketches(texts: list[str]) -> list[np.ndarray]:
    hashes, at = shingle_sets(pa.array(texts, pa.string()))
    return [sketch_of(hashes[low:high]) for low, high in zip(at[:-1], at[1:])]


def written(sketch: np.ndarray) -> str:
    """The sketch as text: its scale, and its hashes as little-endian numbers in base64."""
    return f"{SCALE}:" + base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    scale, _, body = text.partition(":")
    if int(scale) != SCALE:
        raise ValueError(f"a sketch of scale {scale}, not {SCALE}")
    return np.frombuffer(base64.b64decode(body), "<u8")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles taken together."""
    return sketch_of(np.union1d(a, b))


def reach(sketch: np.ndarray) -> np.uint64:
    """The greatest hash up to which the sketch lacks none of its text's."""
    if len(sketch) < LEAST:
        return np.uint64((1 << 64) - 1)  # all of a short text is kept
    return max(sketch[-1], BELOW - np.uint64(1))


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float | None]:
    """Estimates of the Jaccard similarity, and of the part of ``a``'s shingles that ``b`` holds.

    Texts without shingles are alike (1.0), and such a one is held by no other (0.0).  The second
    is None, for unknown, if ``a`` has shingles but none where both sketches know all.
    """
    most = min(reach(a), reach(b))
    x, y = (s[: np.searchsorted(s, most, "right")] for s in (a, b))
    if not len(a) and not len(b):
        return 1.0, 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    jaccard = both / (len(x) + len(y) - both)
    if not len(x):
        return jaccard, None if len(a) else 0.0
    return jaccard, both / len(x)


def edited(text: str, following: str) -> str:
    """The last quarter of a text (rounded down) replaced by as much of the next text's start."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, contained_in_edited double"
)


def _by_block(bounds: np.ndarray):
    """Give each row to its block, and a block's first rows to the block before as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy(False)
            block = np.searchsorted(bounds, place, "right") - 1
            heads = np.flatnonzero(bounds[block] == place)
            rows = np.concatenate([np.arange(len(place)), heads])
            blocks = np.concatenate([block, (block[heads] - 1) % len(bounds)]).astype(np.int32)
            border = np.arange(len(rows)) >= len(place)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks), pa.array(border), *taken.columns],
                ["block", "border", "place", "text"],
            )

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, in order of id; the row that ends a block is the next one's first."""
    held: list[tuple] = []
    for batch in chunks(batches, "text", 2 << 20):
        columns = [batch.column(k).to_pylist() for k in ("block", "border", "place")]
        rows = held + list(zip(*columns, texts_of(batch.column("text"))))
        own = sketches([r[3] for r in rows])
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        new = [edited(rows[i][3], rows[i + 1][3]) for i in pairs]
        out = []
        for i, text, sketch in zip(pairs, new, sketches(new)):
            near, inside = likeness(own[i], sketch)
            out.append(
                (
                    None if rows[i][2] == NULL_ID else rows[i][2],
                    len(rows[i][3]),
                    hashlib.sha256(text.encode()).hexdigest(),
                    written(own[i]),
                    written(sketch),
                    near,
                    likeness(own[i], own[i + 1])[0],
                    inside,
                )
            )
        held = rows[-1:]
        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 3]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A fingerprint of every text and of its edited text, and how near they are.

    Rows are taken in ascending id (null first, rows of one id by text); behind the last comes
    the first, so a single row follows itself.  Null text counts as empty.  The rows are cut
    into blocks at quantiles of the id, and each block also gets the first row of the next.
    """
    spark = docs.sparkSession
    rows = places(docs, id_col, text_col)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = bounds_of(rows, 4 * width)
    if not len(bounds):
        return spark.createDataFrame([], RESULT)
    blocks = rows.mapInArrow(_by_block(bounds), "block int, border boolean, place long, text string")
    ordered = blocks.repartition(width, "block").sortWithinPartitions("block", "border", "place", "text")
    return ordered.mapInArrow(_compare, RESULT)
