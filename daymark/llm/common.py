"""Helpers the text operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20  # of text worked on at once in a task
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.sparkContext.master.startswith("local"):
        # So that workers of a local session find this package; a cluster gets it by --py-files.
        spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_rest(column: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of an id, as text, leaves that remainder; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == rest


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES):
    """Slices of the batches, of about ``limit`` bytes of text each; one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        done = 0
        while done < len(lengths):
            size = np.cumsum(lengths[done : done + 50_000])
            take = max(1, int(np.searchsorted(size, limit, "right")))
            yield batch.slice(done, take)
            done += take


_caches: list[tuple[str, dict]] = []


def worker_cache(name: str = "") -> dict:
    """What a Python worker keeps from one task to the next, until ``fresh_start``."""
    _caches.append((name, {}))
    return _caches[-1][1]


def fresh_start(*keep: str) -> None:
    """Drop what the operators that ran in this worker before have kept, but for the caches named.

    A worker lives on from stage to stage; without this it would hold the tokenizers, word
    lists and tables of all operators of a pipeline at once.
    """
    held = [c for name, c in _caches if c and name not in keep]
    for cache in held:
        cache.clear()
    if held:
        gc.collect()
    give_back()


def give_back() -> None:
    """Return freed memory to the system; glibc and Arrow keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Job = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(job: Job, *keep: str) -> Job:
    """The job of a task, begun without what other operators kept in its worker; freed memory goes back at its end.

    Caches are named as a job travels by value, and a worker's own caches are meant.
    """

    @functools.wraps(job)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_start(*keep)
        yield from job(batches)
        give_back()

    return run


def texts_of(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def split_points(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of many slices, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


NULL_ID = -(1 << 63)


def places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``place, text``: the id, with the least number there is for null, and the text."""
    return docs.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).alias("place"), F.col(text_col).alias("text"))


def bounds_of(rows: DataFrame, blocks: int) -> np.ndarray:
    """The least ``place`` of each of about so many blocks of like size, ascending; empty for no rows."""
    steps = [i / blocks for i in range(1, blocks)] or [0.0]
    cuts = rows.agg(F.min("place"), F.percentile_approx("place", steps, max(10_000, 10 * blocks))).first()
    return np.unique(np.array([] if cuts[0] is None else [cuts[0], *cuts[1]], np.int64))


def first_texts(texts: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` distinct texts with their rows' other columns, the first by a hash.

    Only hashes are shuffled to find the last of them, so no other text is moved.
    """
    keyed = texts.withColumn("order", F.xxhash64("text"))
    last = keyed.select("order").distinct().orderBy("order").limit(sample).agg(F.max("order")).first()[0]
    return keyed.filter(F.col("order") <= F.lit(last)).dropDuplicates(["order"])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, use: Column, sample: int) -> DataFrame:
    """``text, label`` of labelled documents for whose id ``use`` holds.

    Of each class come at most ``sample``, the first by a hash of the id: a bound by which the
    ids may be broadcast, so that no text is shuffled.
    """
    marks = labels.filter(use).select(F.col("doc_id").alias("marked"), F.col(label).alias("label"))
    parts = [
        marks.filter(F.col("label") == k).orderBy(F.xxhash64("marked"), "marked").limit(sample) for k in (0, 1)
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    # Other columns of the documents may have any names.
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("marked")).select("text", "label")
