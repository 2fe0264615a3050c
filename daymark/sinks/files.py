"""File exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hashable, quoted
from ..sources.files import CSV_OPTIONS
from .tables import clustered

ROW_GROUP_BYTES = 128 * 1024 * 1024


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Snappy Parquet with 128 MB row groups."""
    (
        df.write.mode(mode)
        .option("compression", "snappy")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header in every part file."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def export(df: DataFrame, path: str, file_type: str) -> None:
    """Parquet for ``parquet``, CSV for ``csv``."""
    writers = {"parquet": write_parquet, "csv": write_csv}
    if file_type not in writers:
        raise ValueError(f"file type {file_type!r} is none of {sorted(writers)}")
    writers[file_type](df, path)


def write_entity_csv(df: DataFrame, root: str, entity: str) -> str:
    """One CSV folder per entity, ``{root}/{entity}``."""
    path = f"{root}/{entity}"
    write_csv(df, path)
    return path


def write_by_owner(
    df: DataFrame, path: str, owner: str, load_stamp: str, rows_per_file: int = 5_000_000
) -> str:
    """A folder per owner under a stamped load folder, ``{path}/load={stamp}/{owner}=…``.

    A small owner ends up in one file; a large one is spread over tasks by AQE and
    cut into files of at most ``rows_per_file`` rows.  One folder per owner only
    suits owners in the thousands: beyond that use ``write_owner_ranges``.
    """
    target = f"{path}/load={load_stamp}"
    (
        clustered(df, [owner])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "snappy")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .partitionBy(owner)
        .parquet(target)
    )
    return target


INDEX = "_owners"


def write_owner_ranges(
    df: DataFrame, path: str, owner: str, load_stamp: str, bytes_per_file: int = ROW_GROUP_BYTES
) -> str:
    """Rows in order of owner under ``{path}/load={stamp}``, for any number of owners.

    Files hold ranges of owners, of about equal size; an owner with more rows than a file takes
    is cut by a hash of its rows.  An index beside them, ``_owners``, has the first and last owner
    of each file, so ``read_owners`` opens only files that may hold the ones asked for.  The
    number of files follows from Spark's estimate of the frame's size.
    """
    target = f"{path}/load={load_stamp}"
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # An estimate without statistics is all but endless: then as wide as shuffles are.
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = min(max(-(-size // bytes_per_file), 1), 1_000_000) if size < 1 << 60 else width
    spread = F.xxhash64(*[F.col(quoted(f.name)) for f in df.schema if hashable(f.dataType)])
    key = F.col(quoted(owner))
    ordered = df.repartitionByRange(files, key, spread).sortWithinPartitions(key)
    write_parquet(ordered, target)
    held = df.sparkSession.read.schema(df.schema).parquet(target)
    index = held.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(key).alias("low"),
        F.max(key).alias("high"),
        F.count_if(key.isNull()).alias("without"),
        F.count(F.lit(1)).alias("rows"),
    )
    write_parquet(index.coalesce(1), f"{target}/{INDEX}")
    return target


def read_owners(spark: SparkSession, target: str, owner: str, owners: Sequence[object]) -> DataFrame:
    """The rows of some owners, None among them or not, out of ``write_owner_ranges``.

    The driver gets the names of the files that may hold them.
    """
    index = spark.read.parquet(f"{target}/{INDEX}")
    known = [value for value in owners if value is not None]
    wanted = F.lit(False)
    files = F.lit(False)
    if None in owners:
        wanted, files = F.col(quoted(owner)).isNull(), F.col("without") > 0
    for value in known:
        files = files | F.lit(value).between(F.col("low"), F.col("high"))
    if known:
        wanted = wanted | F.col(quoted(owner)).isin(known)
    found = [f"{target}/{r['file']}" for r in index.where(files).select("file").collect()]
    rows = spark.read.parquet(*found) if found else spark.read.parquet(target).limit(0)
    return rows.where(wanted)


def publish_dir(df: DataFrame, path: str, delete_existing: bool = False) -> None:
    """Publish to a folder: replace what is there, or add to it."""
    write_parquet(df, path, "overwrite" if delete_existing else "append")
