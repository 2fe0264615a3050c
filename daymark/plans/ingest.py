"""Load files into tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.columns import DAY, with_day
from ..sinks.tables import append, append_by_day, create_like, replace
from ..sources.files import base_name, read_any, read_csv, suffix_of, table_name
from ..sources.tables import Lake, Table
from .sync import SyncReport, sync_days
from .threads import each


def stage(lake: Lake, source: str, layer: str = "bronze") -> DataFrame:
    """Load a file and keep it as a table named after it, parsed once.

    A source without a known suffix is a table already and is returned as it is.
    """
    df = read_any(lake.spark, source)
    if suffix_of(source) is None:
        return df
    return replace(lake.table(layer, table_name(source)), df).read()


def bootstrap(
    spark: SparkSession,
    source: str,
    target: Table,
    partition_by: Sequence[str] = (),
    mode: str = "append",
    schema: T.StructType | None = None,
    cluster: bool = True,
) -> Table:
    """Load a whole file or table into ``target``.

    ``append`` adds the rows again on every run; ``overwrite`` replaces them.  A table that
    exists keeps its layout: asking for another one with ``append`` is an error.
    ``cluster`` is as for ``append`` of ``sinks.tables``.
    """
    df = read_any(spark, source, schema)
    if mode == "overwrite":
        return replace(target, df, partition_by, cluster)
    if mode != "append":
        raise ValueError(f"mode {mode!r} is neither append nor overwrite")
    if partition_by and target.exists():
        held = target.partition_columns()
        if [c.lower() for c in held] != [c.lower() for c in partition_by]:
            raise ValueError(f"{target.identifier} is partitioned by {held}, not {list(partition_by)}")
    append(create_like(target, df, partition_by), df, cluster)
    return target


def ingest_new_days(spark: SparkSession, path: str, target: Table, day: str = DAY) -> SyncReport:
    """Load a CSV file's days that the target lacks.

    The day column may be spelled in any case; text that is no date counts as a
    missing day and is reported, not loaded.
    """
    return sync_days(read_csv(spark, path, line_breaks=True), target, day=day)


def ingest_all(spark: SparkSession, path: str, target: Table, day: str = DAY) -> None:
    """Load all of a CSV file, whatever the target holds.  Loading twice doubles."""
    append_by_day(target, with_day(read_csv(spark, path, line_breaks=True), day), day)


def ingest_folder(
    lake: Lake,
    folder: str,
    names: Sequence[str],
    layer: str = "bronze",
    day: str = DAY,
    at_once: int = 4,
) -> dict[str, SyncReport]:
    """Load the new days of ``{folder}/{name}.csv`` into the table of that name, for each
    name; a known file suffix in a name is ignored."""

    def load(name: str) -> SyncReport:
        target = lake.table(layer, table_name(name))
        return ingest_new_days(lake.spark, f"{folder}/{base_name(name)}.csv", target, day)

    return dict(zip(map(table_name, names), each(lake.spark, load, names, at_once)))
