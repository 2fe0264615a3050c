"""Table writes.  All match columns by name."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import DAY, hashable, quoted, with_day
from ..operators.days import on_day
from ..sources import daylog
from ..sources.tables import COMMIT_IN_TASKS, TABLE_OPTIONS, CatalogTable, Table, register


DAYS_PER_TASK = 50
ROWS_PER_TASK = 1_000_000
SMALL = 1 << 30  # bytes of a frame that is dealt by day alone: no day can be too much for a task


def clustered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bring rows of one partition value together before a partitioned write.

    Without it every task opens a file for every value it meets.  REBALANCE, not
    ``repartition``: AQE cuts a value that holds a third of all rows into several
    tasks and joins small ones, by measured bytes.
    """
    return df.hint("rebalance", *map(quoted, columns)) if columns else df


def dealt(df: DataFrame, day: str, rows: Mapping[dt.date, int]) -> DataFrame:
    """The same where the rows of each day are known: few days and few rows a task.

    REBALANCE folds partitions by bytes, but each small day costs a file.  So the number of
    tasks is explicit.  A day of more than ``ROWS_PER_TASK`` rows is spread by a hash of its
    rows, which a task that runs again computes alike.
    """
    tasks = max(-(-len(rows) // DAYS_PER_TASK), -(-sum(rows.values()) // ROWS_PER_TASK), 1)
    hot = defaultdict(list)  # days by parts; these are powers of two, so the classes are few
    for value, count in rows.items():
        if count > ROWS_PER_TASK:
            hot[1 << (-(-count // ROWS_PER_TASK) - 1).bit_length()].append(value)
    hashed = [F.col(quoted(f.name)) for f in df.schema if hashable(f.dataType)]
    parts = F.lit(1)
    for number, days in sorted(hot.items()):
        parts = F.when(F.col(quoted(day)).isin(days), number).otherwise(parts)
    part = F.pmod(F.xxhash64(*hashed), parts) if hot else F.lit(0)
    return df.repartition(tasks, F.col(quoted(day)), part)


def dealt_unseen(df: DataFrame, day: str) -> DataFrame:
    """The same where nothing is known of the days but the size of the frame.

    A small frame may have very many small days, each of which costs a file; REBALANCE would fold
    them into one task by their bytes.  So they are spread over all cores.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL:
        return clustered(df, [day])
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, F.col(quoted(day)))


def create_like(table: Table, df: DataFrame, partition_by: Sequence[str] = ()) -> Table:
    """Create the table with the frame's columns if it is absent."""
    if isinstance(table, CatalogTable):
        return table.create(df.schema, partition_by)
    return register(table, df.schema, partition_by)


def append(table: Table, df: DataFrame, cluster: bool = True) -> None:
    """Append to an existing table.

    ``cluster=False`` spares the shuffle where ``df`` comes out of files laid out by the
    same partition columns, or where these have so few values that a task may well
    write a file for each.
    """
    rows = clustered(df, table.partition_columns()) if cluster else df
    table.spark.sql(f"INSERT INTO {table.identifier} BY NAME SELECT * FROM {{rows}}", rows=rows)


def append_by_day(table: Table, df: DataFrame, day: str = DAY) -> None:
    """Append to a table partitioned by day, creating it on first use."""
    append(create_like(table, df, [day]), df)


@dataclass(frozen=True)
class Written:
    """What a write of whole days put there, and the rows without a day that it left out."""

    days: tuple[str, ...]
    rows: int
    null_day_rows: int


def like(table: Table, df: DataFrame) -> DataFrame:
    """The frame's columns as the table has them, matched by name; all must be there."""
    wanted = table.read().schema
    have = {c.lower(): c for c in df.columns}
    if len(have) != len(df.columns) or set(have) != {f.name.lower() for f in wanted}:
        raise ValueError(f"{table.identifier} has columns {wanted.names}, not {df.columns}")
    return df.select(*[F.col(quoted(have[f.name.lower()])).cast(f.dataType).alias(f.name) for f in wanted])


def put_days(
    table: Table,
    df: DataFrame,
    day: str = DAY,
    cluster: bool = True,
    counts: Mapping[dt.date, int] | None = None,
) -> Written:
    """Write whole days: each day in ``df`` replaces that day's partition.

    ``counts``: the rows of each day, where they are known.  Rows without a day are counted and
    left out; they take part in the shuffle as rows of NULL, so that the count is that of
    finished tasks alone, whatever was run twice.

    The files go to a folder of this run's own, and an entry in the table's log makes the days
    visible once all are there: the driver moves no file, and a job that is run again after a
    failure neither doubles a day nor leaves half of one.

    A table of a named catalog takes the days in one overwrite of the partitions written, which
    the catalog commits.
    """
    if not table.is_by_day(day):
        raise ValueError(f"{table.identifier} is not partitioned by {day} alone")
    if table.overwrite_mode() not in (None, "dynamic"):
        raise ValueError(f"{table.identifier} overwrites in static mode: any overwrite would remove its other days")
    rows = like(table, df)
    name = next(c for c in rows.columns if c.lower() == day.lower())
    dated = F.col(quoted(name)).isNotNull()
    if cluster:
        rows = rows.select(*[F.when(dated, F.col(quoted(c))).alias(c) for c in rows.columns])
        rows = dealt(rows, name, counts) if counts else dealt_unseen(rows, name)
    seen = Observation()
    if isinstance(table, CatalogTable):
        days = F.collect_set(F.col(quoted(name)).cast("string"))  # a string a calendar day
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(quoted(name)).alias("dated"), days.alias("days"))
        _overwrite_partitions(table, rows.where(dated))
        counted = seen.get
        return Written(tuple(sorted(counted["days"])), counted["dated"], counted["rows"] - counted["dated"])
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(quoted(name)).alias("dated"))
    folder = daylog.run_folder(table.location)
    options = {k: v for k, v in TABLE_OPTIONS.items() if k != "partitionOverwriteMode"}
    try:
        rows.where(dated).write.options(**options, **COMMIT_IN_TASKS).partitionBy(name).parquet(folder)
        found = daylog.written(table.spark, folder)
    except Exception:
        daylog.remove(table.spark, folder)
        raise
    if found:
        daylog.enter(table.spark, table.location, folder, found)
        places = ((f.split("=", 1)[1], f"{folder}/{f}") for f in found)
        daylog.name_days(table.spark, table.identifier, name, places)
    else:
        daylog.remove(table.spark, folder)
    counted = seen.get
    return Written(tuple(f.split("=", 1)[1] for f in found), counted["dated"], counted["rows"] - counted["dated"])


def _overwrite_partitions(table: CatalogTable, rows: DataFrame) -> None:
    if table.in_session_catalog():  # dynamic, as stored with the table
        table.spark.sql(f"INSERT OVERWRITE {table.identifier} BY NAME SELECT * FROM {{rows}}", rows=rows)
    else:
        rows.writeTo(table.identifier).overwritePartitions()


def add_days(
    table: Table,
    df: DataFrame,
    day: str = DAY,
    cluster: bool = True,
    counts: Mapping[dt.date, int] | None = None,
) -> Written:
    """Write days the table does not hold yet.

    A table laid out by day takes them as whole partitions.  Any other is appended
    to, which a second try after a failed commit may double.
    """
    if table.is_by_day(day):
        return put_days(table, df, day, cluster, counts)
    rows, seen = with_day(df, day), Observation()
    kept = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(day).alias("dated"), F.collect_set(day).alias("days"))
    append(table, kept.where(F.col(day).isNotNull()))
    counted = seen.get
    return Written(tuple(sorted(map(str, counted["days"]))), counted["dated"], counted["rows"] - counted["dated"])


def replace(
    table: Table, df: DataFrame, partition_by: Sequence[str] = (), cluster: bool = True
) -> Table:
    """Overwrite the table, schema included.

    The files are replaced first and the table is named anew over them, so that what is
    stored with it is the dynamic overwrite mode, not the static one of this write.
    """
    rows = clustered(df, partition_by) if cluster else df
    if isinstance(table, CatalogTable):
        _replace_in_catalog(table, rows, partition_by)
        return table
    writer = rows.write.mode("overwrite").options(**TABLE_OPTIONS)
    if partition_by:
        # The whole table goes, not just the partitions written now.
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "static")
    writer.parquet(table.location)
    table.spark.sql(f"DROP TABLE IF EXISTS {table.identifier}")
    register(table, df.schema, partition_by)
    table.spark.catalog.refreshTable(table.identifier)
    return table


def _replace_in_catalog(table: CatalogTable, rows: DataFrame, partition_by: Sequence[str]) -> None:
    if table.in_session_catalog():
        writer = rows.write.mode("overwrite").format(table.provider or "parquet").options(**TABLE_OPTIONS)
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table.identifier)
        return
    writer = rows.writeTo(table.identifier)
    if table.provider:
        writer = writer.using(table.provider)
    if partition_by:
        writer = writer.partitionedBy(*[F.col(quoted(c)) for c in partition_by])
    writer.createOrReplace()


def create_as(
    table: Table, df: DataFrame, partition_by: Sequence[str] = (), cluster: bool = True
) -> Table:
    """CREATE TABLE AS SELECT, at the table's path; fails if the table exists."""
    if table.exists():
        raise ValueError(f"{table.identifier} exists")
    create_like(table, df, partition_by)
    try:
        append(table, df, cluster)
    except Exception:
        table.spark.sql(f"DROP TABLE {table.identifier}")
        raise
    return table


def create_as_day(table: Table, source: DataFrame, day: dt.date, column: str = DAY) -> Table:
    return create_as(table, on_day(source, day, column))


def insert_day(table: Table, source: DataFrame, day: dt.date, column: str = DAY) -> None:
    append(table, on_day(source, day, column))
