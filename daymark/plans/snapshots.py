"""Dated copies of a warehouse: publish, find the newest, restore.

What a publish copies of a table is a folder of files ``{root}/data/{layer}/{table}/{run}``,
never changed again.  The manifest says, per publish and table, in which run each day lies.  A
later publish copies only the days whose files are others by now and carries the rest of the
entries forward, so snapshots grow with what is new.  The entries of a publish come last and all
at once, so one that broke off is never found; of two publishes, whether of one day or of
different tables, none hides what only the other has.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted
from ..operators.days import in_days
from ..session import file_system
from ..sinks.tables import create_like, put_days
from ..sources import daylog
from ..sources.tables import COMMIT_IN_TASKS, TABLE_OPTIONS, Lake, Table, register
from .threads import each

# An entry is a day of a table, or the whole of one that is not laid out by day.  ``print`` tells
# whether its files have changed; ``run_days`` is how many entries the run was written for.
ENTRY = (
    "layer string, table string, partition_by array<string>, schema string, day date, rows long, "
    "print long, run string, run_days int, published string"
)
MANIFEST = f"{ENTRY}, snapshot_date date"


def _data_path(root: str, layer: str, name: str, run: str) -> str:
    return f"{root}/data/{layer}/{name}/{run}"


def _manifest_path(root: str) -> str:
    return f"{root}/manifest"


def _day_of(schema: T.StructType, partition_by: Sequence[str]) -> str | None:
    """The day column of a table laid out by one."""
    if len(partition_by) != 1:
        return None
    kinds = {f.name.lower(): f.dataType for f in schema}
    return partition_by[0] if isinstance(kinds[partition_by[0].lower()], T.DateType) else None


def _prints(df: DataFrame, day: str | None) -> dict[dt.date | None, tuple[int, int]]:
    """Rows of each day, and a hash of the files they are in; only footers are read."""
    key = F.col(quoted(day)) if day else F.lit(None).cast("date")
    files = df.select(key.alias("day"), "_metadata.file_name", "_metadata.file_size")
    files = files.groupBy("day", "file_name", "file_size").agg(F.count(F.lit(1)).alias("n"))
    days = files.groupBy("day").agg(F.sum("n"), F.bit_xor(F.xxhash64("file_name", "file_size", "n")))
    return {r[0]: (r[1], r[2]) for r in days.collect()}  # one row a calendar day


def _on(day: str, days: Sequence[dt.date | None]):
    dated = in_days(day, [d for d in days if d is not None])
    return dated | F.col(quoted(day)).isNull() if None in days else dated


def publish(
    lake: Lake, tables: Sequence[tuple[str, str]], root: str, day: dt.date, at_once: int = 4
) -> None:
    """Publish (layer, name) tables under ``day``.

    Of a table laid out by day the days are copied that are not in the newest snapshot as they are
    now, of any other all rows if a file has changed.  Nothing is shuffled, and what is copied
    is packed into as many files as its size asks for, not one a day.
    """
    spark = lake.spark
    published = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    held = defaultdict(list)
    for r in _current(spark, root).collect():
        held[r["layer"], r["table"]].append(r)

    def copy(pair: tuple[str, str]) -> list[tuple]:
        table = lake.table(*pair)
        df, partition_by = table.read(), table.partition_columns()
        schema, column = df.schema.json(), _day_of(df.schema, partition_by)
        now = _prints(df, column)
        old = {r["day"]: r for r in held[pair] if r["schema"] == schema}
        new = [d for d, (_, mark) in now.items() if d not in old or old[d]["print"] != mark]
        run = uuid.uuid4().hex
        if new:
            rows, seen = df.where(_on(column, new)) if column else df, Observation()
            rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
            options = {k: v for k, v in TABLE_OPTIONS.items() if k != "partitionOverwriteMode"}
            rows.write.options(**options, **COMMIT_IN_TASKS).parquet(_data_path(root, *pair, run))
            if seen.get["rows"] != sum(now[d][0] for d in new):
                raise RuntimeError(f"{table.identifier} changed while it was published")
        entries = []
        for d, (count, mark) in now.items():
            where = (run, len(new)) if d in new else (old[d]["run"], old[d]["run_days"])
            entries.append((*pair, partition_by, schema, d, count, mark, *where, published))
        # A table without rows has an entry too.
        return entries or [(*pair, partition_by, schema, None, 0, 0, None, 0, published)]

    entries = [e for found in each(spark, copy, tables, at_once) for e in found]
    aside = f"{_manifest_path(root)}/_{published}"
    spark.createDataFrame(entries, ENTRY).coalesce(1).write.parquet(aside)
    place = f"{_manifest_path(root)}/snapshot_date={day.isoformat()}"
    fs, folder = file_system(spark, place)
    fs.mkdirs(folder)
    daylog.renamed(spark, aside, f"{place}/publish={published}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All entries of all publishes; they grow with tables and days, not with rows."""
    fs, path = file_system(spark, _manifest_path(root))
    if not fs.exists(path):
        return spark.createDataFrame([], MANIFEST)
    files = spark.read.schema(MANIFEST).option("basePath", _manifest_path(root))
    return files.option("recursiveFileLookup", "false").parquet(f"{_manifest_path(root)}/snapshot_date=*/publish=*")


def _current(spark: SparkSession, root: str) -> DataFrame:
    """The entries of each table's last publish of its newest day."""
    entries = manifest(spark, root)
    key = F.struct("snapshot_date", "published")
    last = entries.groupBy("layer", "table").agg(F.max(key).alias("last"))
    last = last.select("layer", "table", "last.snapshot_date", "last.published")
    return entries.join(last, ["layer", "table", "snapshot_date", "published"], "left_semi")


def newest(spark: SparkSession, root: str) -> DataFrame:
    """One row a table, as it was published last: ``layer, table, snapshot_date, rows``."""
    found = _current(spark, root).groupBy("layer", "table", "snapshot_date")
    return found.agg(F.sum("rows").alias("rows"))


def read_newest(spark: SparkSession, root: str, layer: str, name: str) -> DataFrame:
    """A table as it was published last, read in place: nothing is copied."""
    found = _current(spark, root).where((F.col("layer") == layer) & (F.col("table") == name)).collect()
    if not found:
        raise LookupError(f"no snapshot under {root} has {layer}.{name}")
    return _rows_of(spark, root, found)


def _rows_of(spark: SparkSession, root: str, entries: Sequence[Row]) -> DataFrame:
    """The rows that a table's entries speak of, in one scan of their runs."""
    first = entries[0]
    schema = T.StructType.fromJson(json.loads(first["schema"]))
    runs = defaultdict(list)
    for r in entries:
        if r["run"] is not None:
            runs[r["run"]].append(r)
    if not runs:
        return spark.createDataFrame([], schema)
    paths = [_data_path(root, first["layer"], first["table"], run) for run in runs]
    df = spark.read.schema(schema).parquet(*paths)
    column = _day_of(schema, first["partition_by"])
    # Of a run that holds days published anew since, only the others count.
    whole = [run for run, held in runs.items() if len(held) == held[0]["run_days"]]
    if len(whole) == len(runs):
        return df
    of_run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    wanted = of_run.isin(whole) if whole else F.lit(False)
    for run in set(runs) - set(whole):
        wanted |= (of_run == run) & _on(column, [r["day"] for r in runs[run]])
    return df.where(wanted)


def restore(lake: Lake, root: str, at_once: int = 4) -> list[Table]:
    """Bring all tables back as they were published last; a table that is there is left alone.

    Without any snapshot nothing happens.  A table laid out by day appears with the log entry
    of its days, any other by one move; a restore that breaks off leaves neither behind.
    """
    found = defaultdict(list)
    for r in _current(lake.spark, root).collect():
        found[r["layer"], r["table"]].append(r)

    def copy(pair: tuple[str, str]) -> Table | None:
        table, entries = lake.table(*pair), found[pair]
        partition_by = entries[0]["partition_by"]
        rows = _rows_of(lake.spark, root, entries)
        column = _day_of(rows.schema, partition_by)
        if table.exists():
            days = table.listed_days(column) if column else None
            # One without any day is what a restore that was cut off left in the catalog.
            if days is None or not days.isEmpty() or not sum(r["rows"] for r in entries):
                return None
        if column and all(r["day"] is not None for r in entries):
            create_like(table, rows, partition_by)
            try:
                put_days(table, rows, column, counts={r["day"]: r["rows"] for r in entries})
            except Exception:
                table.drop()
                raise
            return table
        aside = f"{table.location}.restoring"
        writer = rows.write.mode("overwrite").options(**TABLE_OPTIONS, **COMMIT_IN_TASKS)
        writer.option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(aside)
        fs, place = file_system(lake.spark, table.location)
        fs.delete(place, True)  # Holds nothing visible, or the table would exist.
        daylog.renamed(lake.spark, aside, table.location)
        return register(table, rows.schema, partition_by)

    restored = each(lake.spark, copy, list(found), at_once)
    return [table for table in restored if table is not None]
