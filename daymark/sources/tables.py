"""Tables of a lake: named in the session catalog, stored under one root.

A table's path is ``{root}/{ref}/{layer}/{name}``, so it outlives a session whose
catalog does not, and can be found again wherever the folder was moved.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted
from ..session import bounded_listing, file_system, qualified
from . import daylog

LAYERS = ("bronze", "silver", "gold")

# The line of DESCRIBE TABLE that, with a header line, precedes the
# partition columns, and the property that says who keeps the list of partitions.
PARTITION_HEADING = "# Partition Information"
PARTITION_PROVIDER = ("Partition Provider", "Catalog")
STORED_OPTIONS = "Storage Properties"
# Beside a table's files: its columns and partition columns, for whoever finds it again.
LAYOUT_FILE = "_layout.json"

# Dynamic overwrite is a property of the table: an overwrite replaces the
# partitions it writes and leaves the rest, whatever the session says.
TABLE_OPTIONS = {
    "partitionOverwriteMode": "dynamic",
    "compression": "snappy",
    "parquet.block.size": str(128 * 1024 * 1024),
}


# For writes that only show once all of it is in place: each task then moves its own
# files, where otherwise the driver moves those of all tasks one by one.
COMMIT_IN_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


class Named:
    """What the catalog alone can say of a table, wherever it lies."""

    spark: SparkSession
    identifier: str

    def read(self) -> DataFrame:
        return self.spark.table(self.identifier)

    def _description(self) -> list[tuple[str, str]]:
        """Answered by the catalog alone, where ``listColumns`` would run Spark jobs."""
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.identifier}").collect()
        return [(r["col_name"], r["data_type"]) for r in rows]

    def partition_columns(self) -> list[str]:
        names = [name for name, _ in self._description()]
        if PARTITION_HEADING not in names:
            return []
        listed = names[names.index(PARTITION_HEADING) + 2 :]
        return listed[: listed.index("")]

    def overwrite_mode(self) -> str | None:
        """The partition overwrite mode stored with the table, if any is."""
        stored = dict(self._description()).get(STORED_OPTIONS, "")
        found = re.search(r"partitionOverwriteMode=(\w+)", stored, re.IGNORECASE)
        return found[1].lower() if found else None

    def is_by_day(self, day: str) -> bool:
        return [c.lower() for c in self.partition_columns()] == [day.lower()]

    def listed_days(self, day: str) -> DataFrame | None:
        """Days that the catalog lists partitions for, NULL included; no file is opened.

        None if the table is not laid out by day or the catalog keeps no list.  A
        listed partition counts even if someone emptied its folder by hand.
        """
        if not self.is_by_day(day) or PARTITION_PROVIDER not in self._description():
            return None
        value = F.substring_index("partition", "=", -1).try_cast("date")
        partitions = self.spark.sql(f"SHOW PARTITIONS {self.identifier}")
        return partitions.select(value.alias(day)).distinct()


@dataclass(frozen=True)
class Table(Named):
    spark: SparkSession = field(repr=False, compare=False)
    database: str
    name: str
    location: str

    @property
    def identifier(self) -> str:
        return f"{quoted(self.database)}.{quoted(self.name)}"

    def exists(self) -> bool:
        """Is there such a table?  One that an earlier session left at the path is
        named again first, so its rows are never taken for absent."""
        if self.spark.catalog.tableExists(self.identifier):
            return True
        if next(_children(self.spark, self.location), None) is None and not daylog.holds(self.spark, self.location):
            return False
        attach(self)
        return True

    def drop(self) -> None:
        """Forget a table that was created and never written to, with its layout file."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.identifier}")
        fs, path = file_system(self.spark, f"{self.location}/{LAYOUT_FILE}")
        fs.delete(path, False)


SESSION_CATALOG = "spark_catalog"


@dataclass(frozen=True)
class CatalogTable(Named):
    """A table by its name in a catalog, ``catalog.namespace.table``, which decides where it lies.

    ``Settings.catalogs`` says what the catalogs are.  ``provider`` is the format of a table that
    is created; None leaves it to the catalog (Parquet in Spark's own).
    """

    spark: SparkSession = field(repr=False, compare=False)
    catalog: str
    namespace: tuple[str, ...]
    name: str
    provider: str | None = None

    @classmethod
    def named(cls, spark: SparkSession, name: str, provider: str | None = None) -> CatalogTable:
        parts = name.split(".")
        if len(parts) < 3 or not all(parts):
            raise ValueError(f"{name!r} is not catalog.namespace.table")
        return cls(spark, parts[0], tuple(parts[1:-1]), parts[-1], provider)

    @property
    def identifier(self) -> str:
        return ".".join(map(quoted, [self.catalog, *self.namespace, self.name]))

    def in_session_catalog(self) -> bool:
        """Whether Spark's own catalog holds it, whose file tables take no DataFrameWriterV2."""
        set_by_user = self.spark.conf.get(f"spark.sql.catalog.{SESSION_CATALOG}", "builtin")
        return self.catalog == SESSION_CATALOG and set_by_user == "builtin"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.identifier)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.identifier}")

    def create(self, schema: T.StructType, partition_by: Sequence[str] = ()) -> CatalogTable:
        """CREATE TABLE IF NOT EXISTS, its namespace too; an existing one is left as it is."""
        self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {'.'.join(map(quoted, [self.catalog, *self.namespace]))}")
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
        provider, options = self.provider, ""
        if self.in_session_catalog():
            provider = provider or "parquet"
            options = f" OPTIONS ({option_list(TABLE_OPTIONS)})"
        using = f" USING {provider}" if provider else ""
        partitions = f" PARTITIONED BY ({', '.join(map(quoted, partition_by))})" if partition_by else ""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.identifier} ({columns}){using}{options}{partitions}")
        return self


@dataclass(frozen=True)
class Lake:
    """Layer namespaces under ``root`` for one branch ``ref``.

    Two lakes in one session need different ``prefix``es for their databases.
    """

    spark: SparkSession = field(repr=False, compare=False)
    root: str
    ref: str = "main"
    layers: tuple[str, ...] = LAYERS
    prefix: str = ""

    def __post_init__(self) -> None:
        # A relative root would mean one thing to a reader and another to the catalog.
        object.__setattr__(self, "root", qualified(self.spark, self.root))
        bounded_listing(self.spark)

    def database(self, layer: str) -> str:
        if layer not in self.layers:
            raise ValueError(f"no layer {layer!r}; this lake has {self.layers}")
        return self.prefix + (layer if self.ref == "main" else f"{self.ref}_{layer}")

    def path(self, layer: str) -> str:
        return f"{self.root}/{self.ref}/{layer}"

    def create_layers(self) -> Lake:
        for layer in self.layers:
            name, path = self.database(layer), self.path(layer)
            self.spark.sql(
                f"CREATE DATABASE IF NOT EXISTS {quoted(name)} LOCATION {literal(path)}"
            )
            found = qualified(self.spark, self.spark.catalog.getDatabase(name).locationUri)
            if found != path:
                raise ValueError(f"database {name} is at {found}, not {path}: choose a prefix")
        return self

    def table(self, layer: str, name: str) -> Table:
        return Table(self.spark, self.database(layer), name, f"{self.path(layer)}/{name}")


def option_list(options: Mapping[str, str]) -> str:
    return ", ".join(f"{literal(k)} = {literal(v)}" for k, v in options.items())


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(table: Table, schema: T.StructType, partition_by: Sequence[str] = ()) -> Table:
    """CREATE TABLE IF NOT EXISTS at the table's path; an existing one is left as it is.

    Partition folders already there are taken up; later ones come in with each write.
    """
    if table.spark.catalog.tableExists(table.identifier):
        return table
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    partitions = f"PARTITIONED BY ({', '.join(map(quoted, partition_by))}) " if partition_by else ""
    table.spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table.identifier} ({columns}) USING parquet "
        f"OPTIONS ({option_list(TABLE_OPTIONS)}) {partitions}LOCATION {literal(table.location)}"
    )
    if partition_by and next(_children(table.spark, table.location), None):
        table.spark.catalog.recoverPartitions(table.identifier)
    if len(partition_by) == 1 and (days := daylog.logged(table.spark, table.location)):
        places = ((value, f"{table.location}/{path}") for value, path in days.items())
        daylog.name_days(table.spark, table.identifier, partition_by[0], places)
    _write_layout(table, schema, partition_by)
    return table


def attach(table: Table) -> Table:
    """Name files that already lie at the table's path, whoever wrote them.

    The layout file says what they are.  Without one the columns come from one folder of
    files and the partition columns from the folder names: dates where all values are,
    else text, as a guess would make numbers of codes like ``007``.
    """
    if layout := _read_layout(table):
        return register(table, *layout)
    partitions, path = [], table.location
    while folder := next((n for n in _children(table.spark, path) if "=" in n), None):
        name = unquote(folder.split("=", 1)[0])
        beside = (unquote(n.split("=", 1)[1]) for n in _children(table.spark, path) if "=" in n)
        dates = all(re.fullmatch(r"\d{4}-\d{2}-\d{2}|__HIVE_DEFAULT_PARTITION__", v) for v in beside)
        kind = T.DateType() if dates else T.StringType()
        partitions.append(T.StructField(name, kind))
        path = f"{path}/{folder}"
    columns = table.spark.read.parquet(path).schema.fields
    return register(table, T.StructType([*columns, *partitions]), [p.name for p in partitions])


def _write_layout(table: Table, schema: T.StructType, partition_by: Sequence[str]) -> None:
    text = json.dumps({"schema": json.loads(schema.json()), "partition_by": list(partition_by)})
    fs, path = file_system(table.spark, f"{table.location}/{LAYOUT_FILE}")
    fs.delete(path, False)
    daylog.put_text(table.spark, f"{table.location}/{LAYOUT_FILE}", text)


def _read_layout(table: Table) -> tuple[T.StructType, list[str]] | None:
    fs, path = file_system(table.spark, f"{table.location}/{LAYOUT_FILE}")
    if not fs.exists(path):
        return None
    layout = json.loads(daylog.text_of(table.spark, f"{table.location}/{LAYOUT_FILE}"))
    return T.StructType.fromJson(layout["schema"]), layout["partition_by"]


def _children(spark: SparkSession, path: str) -> Iterator[str]:
    """Names in a folder, hidden ones aside, listed no further than they are asked for."""
    return (name for name in daylog.children(spark, path) if not name.startswith(("_", ".")))
