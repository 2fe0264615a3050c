"""File scans, chosen by suffix."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted
from ..session import file_system
from .csvrecords import broken_records

# The file suffixes that mark a path rather than a table name.
SUFFIXES = (".csv", ".json", ".parquet")

# Folder names that are days or times: groups of digits with the usual signs between.
DATED = re.compile(r"\d{1,14}(?:[-_.:T ]\d{1,9}){0,6}Z?")

# A header row, and timestamps to the microsecond: the default keeps milliseconds.  Quotes
# are doubled, padding stays, and NULL has a mark of its own beside empty text.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}


def suffix_of(path: str) -> str | None:
    """The known suffix a path ends in, or None for a table name."""
    return next((s for s in SUFFIXES if path.endswith(s)), None)


def base_name(path: str) -> str:
    """Last path segment without a known file suffix."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.removesuffix(suffix_of(name) or "")


def table_name(path: str) -> str:
    """The base name with what a table name cannot hold replaced by underscores."""
    return re.sub(r"\W", "_", base_name(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, line_breaks: bool = False
) -> DataFrame:
    """CSV with a header row.  Every column is a string unless a schema is given;
    neither form makes an inference pass over the data.

    ``line_breaks`` says that quoted fields may hold some.  That costs a look for quotes, and
    where there are any a second reading; files stay split over tasks (see ``csvrecords``).
    """
    reader = spark.read.options(**CSV_OPTIONS)
    records = broken_records(spark, path) if line_breaks else None
    if records is None:
        return (reader.schema(schema) if schema else reader).csv(path)
    # Spark looks at the first record only.
    schema = schema or reader.option("multiLine", True).csv(path).schema
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    row = F.from_csv("record", F.lit(fields), CSV_OPTIONS | {"multiLine": "true"})
    return records.select(row.alias("row")).select("row.*")


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON document per file, possibly over many lines.

    Without a schema Spark reads the files twice and returns the columns in
    alphabetical order.
    """
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_any(
    spark: SparkSession, source: str, schema: T.StructType | None = None, line_breaks: bool = True
) -> DataFrame:
    """A file by its suffix, anything else as a table name."""
    match suffix_of(source):
        case ".csv":
            return read_csv(spark, source, schema, line_breaks)
        case ".json":
            return read_json(spark, source, schema)
        case ".parquet":
            return read_parquet(spark, source)
        case _:
            return spark.table(source)


def query_in_place(
    spark: SparkSession, path: str, columns: str = "*", fmt: str = "parquet"
) -> DataFrame:
    """SQL straight over raw files, without a table."""
    return spark.sql(f"SELECT {columns} FROM {fmt}.{quoted(path)}")


def latest_file(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path and time of the newest file under ``root``; at most one row.

    Only the listing is used: the content column is never read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(root)
    )
    return (
        files.select("path", F.col("modificationTime").alias("modified"))
        .orderBy(F.col("modified").desc(), F.col("path").desc())
        .limit(1)
    )


def _age(name: str) -> tuple[int, ...] | None:
    """The numbers of a folder named after a day or time, ``key=`` before it or not; else None."""
    text = name.rsplit("=", 1)[-1]
    return tuple(map(int, re.findall(r"\d+", text))) if DATED.fullmatch(text) else None


def _folders(spark: SparkSession, path: str) -> Iterator[tuple[str, str]]:
    """Name and path of each folder in a folder; nothing deeper is listed."""
    fs, jpath = file_system(spark, path)
    found = fs.listStatusIterator(jpath)
    while found.hasNext():
        status = found.next()
        if status.isDirectory():
            yield status.getPath().getName(), status.getPath().toString()


def latest_dated_file(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """As ``latest_file``, where exports lie in folders named after their day or time.

    Such folders may be nested (``2024/01/10``, ``year=2024/month=1``) and have any key before
    ``=``.  The newest is entered first, an older one only if no file matches there: what old
    exports hold is never listed.  Folders without a date below them are looked through whole,
    by Spark.  Files beside dated folders count only if none of these has a match.
    """
    dated = [(age, path) for name, path in _folders(spark, root) if (age := _age(name)) is not None]
    for _, path in sorted(dated, reverse=True):
        found = latest_dated_file(spark, path, pattern)
        if not found.isEmpty():
            return found
    return latest_file(spark, root, pattern)
