"""One day of a table, as a frame or as files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..functions.columns import DAY, upper_headers
from ..operators.days import on_day
from ..sinks.files import export
from ..sources.files import read_csv, read_parquet


def day_slice(df: DataFrame, day: dt.date, column: str = DAY) -> DataFrame:
    """One day's rows under upper-case headers."""
    return upper_headers(on_day(df, day, column))


def export_day(
    df: DataFrame, day: dt.date, path: str, file_type: str, column: str = DAY
) -> DataFrame:
    """Write one day's rows as ``parquet`` or ``csv`` and read them back, typed."""
    rows = on_day(df, day, column)
    export(rows, path, file_type)
    spark = df.sparkSession
    return read_parquet(spark, path) if file_type == "parquet" else read_csv(spark, path, rows.schema, line_breaks=True)
