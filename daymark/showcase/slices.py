"""One day of a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import DAY
from ..operators.days import on_day
from ..plans.slices import day_slice, export_day
from ..plans.sync import sync_days
from ..session import scratch_dir
from ..sinks.files import write_csv
from ..sources.files import read_csv
from .registry import EVENT_DAY, ORDER_DAY, events_by_day, query, scratch_lake, table

EVENT_SLICE = f"""
SELECT event_id AS EVENT_ID, ts AS TS, user_id AS USER_ID, event_type AS EVENT_TYPE,
       value AS VALUE, props AS PROPS, {EVENT_DAY} AS DATE
FROM events WHERE {EVENT_DAY} = DATE '2024-01-10'
"""
SLICE_DAY = dt.date(2024, 1, 10)


@query(
    f"""
    SELECT o_orderkey, o_totalprice, {ORDER_DAY} AS DATE
    FROM orders WHERE {ORDER_DAY} = DATE '1996-01-02'
    """
)
def date_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = on_day(table(spark, sf_dir, "orders"), dt.date(1996, 1, 2), "o_orderdate")
    day = F.col("o_orderdate").cast("date").alias(DAY)
    return orders.select("o_orderkey", "o_totalprice", day)


@query(EVENT_SLICE)
def date_slice_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_slice(events_by_day(spark, sf_dir), SLICE_DAY, "ts")


@query(EVENT_SLICE)
def mart_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of a table laid out by day: only that day's folder is read."""
    mart = scratch_lake(spark).table("gold", "events")
    sync_days(events_by_day(spark, sf_dir), mart)
    return day_slice(mart.read(), SLICE_DAY)


@query(f"SELECT e.*, {EVENT_DAY} AS DATE FROM events e WHERE {EVENT_DAY} = DATE '2024-01-10'")
def slice_export_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "slice")
    return export_day(events_by_day(spark, sf_dir), SLICE_DAY, path, "parquet", column="ts")


@query(
    f"""
    SELECT e.*, {EVENT_DAY} AS DATE FROM events e WHERE {EVENT_DAY} = DATE '2024-01-10'
    """
)
def slice_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "slice")
    return export_day(events_by_day(spark, sf_dir), SLICE_DAY, path, "csv", column="ts")


@query(f"{EVENT_SLICE}".replace(f"{EVENT_DAY} AS DATE", f"CAST({EVENT_DAY} AS VARCHAR) AS DATE"))
def date_slice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice by a text day under a header in lower case, as a CSV load leaves it."""
    events = events_by_day(spark, sf_dir)
    text = events.withColumn(DAY, F.col(DAY).cast("string")).withColumnRenamed(DAY, "date")
    return day_slice(text, SLICE_DAY)


ODD_TEXT = "' padded ', '', NULL, chr(10), '\\', '\"', 'a' || chr(13) || chr(10) || 'b, \"c\"'"


@query(
    f"""
    SELECT doc_id, text, lang, source, n_chars FROM documents
    UNION ALL SELECT -1, unnest([{ODD_TEXT}]), NULL, '', NULL
    """
)
def csv_round_trip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with odd texts added, through a CSV file."""
    documents = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(t,) for t in (" padded ", "", None, "\n", "\\", '"', 'a\r\nb, "c"')], "text string")
    odd = odd.selectExpr("-1L AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "'' AS source", "CAST(NULL AS LONG) AS n_chars")
    return _through_csv(documents.unionByName(odd))


@query("SELECT page_id, url, html FROM pages")
def csv_round_trip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_csv(table(spark, sf_dir, "pages"))


def _through_csv(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession, "csv")
    write_csv(df, path)
    return read_csv(df.sparkSession, path, df.schema, line_breaks=True)
