"""Day sets, and rows selected by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import DAY, as_day, with_day
from ..operators.days import (
    days_held,
    distinct_days,
    joined_on_days,
    known_days,
    missing_days,
    rows_on_days,
)
from .registry import (
    EVENT_DAY,
    ORDER_DAY,
    SHIP_DAY,
    events_by_day,
    lineitem_by_day,
    orders_by_day,
    query,
    table,
)


@query(f"SELECT DISTINCT {SHIP_DAY} AS DATE FROM lineitem")
def distinct_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_days(lineitem_by_day(spark, sf_dir))


@query(f"SELECT {SHIP_DAY} AS DATE FROM lineitem EXCEPT SELECT {ORDER_DAY} AS DATE FROM orders")
def missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_days(lineitem_by_day(spark, sf_dir), orders_by_day(spark, sf_dir))


@query(f"SELECT {ORDER_DAY} AS DATE FROM orders UNION SELECT {SHIP_DAY} AS DATE FROM lineitem")
def known_dates_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_days(orders_by_day(spark, sf_dir), lineitem_by_day(spark, sf_dir))


@query(
    f"""
    SELECT l.*, {SHIP_DAY} AS DATE FROM lineitem l
    WHERE {SHIP_DAY} NOT IN (SELECT {ORDER_DAY} FROM orders)
    """
)
def new_date_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lineitem_by_day(spark, sf_dir)
    return rows_on_days(items, missing_days(items, orders_by_day(spark, sf_dir)))


@query(
    f"""
    SELECT l.*, {SHIP_DAY} AS DATE FROM lineitem l
    WHERE {SHIP_DAY} NOT IN (SELECT {ORDER_DAY} FROM orders)
    """
)
def new_date_rows_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by the semi-join that a day list too long to inline falls back to."""
    items = lineitem_by_day(spark, sf_dir)
    return joined_on_days(items, missing_days(items, orders_by_day(spark, sf_dir)))


@query(
    f"""
    SELECT DATE, DATE IN (SELECT {ORDER_DAY} FROM orders) AS held
    FROM (SELECT DISTINCT {SHIP_DAY} AS DATE FROM lineitem)
    """
)
def slice_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days_held(lineitem_by_day(spark, sf_dir), orders_by_day(spark, sf_dir))


@query(
    """
    SELECT o_orderkey, said, TRY_CAST(said AS DATE) AS DATE FROM (
      SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority
                              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS said
      FROM orders)
    """
)
def cast_dates_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    return orders.withColumn(DAY, as_day(F.col("said")))


@query(f"SELECT DISTINCT {EVENT_DAY} AS DATE FROM events")
def date_column_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_by_day(spark, sf_dir).withColumnRenamed(DAY, "Date")
    return distinct_days(with_day(events.withColumn("Date", F.col("Date").cast("string"))))
