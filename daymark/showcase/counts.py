"""Counts and newest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.counts import count_all as total
from ..operators.counts import count_by, count_by_sorted, latest_by
from .registry import query, table


@query("SELECT o_custkey, COUNT(*) AS order_count FROM orders GROUP BY o_custkey")
def count_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by(table(spark, sf_dir, "orders"), "o_custkey", "order_count")


@query(
    """
    SELECT o_custkey, COUNT(*) AS order_count FROM orders
    GROUP BY o_custkey ORDER BY order_count DESC
    """
)
def count_by_owner_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_view")
    return count_by_sorted(spark.table("orders_view"), "o_custkey", "order_count")


@query("SELECT COUNT(*) AS n FROM lineitem")
def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total(table(spark, sf_dir, "lineitem"))


@query(
    """
    SELECT user_id, event_id AS latest_event FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """
)
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return latest_by(events, "user_id", "event_id", "ts", "latest_event")
