"""Writing tables and files, read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import DAY
from ..session import scratch_dir
from ..sinks.files import publish_dir, read_owners, write_by_owner, write_owner_ranges, write_parquet
from ..sinks.tables import (
    append,
    append_by_day,
    create_as,
    create_as_day,
    create_like,
    insert_day,
    replace,
)
from ..sources.files import read_parquet
from .registry import (
    EVENT_DAY,
    ORDER_DAY,
    events_by_day,
    orders_by_day,
    query,
    scratch_lake,
    table,
)


@query(f"SELECT o.*, {ORDER_DAY} AS DATE FROM orders o")
def create_like_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = orders_by_day(spark, sf_dir)
    target = scratch_lake(spark).table("silver", "orders")
    # Three states: a task writes a file for each, and nothing is shuffled.
    append(create_like(target, orders, ["o_orderstatus"]), orders, cluster=False)
    return target.read().select(*orders.columns)


@query(f"SELECT e.*, {EVENT_DAY} AS DATE FROM events e")
def append_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_by_day(spark, sf_dir)
    target = scratch_lake(spark).table("silver", "events")
    middle = F.lit(dt.date(2024, 1, 16))
    append_by_day(target, events.where(F.col(DAY) < middle))
    append_by_day(target, events.where(F.col(DAY) >= middle))
    return target.read()


@query("SELECT p_partkey, p_name, p_retailprice * 2 AS p_retailprice FROM part")
def overwrite_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    target = scratch_lake(spark).table("silver", "part")
    replace(target, part)
    doubled = (F.col("p_retailprice") * 2).alias("p_retailprice")
    return replace(target, part.select("p_partkey", "p_name", doubled)).read()


@query("SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def overwrite_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    path = scratch_dir(spark, "customer")
    write_parquet(customers, path)
    write_parquet(customers.select("c_custkey", F.upper("c_name").alias("c_name")), path)
    return read_parquet(spark, path)


@query("SELECT * FROM lineitem")
def ctas_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_lake(spark).table("gold", "lineitem")
    return create_as(target, table(spark, sf_dir, "lineitem")).read()


@query(
    f"""
    SELECT e.*, {EVENT_DAY} AS DATE FROM events e
    WHERE {EVENT_DAY} IN (DATE '2024-01-10', DATE '2024-01-11')
    """
)
def ctas_then_insert_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_by_day(spark, sf_dir)
    target = scratch_lake(spark).table("gold", "events")
    create_as_day(target, events, dt.date(2024, 1, 10), "ts")
    insert_day(target, events, dt.date(2024, 1, 11), "ts")
    return target.read()


@query("SELECT * FROM supplier UNION ALL SELECT * FROM supplier")
def replace_or_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    path = scratch_dir(spark, "published")
    publish_dir(suppliers, path)
    publish_dir(suppliers, path, delete_existing=True)
    publish_dir(suppliers, path)
    return read_parquet(spark, path)


@query("SELECT * FROM customer")
def files_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    root = scratch_dir(spark, "owners")
    path = write_by_owner(customers, root, "c_mktsegment", "20240101-000000")
    return spark.read.schema(customers.schema).parquet(path).select(*customers.columns)


@query("SELECT * FROM orders")
def files_by_many_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = write_owner_ranges(orders, scratch_dir(spark, "owners"), "o_custkey", "20240101-000000")
    return spark.read.parquet(path)


@query("SELECT * FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)")
def one_of_many_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = write_owner_ranges(orders, scratch_dir(spark, "owners"), "o_custkey", "20240101-000000", 1 << 20)
    last = orders.agg(F.max("o_custkey")).first()[0]
    return read_owners(spark, path, "o_custkey", [last])


@query("SELECT * FROM part")
def table_exists_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load a table only where it is absent: the second round must add nothing."""
    target = scratch_lake(spark).table("gold", "part")
    for _ in range(2):
        if not target.exists():
            create_as(target, table(spark, sf_dir, "part"))
    return target.read()
