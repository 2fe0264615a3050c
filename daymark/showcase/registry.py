"""The registry, and frames the queries share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import DAY
from ..session import scratch_dir
from ..sources.files import read_parquet
from ..sources.tables import Lake

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# SQL of the day columns that the frames below carry.
ORDER_DAY = "CAST(o_orderdate AS DATE)"
SHIP_DAY = "CAST(l_shipdate AS DATE)"
EVENT_DAY = "CAST(ts AS DATE)"


def query(sql: str) -> Callable[[Query], Query]:
    """Register a function under its own name, with its oracle SQL."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def scratch_lake(spark: SparkSession) -> Lake:
    """A lake of its own, so queries neither see nor disturb each other."""
    prefix = f"showcase_{uuid.uuid4().hex[:12]}_"
    return Lake(spark, scratch_dir(spark, "lake"), prefix=prefix).create_layers()


def orders_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.withColumn(DAY, F.col("o_orderdate").cast("date"))


def lineitem_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.withColumn(DAY, F.col("l_shipdate").cast("date"))


def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.withColumn(DAY, F.col("ts").cast("date"))
