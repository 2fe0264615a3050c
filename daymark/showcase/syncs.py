"""Syncs, ingests and snapshots, each read back from its target."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import DAY
from ..plans import snapshots
from ..plans.ingest import ingest_all, ingest_new_days
from ..plans.run import run
from ..plans.sync import sync_days, sync_two_hops
from ..session import scratch_dir
from ..sinks.files import write_csv
from ..sinks.tables import replace
from ..sources.tables import SESSION_CATALOG, CatalogTable, Lake
from .registry import (
    EVENT_DAY,
    ORDER_DAY,
    events_by_day,
    lineitem_by_day,
    orders_by_day,
    query,
    scratch_lake,
    table,
)

# What the target holds before a sync: only some rows of the older days.  The
# days it holds must stay as they are, however incomplete.
SEED_SQL = f"o_orderstatus = 'F' AND {ORDER_DAY} < DATE '1998-01-01'"
SYNCED_SQL = f"""
SELECT o.*, {ORDER_DAY} AS DATE FROM orders o
WHERE ({SEED_SQL}) OR {ORDER_DAY} NOT IN (SELECT {ORDER_DAY} FROM orders WHERE {SEED_SQL})
"""


def _seed(orders: DataFrame) -> DataFrame:
    before = F.col(DAY) < F.lit(dt.date(1998, 1, 1))
    return orders.where((F.col("o_orderstatus") == "F") & before)


@query(SYNCED_SQL)
def sync_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = orders_by_day(spark, sf_dir)
    target = scratch_lake(spark).table("silver", "orders")
    sync_days(_seed(orders), target)
    sync_days(orders, target)
    return target.read()


@query(SYNCED_SQL)
def sync_incremental_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; the day list is as long as the table has days."""
    orders = orders_by_day(spark, sf_dir)
    target = scratch_lake(spark).table("silver", "orders")
    sync_days(_seed(orders), target)
    sync_days(orders, target)
    return target.read()


@query(SYNCED_SQL)
def sync_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = orders_by_day(spark, sf_dir)
    target = scratch_lake(spark).table("silver", "orders")
    sync_days(_seed(orders), target)
    for _ in range(2):
        sync_days(orders, target)
    return target.read()


ASKED = [
    first + dt.timedelta(days=i)
    for first, days in ((dt.date(1997, 6, 1), 30), (dt.date(1999, 2, 1), 28))
    for i in range(days)
]
ASKED_SQL = (
    f"({ORDER_DAY} BETWEEN DATE '1997-06-01' AND DATE '1997-06-30' "
    f"OR {ORDER_DAY} BETWEEN DATE '1999-02-01' AND DATE '1999-02-28')"
)


@query(
    f"""
    SELECT o.*, {ORDER_DAY} AS DATE FROM orders o
    WHERE ({SEED_SQL}) OR ({ASKED_SQL} AND {ORDER_DAY} NOT IN (SELECT {ORDER_DAY} FROM orders WHERE {SEED_SQL}))
    """
)
def sync_one_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of two months asked for; the target holds some of the first."""
    orders = orders_by_day(spark, sf_dir)
    target = scratch_lake(spark).table("silver", "orders")
    sync_days(_seed(orders), target)
    sync_days(orders, target, only=ASKED)
    return target.read()


MART_SEED_SQL = f"o_orderstatus = 'O' AND {ORDER_DAY} < DATE '1996-01-01'"


@query(
    f"""
    WITH local AS ({SYNCED_SQL})
    SELECT o.*, {ORDER_DAY} AS DATE FROM orders o WHERE {MART_SEED_SQL}
    UNION ALL
    SELECT * FROM local
    WHERE DATE NOT IN (SELECT {ORDER_DAY} FROM orders WHERE {MART_SEED_SQL})
    """
)
def sync_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = orders_by_day(spark, sf_dir)
    lake = scratch_lake(spark)
    local, mart = lake.table("silver", "orders"), lake.table("gold", "orders")
    early = F.col(DAY) < F.lit(dt.date(1996, 1, 1))
    sync_days(_seed(orders), local)
    sync_days(orders.where((F.col("o_orderstatus") == "O") & early), mart)
    sync_two_hops(orders, local, mart)
    return mart.read()


@query(
    """
    SELECT unnest(['silver', 'gold']) AS layer, name AS "table", n AS rows FROM (
      SELECT 'orders' AS name, COUNT(*) AS n FROM orders
      UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem
      UNION ALL SELECT 'events', COUNT(*) FROM events)
    """
)
def multi_table_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables over both hops, published; what the newest snapshot says it holds."""
    lake = scratch_lake(spark)
    sources = {
        "orders": orders_by_day(spark, sf_dir),
        "lineitem": lineitem_by_day(spark, sf_dir),
        "events": events_by_day(spark, sf_dir),
    }
    root = scratch_dir(spark, "snapshots")
    run(lake, sources, publish_to=root, today=dt.date(2024, 2, 1))
    return snapshots.newest(spark, root).select("layer", "table", "rows")


EVENT_TEXT = "event_id", "ts", "user_id", "event_type", "value", "props"
EVENT_TEXT_SQL = f"""
SELECT CAST(event_id AS VARCHAR) AS event_id,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, CAST(user_id AS VARCHAR) AS user_id,
       event_type, CAST(value AS VARCHAR) AS value, props, {EVENT_DAY} AS DATE
FROM events
"""


def _events_csv(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "events-csv")
    day = F.col(DAY).alias("date")
    write_csv(events_by_day(spark, sf_dir).select(*EVENT_TEXT, day), path)
    return path


@query(
    f"""
    WITH e AS ({EVENT_TEXT_SQL})
    SELECT * FROM e WHERE event_type = 'click' AND DATE < DATE '2024-01-16'
       OR DATE NOT IN (SELECT DATE FROM e WHERE event_type = 'click' AND DATE < DATE '2024-01-16')
    """
)
def csv_ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_lake(spark).table("bronze", "events")
    clicks = events_by_day(spark, sf_dir).where(
        (F.col("event_type") == "click") & (F.col(DAY) < F.lit(dt.date(2024, 1, 16)))
    )
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    held = clicks.withColumn("ts", ts).select(*[F.col(c).cast("string") for c in EVENT_TEXT], DAY)
    sync_days(held, target)
    ingest_new_days(spark, _events_csv(spark, sf_dir), target)
    return target.read()


@query(
    """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source,
           DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE
    FROM documents
    """
)
def csv_ingest_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks and quotes, loaded as new days; the second load adds nothing."""
    day = F.expr("date_add(DATE'2024-01-01', int(doc_id % 30))").alias("date")
    path = scratch_dir(spark, "documents-csv")
    write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "source", day), path)
    target = scratch_lake(spark).table("bronze", "documents")
    for _ in range(2):
        ingest_new_days(spark, path, target)
    return target.read()


@query(f"{EVENT_TEXT_SQL} UNION ALL {EVENT_TEXT_SQL}")
def csv_ingest_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_lake(spark).table("bronze", "events")
    path = _events_csv(spark, sf_dir)
    for _ in range(2):
        ingest_all(spark, path, target)
    return target.read()


def _publish_twice(spark: SparkSession, sf_dir: str, lake: Lake) -> str:
    """Two dated copies of the events, the older one half full; their root."""
    events, root = events_by_day(spark, sf_dir), scratch_dir(spark, "snapshots")
    target = lake.table("gold", "events")
    sync_days(events.where(F.col(DAY) < F.lit(dt.date(2024, 1, 16))), target)
    snapshots.publish(lake, [("gold", "events")], root, dt.date(2024, 2, 1))
    sync_days(events, target)
    snapshots.publish(lake, [("gold", "events")], root, dt.date(2024, 2, 2))
    return root


@query(f"SELECT e.*, {EVENT_DAY} AS DATE FROM events e")
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _publish_twice(spark, sf_dir, scratch_lake(spark))
    return snapshots.read_newest(spark, root, "gold", "events")


@query(f"SELECT e.*, {EVENT_DAY} AS DATE FROM events e")
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = scratch_lake(spark)
    root = _publish_twice(spark, sf_dir, lake)
    elsewhere = Lake(spark, lake.root, ref="restored", prefix=lake.prefix).create_layers()
    snapshots.restore(elsewhere, root)
    return elsewhere.table("gold", "events").read()


@query(
    f"""
    SELECT layer, name AS "table", day, count(*) AS rows
    FROM (SELECT 'gold' AS layer, 'events' AS name, {EVENT_DAY} AS day FROM events
          UNION ALL SELECT 'gold', 'orders', {ORDER_DAY} FROM orders
          WHERE {ORDER_DAY} BETWEEN DATE '1997-01-01' AND DATE '1997-03-31')
    GROUP BY layer, name, day
    """
)
def snapshot_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two publishes of one day, of a table each, and a third of new days of the first; restored."""
    lake, root = scratch_lake(spark), scratch_dir(spark, "snapshots")
    events, orders = events_by_day(spark, sf_dir), orders_by_day(spark, sf_dir)
    first_quarter = F.col(DAY).between(F.lit(dt.date(1997, 1, 1)), F.lit(dt.date(1997, 3, 31)))
    targets = {name: lake.table("gold", name) for name in ("events", "orders")}
    sync_days(events.where(F.col(DAY) < F.lit(dt.date(2024, 1, 16))), targets["events"])
    sync_days(orders.where(first_quarter), targets["orders"])
    for name in targets:
        snapshots.publish(lake, [("gold", name)], root, dt.date(2024, 2, 1))
    sync_days(events, targets["events"])
    snapshots.publish(lake, [("gold", "events")], root, dt.date(2024, 2, 1))
    elsewhere = Lake(spark, lake.root, ref="partial", prefix=lake.prefix).create_layers()
    snapshots.restore(elsewhere, root)
    days = [
        elsewhere.table("gold", name).read().select(F.lit("gold").alias("layer"), F.lit(name).alias("table"), F.col(DAY).alias("day"))
        for name in targets
    ]
    return days[0].unionByName(days[1]).groupBy("layer", "table", "day").agg(F.count(F.lit(1)).alias("rows"))


@query(f"SELECT e.*, {EVENT_DAY} AS DATE FROM events e")
def sync_after_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the days come by an overwrite of the table, the others by a sync that keeps those."""
    events, target = events_by_day(spark, sf_dir), scratch_lake(spark).table("silver", "events")
    replace(target, events.where(F.col(DAY) < F.lit(dt.date(2024, 1, 16))), [DAY])
    sync_days(events, target)
    return target.read()


@query(f"SELECT e.*, {EVENT_DAY} AS DATE FROM events e")
def sync_into_plain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same into a table that plain SQL made, without an overwrite mode of its own."""
    events, target = events_by_day(spark, sf_dir), scratch_lake(spark).table("silver", "events")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    spark.sql(
        f"CREATE TABLE {target.identifier} ({columns}) USING parquet PARTITIONED BY (`{DAY}`) "
        f"LOCATION '{target.location}'"
    )
    sync_days(events.where(F.col(DAY) < F.lit(dt.date(2024, 1, 16))), target)
    sync_days(events, target)
    return target.read()


@query(f"SELECT e.*, {EVENT_DAY} AS DATE FROM events e")
def sync_named_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into a table by its three-part name: the days asked for first, then all that it lacks."""
    events = events_by_day(spark, sf_dir)
    database = scratch_lake(spark).database("gold")
    target = CatalogTable.named(spark, f"{SESSION_CATALOG}.{database}.events")
    first = events.agg(F.min(DAY)).first()[0]
    sync_days(events, target, only=[first] if first else [])
    sync_days(events, target)
    return target.read()
