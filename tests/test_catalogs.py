import pytest
from helpers import day, plan, rows
from pyspark.sql import functions as F

from daymark.__main__ import _parser, _target
from daymark.plans.ingest import bootstrap, ingest_new_days
from daymark.plans.sync import sync_days, sync_two_hops
from daymark.session import scratch_dir
from daymark.sinks.files import write_csv, write_parquet
from daymark.sinks.tables import append, create_like, put_days, replace
from daymark.sources.tables import CatalogTable


@pytest.fixture
def target(spark, lake):
    return CatalogTable.named(spark, f"spark_catalog.{lake.database('gold')}.t")


def dated(spark, *pairs):
    return spark.createDataFrame([(a, d and day(d)) for a, d in pairs], "a int, DATE date")


def test_sync_into_a_named_table(spark, target):
    first = sync_days(dated(spark, (1, "2024-01-01"), (2, "2024-01-02"), (3, None)), target, only=[day("2024-01-01")])
    assert (first.days, first.rows) == (1, 1) and target.partition_columns() == ["DATE"]
    again = dated(spark, (1, "2024-01-01"), (9, "2024-01-01"), (2, "2024-01-02"), (4, "2024-01-02"), (3, None))
    second = sync_days(again, target)
    assert (second.days, second.rows, second.null_day_rows) == (1, 2, 1)
    assert rows(target.read().select("a")) == [(1,), (2,), (4,)]
    assert sync_days(again, target).days == 0
    assert "PartitionFilters: [isnotnull(DATE" in plan(target.read().where(F.col("DATE") == day("2024-01-02")))


def test_a_hop_from_a_named_table(spark, lake, target):
    put_days(create_like(target, dated(spark), ["DATE"]), dated(spark, (1, "2024-01-01"), (2, "2024-01-02")))
    local = lake.table("silver", "t")
    other = CatalogTable.named(spark, f"spark_catalog.{lake.database('silver')}.u")
    reports = sync_two_hops(target, local, other)
    assert (reports.local.rows, reports.mart.rows) == (2, 2)
    assert rows(other.read()) == rows(target.read())


def test_put_days_replaces_whole_days_only(spark, target):
    append(create_like(target, dated(spark), ["DATE"]), dated(spark, (1, "2024-01-01"), (2, "2024-01-02")))
    swapped = dated(spark, (7, "2024-01-02"), (8, None)).select("DATE", "a")  # matched by name
    done = put_days(target, swapped)
    assert (done.days, done.rows, done.null_day_rows) == (("2024-01-02",), 1, 1)
    assert [r[0] for r in rows(target.read())] == [1, 7]
    assert put_days(target, dated(spark)).days == () and target.read().count() == 2


def test_bootstrap_and_ingest_into_a_named_table(spark, lake, target):
    folder = scratch_dir(spark, "named")
    df = dated(spark, (1, "2024-01-01"), (2, "2024-01-02"))
    write_parquet(df, f"{folder}/t.parquet")
    write_csv(df.select("a", "DATE"), f"{folder}/u.csv")
    bootstrap(spark, f"{folder}/t.parquet", target, ["DATE"])
    bootstrap(spark, f"{folder}/t.parquet", target, ["DATE"])
    assert target.read().count() == 4
    with pytest.raises(ValueError, match="partitioned by"):
        bootstrap(spark, f"{folder}/t.parquet", target, ["a"])
    bootstrap(spark, f"{folder}/t.parquet", target, ["a"], mode="overwrite")
    assert target.partition_columns() == ["a"] and rows(target.read().select("a", "DATE")) == rows(df)
    put_days(replace(target, df, ["DATE"]), dated(spark, (5, "2024-01-02")))
    assert [r[0] for r in rows(target.read())] == [1, 5]  # days not written stay, after a replacement too
    other = CatalogTable.named(spark, f"spark_catalog.{lake.database('gold')}.u")
    assert ingest_new_days(spark, f"{folder}/u.csv", other).rows == 2


def test_jobs_take_a_named_table(spark, lake):
    def target(*given):
        return _target(_parser().parse_args(["--root", "x", "ingest", "f.csv", *given]), lake)

    assert target("--into", "c.a.b.t") == CatalogTable(spark, "c", ("a", "b"), "t")
    assert target("gold", "t") == lake.table("gold", "t")
    for wrong in ([], ["gold", "t", "--into", "c.b.t"]):
        with pytest.raises(SystemExit, match="--into"):
            target(*wrong)


def test_other_catalogs_go_by_the_v2_writer(spark, monkeypatch):
    """No catalog with tables of its own is at hand, so the calls are recorded instead of run."""
    calls = []

    class Writer:
        def __getattr__(self, name):
            return lambda *args: calls.append((name, *map(str, args))) or self

    from daymark.sinks import tables

    table = CatalogTable.named(spark, "lake.a.b.t", "iceberg")
    df = dated(spark, (1, "2024-01-01"))
    monkeypatch.setattr(type(df), "writeTo", lambda self, name: calls.append(("writeTo", name)) or Writer())
    tables._overwrite_partitions(table, df)
    replace(table, df, ["DATE"], cluster=False)
    name = ("writeTo", "`lake`.`a`.`b`.`t`")
    assert calls[:4] == [name, ("overwritePartitions",), name, ("using", "iceberg")]
    assert calls[4][0] == "partitionedBy" and "DATE" in calls[4][1] and calls[5:] == [("createOrReplace",)]


@pytest.mark.parametrize("name", ["t", "a.t", "a..t", ".b.t"])
def test_names_need_three_parts(spark, name):
    with pytest.raises(ValueError, match="catalog.namespace.table"):
        CatalogTable.named(spark, name)
