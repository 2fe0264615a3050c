import os

import pytest
from helpers import rows
from pyspark.sql import functions as F

from daymark.functions.columns import day_column, with_day
from daymark.plans.ingest import bootstrap, stage
from daymark.session import scratch_dir
from daymark.sinks.files import write_csv
from daymark.sinks.tables import append, create_as, create_like
from daymark.sources.files import (
    base_name,
    latest_dated_file,
    latest_file,
    read_any,
    read_csv,
    read_json,
    suffix_of,
    table_name,
)
from daymark.sources.sql import query
from daymark.sources.tables import Lake, Table


def test_suffix_and_table_name():
    assert suffix_of("a/b.csv") == ".csv" and suffix_of("silver.orders") is None
    assert table_name("s3a://x/y/companies.parquet") == "companies"
    assert base_name("x/data.v2.json") == "data.v2"
    assert table_name("x/staff-go-20240101.parquet") == "staff_go_20240101"
    assert table_name("orders") == "orders"


def test_csv_columns_are_strings(spark):
    path = scratch_dir(spark, "csv")
    write_csv(spark.sql("SELECT 1 AS a, DATE'2024-01-01' AS b, CAST(NULL AS STRING) AS c"), path)
    df = read_csv(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["string"] * 3
    assert rows(df) == [("1", "2024-01-01", None)]


def test_typed_csv_is_lossless(spark):
    df = spark.sql(
        """SELECT 'say "hi", \\n twice' AS t, 0.1D AS d,
           TIMESTAMP_NTZ'2024-01-01 01:02:03.123456' AS n, TIMESTAMP'2024-01-01 01:02:03.654321' AS z"""
    ).drop("x")
    texts = ['say "hi", \n twice', "a\nb\r\nc", " pad\t", "", None, "\\", 'end\\"', "NULL"]
    df = df.drop("t").crossJoin(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int"))
    path = scratch_dir(spark, "csv")
    write_csv(df, path)
    found = read_csv(spark, path, df.schema, line_breaks=True)
    assert sorted(found.collect(), key=lambda r: r.i) == sorted(df.collect(), key=lambda r: r.i)


def test_codes_stay_text_where_a_table_is_found_again(spark, lake):
    df = spark.sql("SELECT 1 AS i, '007' AS code UNION ALL SELECT 2, '010'")
    table = create_as(lake.table("bronze", "codes"), df, ["code"])
    spark.sql(f"DROP TABLE {table.identifier}")
    assert table.exists() and rows(table.read()) == [(1, "007"), (2, "010")]
    path = scratch_dir(spark, "foreign")
    df.write.mode("overwrite").partitionBy("code").parquet(path)
    foreign = Table(spark, table.database, "foreign", path)
    assert foreign.exists() and rows(foreign.read()) == [(1, "007"), (2, "010")]


def test_json_schema_is_inferred_and_sorted(spark):
    path = scratch_dir(spark, "json")
    with open(os.path.join(path, "d.json"), "w") as out:
        out.write('[\n {"b": 1,\n  "a": "x"},\n {"b": 2, "a": null}\n]')
    df = read_json(spark, path)
    assert df.dtypes == [("a", "string"), ("b", "bigint")]
    assert df.count() == 2
    assert read_json(spark, path, spark.range(1).toDF("b").schema).columns == ["b"]


def test_stage_names_the_table_after_the_file(spark, lake, sf_dir):
    staged = stage(lake, f"{sf_dir}/nation.parquet")
    assert lake.table("bronze", "nation").exists() and staged.count() == 25
    identifier = lake.table("bronze", "nation").identifier
    assert read_any(spark, identifier).count() == 25
    assert stage(lake, identifier).count() == 25


def test_query_takes_parameters_not_text(spark):
    views = {"v": spark.sql("SELECT 'x' AS a")}
    df = query(spark, "SELECT * FROM v WHERE a = :a", {"a": "x' OR '1'='1"}, views)
    assert df.columns == ["A"] and df.count() == 0


def test_latest_file_is_the_newest(spark):
    path = scratch_dir(spark, "artifacts")
    for i, name in enumerate(["b.gz", "a.gz", "c.txt"]):
        file = os.path.join(path, name)
        with open(file, "w") as out:
            out.write(name)
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    found = latest_file(spark, path, "*.gz").collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in found] == ["a.gz"]
    assert latest_file(spark, path, "*.none").collect() == []


def test_day_column_in_any_case(spark):
    df = spark.sql("SELECT 1 AS a, '2024-01-02' AS Date, 'x' AS b")
    assert day_column(df) == "Date"
    assert with_day(df).dtypes == [("a", "int"), ("DATE", "date"), ("b", "string")]
    for bad in ("SELECT 1 AS a", "SELECT 1 AS date, 2 AS DATE"):
        with pytest.raises(ValueError, match="one DATE column"):
            day_column(spark.sql(bad))


def test_a_later_session_finds_the_table_again(spark, lake):
    df = spark.sql("SELECT 1 AS a, 'x y' AS b, DATE'2024-01-02' AS DATE")
    append(create_like(lake.table("silver", "t"), df, ["b", "DATE"]), df)
    spark.sql(f"DROP TABLE {lake.table('silver', 't').identifier}")
    again = lake.table("silver", "t")
    assert not spark.catalog.tableExists(again.identifier)
    assert again.exists()
    assert again.partition_columns() == ["b", "DATE"]
    assert rows(again.read()) == [(1, "x y", df.first()["DATE"])]
    assert not lake.table("silver", "absent").exists()


def test_refs_are_separate(spark, lake):
    side = Lake(spark, lake.root, ref="side", prefix=lake.prefix).create_layers()
    create_as(lake.table("gold", "t"), spark.range(3))
    assert not side.table("gold", "t").exists()
    with pytest.raises(ValueError, match="no layer"):
        lake.table("platinum", "t")


def test_two_lakes_must_not_share_a_database(spark, lake):
    with pytest.raises(ValueError, match="choose a prefix"):
        Lake(spark, scratch_dir(spark, "lake"), prefix=lake.prefix).create_layers()
    assert Lake(spark, "relative/root").root.startswith("file:/")


def test_quoting_of_odd_columns(spark, lake):
    df = spark.sql("SELECT 1 AS `a b`, 2 AS `c``d`, 'x' AS `select`, 'y' AS `e.f`")
    table = create_as(lake.table("gold", "t"), df, ["select", "e.f"])
    assert rows(table.read()) == [(1, 2, "x", "y")]
    assert table.partition_columns() == ["select", "e.f"]


def test_bootstrap_modes(spark, lake, sf_dir):
    target = lake.table("bronze", "nation")
    source = f"{sf_dir}/nation.parquet"
    assert bootstrap(spark, source, target).read().count() == 25
    assert bootstrap(spark, source, target).read().count() == 50
    assert bootstrap(spark, source, target, ["n_regionkey"], mode="overwrite").read().count() == 25
    with pytest.raises(ValueError, match="neither"):
        bootstrap(spark, source, target, mode="merge")


def test_bootstrap_does_not_ignore_another_layout(spark, lake, sf_dir):
    target = lake.table("bronze", "nation")
    source = f"{sf_dir}/nation.parquet"
    bootstrap(spark, source, target, ["n_regionkey"], cluster=False)
    with pytest.raises(ValueError, match="is partitioned by"):
        bootstrap(spark, source, target, ["n_name"])
    assert target.read().count() == 25
    assert bootstrap(spark, source, target, ["N_REGIONKEY"], cluster=False).read().count() == 50
    assert bootstrap(spark, source, target, cluster=False).read().count() == 75


def test_old_exports_are_not_listed(spark, monkeypatch):
    from daymark.sources import files

    root = scratch_dir(spark, "artifacts")

    def put(folder, name):
        os.makedirs(os.path.join(root, folder), exist_ok=True)
        with open(os.path.join(root, folder, name), "w") as out:
            out.write(name)  # Spark leaves out empty files

    listed = []
    real = files._folders
    monkeypatch.setattr(files, "_folders", lambda s, p: (listed.append(p), real(s, p))[1])
    for year in range(2018, 2024):
        for month in range(1, 13):
            put(f"year={year}/month={month}/part", "a.gz")
    put("year=2023/month=12", "later.txt")

    def newest(pattern="*.gz"):
        listed.clear()
        return [r["path"].split("artifacts-")[-1].split("/", 1)[-1] for r in latest_dated_file(spark, root, pattern).collect()]

    assert newest() == ["year=2023/month=12/part/a.gz"]
    assert len(listed) == 3  # root, newest year, newest month
    put("year=2024/month=2", "none.txt")
    put("other", "z.gz")
    assert newest() == ["year=2023/month=12/part/a.gz"] and len(listed) == 5
    assert newest("later.*") == ["year=2023/month=12/later.txt"]
    assert newest("*.zip") == []
    assert files._age("load=20240101-120000") < files._age("20240102-000000")
    assert files._age("day=9") < files._age("day=10") and files._age("part") is None
