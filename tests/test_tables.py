import pyarrow.parquet as pq
import pytest
from helpers import day, files_under, rows
from pyspark.sql import functions as F

from daymark.session import scratch_dir
from daymark.sinks.files import (
    ROW_GROUP_BYTES,
    export,
    publish_dir,
    write_by_owner,
    write_entity_csv,
    write_parquet,
)
from daymark.sinks.tables import (
    add_days,
    append,
    append_by_day,
    create_as,
    create_as_day,
    create_like,
    insert_day,
    put_days,
    replace,
)


def dated(spark, *pairs):
    return spark.createDataFrame([(a, d and day(d)) for a, d in pairs], "a int, DATE date")


def test_create_like_keeps_an_existing_table(spark, lake):
    target = lake.table("silver", "t")
    create_like(target, dated(spark), ["DATE"])
    create_like(target, spark.range(1).toDF("other"), [])
    assert target.read().dtypes == [("a", "int"), ("DATE", "date")]
    assert target.partition_columns() == ["DATE"]
    assert target.read().count() == 0


def test_append_goes_by_name(spark, lake):
    target = lake.table("silver", "t")
    df = dated(spark, (1, "2024-01-01"))
    append(create_like(target, df, ["DATE"]), df.select("DATE", "a"))
    assert rows(target.read()) == [(1, day("2024-01-01"))]


def test_put_days_leaves_other_days(spark, lake):
    target = lake.table("silver", "t")
    append_by_day(target, dated(spark, (1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02")))
    put_days(target, dated(spark, (9, "2024-01-02")))
    assert rows(target.read()) == [(1, day("2024-01-01")), (9, day("2024-01-02"))]


def test_put_days_twice_is_once(spark, lake):
    target = lake.table("silver", "t")
    df = dated(spark, (1, "2024-01-01"), (2, "2024-01-02"))
    create_like(target, df, ["DATE"])
    put_days(target, df)
    put_days(target, df)
    assert rows(target.read()) == rows(df)


def test_put_days_refuses_a_table_it_would_wipe(spark, lake):
    target = lake.table("silver", "t")
    df = dated(spark, (1, "2024-01-01"))
    create_as(target, df)
    with pytest.raises(ValueError, match="not partitioned by DATE"):
        put_days(target, dated(spark, (2, "2024-01-02")))
    add_days(target, dated(spark, (2, "2024-01-02")))
    assert target.read().count() == 2


def test_replace_drops_old_partitions_and_columns(spark, lake):
    target = lake.table("silver", "t")
    replace(target, dated(spark, (1, "2024-01-01"), (2, "2024-01-02")), ["DATE"])
    replace(target, dated(spark, (3, "2024-01-02")), ["DATE"])
    assert rows(target.read()) == [(3, day("2024-01-02"))]
    replace(target, spark.range(2).toDF("n"))
    assert rows(target.read()) == [(0,), (1,)] and target.partition_columns() == []


def test_create_as_day_then_insert_day(spark, lake):
    df = dated(spark, (1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03"), (4, None))
    target = create_as_day(lake.table("gold", "t"), df, day("2024-01-01"))
    insert_day(target, df, day("2024-01-03"))
    assert [r[0] for r in rows(target.read())] == [1, 3]
    with pytest.raises(ValueError, match="exists"):
        create_as(target, df)


def test_a_failed_create_as_leaves_no_table(spark, lake):
    target = lake.table("gold", "t")
    bad = spark.range(10).select(F.raise_error(F.lit("bad row")).cast("int").alias("a"))
    with pytest.raises(Exception, match="bad row"):
        create_as(target, bad)
    assert not target.exists()
    assert create_as(target, spark.range(3)).read().count() == 3


def test_parquet_files_are_snappy(spark, lake):
    path = scratch_dir(spark, "p")
    write_parquet(spark.range(10), path)
    create_as(lake.table("gold", "t"), spark.range(10))
    for root in (path, lake.table("gold", "t").location):
        for file in files_under(root, ".parquet"):
            group = pq.ParquetFile(file).metadata.row_group(0)
            assert group.column(0).compression == "SNAPPY"
    assert ROW_GROUP_BYTES == 134217728


def test_entity_csv_has_headers_and_its_own_folder(spark):
    root = scratch_dir(spark, "db")
    path = write_entity_csv(spark.range(3).toDF("Name").coalesce(1), root, "companies")
    assert path == f"{root}/companies"
    (file,) = [f for f in files_under(path, ".csv")]
    assert open(file).read().splitlines() == ["Name", "0", "1", "2"]


def test_export_refuses_unknown_types(spark):
    with pytest.raises(ValueError, match="'xlsx'"):
        export(spark.range(1), "/nowhere", "xlsx")


def test_one_folder_per_owner(spark):
    root = scratch_dir(spark, "owners")
    df = spark.range(30).select(F.concat(F.lit("Co "), F.col("id") % 3).alias("owner"), "id")
    path = write_by_owner(df, root, "owner", "20240102-030405", rows_per_file=6)
    assert path.endswith("load=20240102-030405")
    files = files_under(path, ".parquet")
    assert len(files) == 6 and sum("owner=Co 1" in f for f in files) == 2
    assert spark.read.parquet(path).count() == 30


def test_publish_replaces_or_adds(spark):
    path = scratch_dir(spark, "pub")
    publish_dir(spark.range(3), path)
    publish_dir(spark.range(2), path, delete_existing=True)
    publish_dir(spark.range(4), path)
    assert spark.read.parquet(path).count() == 6


def test_a_hot_day_is_split_over_tasks(spark, lake):
    """Half of all rows on one day: several files for it, one for each other day."""
    keep = {
        key: spark.conf.get(key)
        for key in (
            "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize",
        )
    }
    target = lake.table("silver", "hot")
    rows_in = spark.range(0, 200_000, 1, 8).select(
        F.sha1(F.col("id").cast("string")).alias("payload"),
        F.when(F.col("id") % 2 == 0, F.lit(0))
        .otherwise(F.col("id") % 20)
        .cast("int")
        .alias("offset"),
    )
    df = rows_in.select("payload", F.date_add(F.lit(day("2024-01-01")), "offset").alias("DATE"))
    try:
        for key in keep:
            spark.conf.set(key, "600k")
        append_by_day(target, df)
    finally:
        for key, value in keep.items():
            spark.conf.set(key, value)
    hot = files_under(f"{target.location}/DATE=2024-01-01", ".parquet")
    other = files_under(f"{target.location}/DATE=2024-01-02", ".parquet")
    assert len(hot) >= 4 and len(other) == 1
    assert target.read().count() == 200_000


def test_owner_ranges_open_only_their_files(spark):
    from daymark.sinks.files import INDEX, read_owners, write_owner_ranges

    # One owner holds a third of all rows, some rows have none.
    owner = F.expr("CASE WHEN id % 3 = 0 THEN 77 WHEN id % 50 = 1 THEN NULL ELSE id % 5000 END")
    df = spark.range(30_000).select("id", owner.alias("own er"), F.lit("x").alias("t"))
    path = write_owner_ranges(df, scratch_dir(spark, "owners"), "own er", "20240101-000000", 16_000)
    assert path.endswith("/load=20240101-000000")
    index = spark.read.parquet(f"{path}/{INDEX}")
    sizes = [r["rows"] for r in index.collect()]
    assert len(sizes) > 20 and max(sizes) < 3 * 30_000 / len(sizes)
    assert spark.read.parquet(path).count() == 30_000
    for asked in ([4001], [77], [None], [1, None, 4999], [999_999], []):
        found = read_owners(spark, path, "own er", asked)
        known = [a for a in asked if a is not None]
        wanted = df.where(F.col("`own er`").isin(known) | (F.lit(None in asked) & F.col("`own er`").isNull()))
        assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in wanted.collect())
    assert len(read_owners(spark, path, "own er", [4001]).inputFiles()) <= 2
    empty = write_owner_ranges(df.limit(0), scratch_dir(spark, "owners"), "own er", "1")
    assert read_owners(spark, empty, "own er", [1]).collect() == []


def test_row_groups_are_bounded_by_the_option(spark, lake, monkeypatch):
    """The same option at a smaller size: every group but the last is near it, none far beyond."""
    from daymark.sinks import files
    from daymark.sources import tables

    assert int(tables.TABLE_OPTIONS["parquet.block.size"]) == ROW_GROUP_BYTES == 128 * 1024 * 1024
    size = 4 << 20
    monkeypatch.setattr(files, "ROW_GROUP_BYTES", size)
    monkeypatch.setitem(tables.TABLE_OPTIONS, "parquet.block.size", str(size))
    df = spark.range(0, 1_200_000, 1, 1).select("id", F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(1)).alias("g"))
    exported = f"{scratch_dir(spark, 'groups')}/t"
    write_parquet(df, exported)
    target = create_like(lake.table("silver", "groups"), df)
    append(target, df, cluster=False)
    for path in (exported, target.location):
        for file in files_under(path, ".parquet"):
            footer = pq.ParquetFile(file).metadata
            sizes = [footer.row_group(i).total_byte_size for i in range(footer.num_row_groups)]
            assert len(sizes) > 3 and max(sizes) < 1.5 * size and min(sizes[:-1]) > 0.5 * size
            codecs = {footer.row_group(i).column(0).compression for i in range(footer.num_row_groups)}
            assert codecs == {"SNAPPY"}
