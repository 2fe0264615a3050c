import pytest
from helpers import day, files_under, plan, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daymark.operators.days import in_days
from daymark.plans import snapshots
from daymark.plans.ingest import ingest_all, ingest_new_days
from daymark.plans.run import run
from daymark.plans.slices import export_day
from daymark.plans.sync import SyncReport, fresh_days, sync_days, sync_two_hops
from daymark.session import scratch_dir
from daymark.showcase.registry import scratch_lake
from daymark.sinks.files import write_csv
from daymark.sinks.tables import append, append_by_day, create_as, create_like, put_days, replace
from daymark.sources.tables import Lake


def dated(spark, *pairs):
    return spark.createDataFrame([(a, d and day(d)) for a, d in pairs], "a int, DATE date")


def test_held_days_are_skipped_whole(spark, lake):
    target = lake.table("silver", "t")
    sync_days(dated(spark, (1, "2024-01-01")), target)
    source = dated(spark, (1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-02"), (4, None))
    report = sync_days(source, target)
    assert report == SyncReport(target.identifier, days=1, rows=1, null_day_rows=1)
    assert [r[0] for r in rows(target.read())] == [1, 3]
    again = sync_days(source, target)
    assert (again.days, again.rows, again.null_day_rows) == (0, 0, 1)
    assert [r[0] for r in rows(target.read())] == [1, 3]


def test_empty_source_and_all_null_days_write_nothing(spark, lake):
    target = lake.table("silver", "t")
    assert sync_days(dated(spark), target).days == 0
    assert sync_days(dated(spark, (1, None)), target).null_day_rows == 1
    assert not target.exists()


def test_an_overwritten_table_keeps_its_days(spark, lake):
    target = lake.table("silver", "t")
    replace(target, dated(spark, (1, "2024-01-01"), (2, "2024-01-02")), ["DATE"])
    assert target.overwrite_mode() == "dynamic"
    assert sync_days(dated(spark, (3, "2024-01-03")), target).rows == 1
    assert [r[0] for r in rows(target.read())] == [1, 2, 3]
    replace(target, dated(spark, (4, "2024-01-04")), ["DATE"])
    assert [r[0] for r in rows(target.read())] == [4]


def test_a_static_table_is_refused_and_a_plain_one_keeps_its_days(spark, lake):
    for name, options in (("plain", ""), ("static", "OPTIONS (partitionOverwriteMode 'static')")):
        target = lake.table("silver", name)
        spark.sql(
            f"CREATE TABLE {target.identifier} (i INT, DATE DATE) USING parquet {options} "
            f"PARTITIONED BY (DATE) LOCATION '{target.location}'"
        )
        append(target, spark.sql("SELECT 1 AS i, DATE'2024-01-01' AS DATE"))
        new = spark.sql("SELECT 2 AS i, DATE'2024-01-02' AS DATE")
        if options:
            with pytest.raises(ValueError):
                sync_days(new, target)
        else:
            sync_days(new, target)
        assert [r[0] for r in rows(target.read())] == ([1] if options else [1, 2])


def test_every_dated_row_is_copied(spark, lake):
    target = lake.table("silver", "t")
    source = dated(spark, *[(i, f"2024-01-{1 + i % 9:02}") for i in range(40)], (99, None))
    report = sync_days(source, target)
    assert (report.days, report.rows, report.null_day_rows) == (9, 40, 1)
    assert rows(target.read()) == rows(source.where("DATE IS NOT NULL"))


def test_only_the_days_asked_for(spark, lake):
    target = lake.table("silver", "t")
    source = dated(spark, (1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03"))
    sync_days(source, target, only=[day("2024-01-02"), day("2024-02-01")])
    assert [r[0] for r in rows(target.read())] == [2]
    assert sync_days(source, target, only=[]).days == 0


def test_text_days_in_any_case(spark, lake):
    target = lake.table("silver", "t")
    append_by_day(target, dated(spark, (1, "2024-01-01")))
    source = spark.createDataFrame(
        [("2024-01-01", 5), ("2024-01-02", 6), ("x", 7), ("", 8)], "Date string, a int"
    )
    report = sync_days(source, target)
    assert (report.days, report.null_day_rows) == (1, 2)
    assert [r[0] for r in rows(target.read())] == [1, 6]


def test_a_target_with_another_layout_is_appended_to(spark, lake):
    target = create_as(lake.table("silver", "t"), dated(spark, (1, "2024-01-01")))
    sync_days(dated(spark, (5, "2024-01-01"), (2, "2024-01-02")), target)
    assert [r[0] for r in rows(target.read())] == [1, 2]


def test_a_target_of_an_earlier_session_is_not_overwritten(spark, lake):
    target = lake.table("silver", "t")
    sync_days(dated(spark, (1, "2024-01-01")), target)
    spark.sql(f"DROP TABLE {target.identifier}")
    sync_days(dated(spark, (9, "2024-01-01"), (2, "2024-01-02")), target)
    assert [r[0] for r in rows(target.read())] == [1, 2]


def test_two_hops_and_their_switches(spark, lake):
    local, mart = lake.table("silver", "t"), lake.table("gold", "t")
    source = dated(spark, (1, "2024-01-01"), (2, "2024-01-02"))
    none = sync_two_hops(source, local, mart, write_local=False)
    assert none.local is None and none.mart is None and not mart.exists()
    first = sync_two_hops(source, local, mart, write_mart=False)
    assert first.local.days == 2 and first.mart is None
    append_by_day(mart, dated(spark, (7, "2024-01-01")))
    second = sync_two_hops(source, local, mart)
    assert second.local.days == 0 and second.mart.days == 1
    assert [r[0] for r in rows(mart.read())] == [2, 7]


def test_copy_between_day_tables_prunes_and_does_not_shuffle(spark, lake):
    source = lake.table("silver", "t")
    append_by_day(source, dated(spark, *[(i, f"2024-01-{i:02}") for i in range(1, 13)]))
    wanted = [day(f"2024-01-{i:02}") for i in range(1, 12)]
    text = plan(source.read().where(in_days("DATE", wanted)))
    assert "PartitionFilters: [isnotnull(DATE" in text and "INSET" in text
    assert "Exchange" not in text and "Filter (" not in text


def test_days_of_day_tables_come_from_the_catalog(spark, lake):
    source, target = lake.table("silver", "t"), lake.table("gold", "t")
    append_by_day(source, dated(spark, (1, "2024-01-01"), (2, "2024-01-02"), (3, None)))
    append_by_day(target, dated(spark, (1, "2024-01-01")))
    fresh = fresh_days(source, target)
    assert "FileScan" not in plan(fresh) and "Scan parquet" not in plan(fresh)
    assert {r["DATE"] for r in fresh.collect()} == {None, day("2024-01-02")}
    assert sync_days(source, target) == SyncReport(target.identifier, 1, 1, 1)
    assert sync_days(source, target) == SyncReport(target.identifier, 0, 0, 1)
    assert lake.table("silver", "t").listed_days("a") is None
    plain = create_as(lake.table("gold", "plain"), dated(spark, (1, "2024-01-01")))
    assert plain.listed_days("DATE") is None and plain.partition_columns() == []


def test_days_kept_as_text_partitions(spark, lake):
    texts = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "n/a")], "a int, date string")
    source = create_as(lake.table("bronze", "t"), texts, ["date"])
    target = lake.table("silver", "t")
    assert sync_days(source, target) == SyncReport(target.identifier, 2, 2, 1)
    assert [r[0] for r in rows(target.read())] == [1, 2]


def jobs_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_days(spark, lake):
    def source(days):
        return spark.range(200).select(
            "id", F.date_add(F.lit(day("2024-01-01")), (F.col("id") % days).cast("int")).alias("DATE")
        )

    few = jobs_of(spark, "few", lambda: sync_days(source(3), lake.table("silver", "few")))
    many = jobs_of(spark, "many", lambda: sync_days(source(30), lake.table("silver", "many")))
    assert many <= few + 2


def test_many_days_are_written_by_many_tasks_and_hot_days_split(spark, lake, monkeypatch):
    """Half of all rows on the first of 200 days."""
    monkeypatch.setattr("daymark.sinks.tables.ROWS_PER_TASK", 5_000)
    source = spark.range(40_000).select(
        "id",
        F.create_map(F.lit("id"), "id").alias("props"),  # a type that has no hash
        F.date_add(
            F.lit(day("2024-01-01")),
            F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 200).cast("int"),
        ).alias("DATE"),
    )
    counts = {r["DATE"]: r["count"] for r in source.groupBy("DATE").count().collect()}
    target = create_like(lake.table("silver", "dealt"), source, ["DATE"])
    assert put_days(target, source, counts=counts).rows == 40_000
    assert rows(target.read().select("id", "DATE")) == rows(source.select("id", "DATE"))
    assert len(files_of(target, "2024-01-01")) >= 3 and len(files_of(target, "2024-01-02")) == 1
    tasks = target.read().select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).distinct()
    assert tasks.count() >= 5


def files_of(table, date):
    files = table.read().where(F.col("DATE") == F.lit(day(date))).select("_metadata.file_path").distinct()
    return [r[0] for r in files.collect()]


def test_days_nobody_counted_are_spread_too(spark, lake, monkeypatch):
    """Half of all rows on the first of 200 days, in a frame that counts as small and as large."""
    source = spark.range(200_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
        F.date_add(
            F.lit(day("2024-01-01")),
            F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 200).cast("int"),
        ).alias("DATE"),
    )
    small = lake.table("silver", "small")
    assert sync_days(source, small).rows == 200_000
    parts = small.read().select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)).distinct()
    assert parts.count() >= 8 and len(files_of(small, "2024-01-02")) == 1
    monkeypatch.setattr("daymark.sinks.tables.SMALL", 0)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, "1m")
    try:
        large = lake.table("silver", "large")
        assert sync_days(source, large).rows == 200_000
    finally:
        spark.conf.unset(name)
    # A small day may lie in a part that was cut for the hot one's sake.
    assert len(files_of(large, "2024-01-01")) >= 3 and len(files_of(large, "2024-01-02")) <= 2
    assert rows(large.read()) == rows(source)


days_and_nulls = st.lists(
    st.tuples(st.integers(0, 99), st.sampled_from([None, *(f"2024-01-{d:02}" for d in range(1, 6))])),
    max_size=12,
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(before=days_and_nulls, source=days_and_nulls)
def test_sync_properties(spark, before, source):
    target = scratch_lake(spark).table("silver", "t")
    create_like(target, dated(spark), ["DATE"])
    held = [(a, d) for a, d in before if d]
    if held:
        append(target, dated(spark, *held))
    held_days = {d for _, d in held}
    expected = held + [(a, d) for a, d in source if d and d not in held_days]
    expected = sorted((a, day(d)) for a, d in expected)
    for _ in range(2):
        sync_days(dated(spark, *source), target)
        assert rows(target.read()) == expected


@pytest.mark.parametrize("cluster", [True, False])
def test_a_lost_task_leaves_no_double_rows(spark, lake, cluster):
    def failing_once(batches):
        """Let some of a task's rows through, then lose the first attempt."""
        from pyspark import TaskContext

        for number, batch in enumerate(batches):
            if number == 1 and TaskContext.get().attemptNumber() == 0:
                raise RuntimeError("lost on purpose")
            yield batch

    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        base = spark.range(0, 400, 1, 2).select(
            F.col("id").cast("int").alias("a"),
            F.date_add(F.lit(day("2024-01-01")), (F.col("id") % 4).cast("int")).alias("DATE"),
        )
        shaky = base.mapInPandas(failing_once, base.schema)
        target = create_like(lake.table("silver", "t"), base, ["DATE"])
        put_days(target, shaky, cluster=cluster)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    assert rows(target.read()) == rows(base)


def test_a_failed_sync_leaves_no_half_days_and_can_be_run_again(spark, lake):
    target = lake.table("silver", "t")
    sync_days(dated(spark, (0, "2024-01-01")), target)
    good = spark.range(0, 300, 1, 3).select(
        F.col("id").cast("int").alias("a"),
        F.date_add(F.lit(day("2024-01-01")), (F.col("id") % 3).cast("int")).alias("DATE"),
    )
    failing = F.when(F.col("a") == 298, F.raise_error(F.lit("bad row"))).otherwise(F.col("a"))
    bad = good.select(failing.cast("int").alias("a"), "DATE")
    with pytest.raises(Exception, match="bad row"):
        sync_days(bad, target)
    assert rows(target.read()) == [(0, day("2024-01-01"))]
    assert sync_days(good, target).days == 2
    assert target.read().count() == 201


def test_csv_ingests(spark, lake):
    path = scratch_dir(spark, "csv")
    texts = [("1", "2024-01-01"), ("2", "2024-01-02"), ("3", "n/a")]
    write_csv(spark.createDataFrame(texts, "a string, date string"), path)
    target = lake.table("bronze", "t")
    report = ingest_new_days(spark, path, target)
    assert (report.days, report.rows, report.null_day_rows) == (2, 2, 1)
    assert target.read().dtypes == [("a", "string"), ("DATE", "date")]
    assert ingest_new_days(spark, path, target).days == 0
    whole = lake.table("bronze", "whole")
    ingest_all(spark, path, whole)
    ingest_all(spark, path, whole)
    assert whole.read().count() == 6  # no check: twice is double, the NULL day included


def test_export_of_an_empty_day(spark):
    df = dated(spark, (1, "2024-01-01"))
    for kind in ("csv", "parquet"):
        out = export_day(df, day("2024-01-05"), scratch_dir(spark, "out"), kind)
        assert out.count() == 0 and out.dtypes == df.dtypes


def test_snapshots_restore_the_newest_complete_one(spark, lake):
    root = scratch_dir(spark, "snap")
    table = lake.table("gold", "t")
    df = dated(spark, (1, "2024-01-01"), (2, "2024-01-02"))
    append(create_like(table, df, ["DATE"]), df)
    create_as(lake.table("silver", "plain"), spark.range(4))
    both = [("gold", "t"), ("silver", "plain")]
    snapshots.publish(lake, both, root, day("2024-02-01"))
    append(table, dated(spark, (3, "2024-01-03")))
    snapshots.publish(lake, both, root, day("2024-02-02"))
    snapshots.publish(lake, both, root, day("2024-02-02"))
    # A publish that broke off before its manifest rows.
    df.write.parquet(f"{root}/data/gold/t/broken")

    entries = {(r["layer"], r["table"]): r["rows"] for r in snapshots.newest(spark, root).collect()}
    assert entries == {("gold", "t"): 3, ("silver", "plain"): 4}
    # A row for each day of t and one for plain, in each of the three publishes.
    assert snapshots.manifest(spark, root).count() == (2 + 1) + (3 + 1) + (3 + 1)

    other = Lake(spark, scratch_dir(spark, "other"), prefix=f"{lake.prefix}o_").create_layers()
    restored = snapshots.restore(other, root)
    assert {t.name for t in restored} == {"t", "plain"}
    assert rows(other.table("gold", "t").read()) == rows(table.read())
    assert other.table("gold", "t").partition_columns() == ["DATE"]
    assert snapshots.restore(other, root) == []
    assert snapshots.restore(other, f"{root}/none") == []
    assert rows(snapshots.read_newest(spark, root, "gold", "t")) == rows(table.read())
    with pytest.raises(LookupError, match="gold.none"):
        snapshots.read_newest(spark, root, "gold", "none")

    # Publishing the newest day again and failing half-way leaves what was published before.
    with pytest.raises(Exception, match="absent"):
        snapshots.publish(lake, [*both, ("gold", "absent")], root, day("2024-02-02"))
    assert {r["rows"] for r in snapshots.newest(spark, root).collect()} == {3, 4}


def test_a_broken_restore_is_done_again(spark, lake):
    root = scratch_dir(spark, "snap")
    create_as(lake.table("gold", "t"), dated(spark, (1, "2024-01-01")), ["DATE"])
    snapshots.publish(lake, [("gold", "t")], root, day("2024-02-01"))
    other = Lake(spark, scratch_dir(spark, "other"), prefix=f"{lake.prefix}o_").create_layers()
    table = other.table("gold", "t")
    # What a restore leaves that dies while writing, and an aborted job in its place.
    dated(spark, (7, "2024-01-07")).write.partitionBy("DATE").parquet(f"{table.location}.restoring")
    spark.range(1).write.parquet(f"{table.location}/_temporary/0")
    assert not table.exists()
    snapshots.restore(other, root)
    assert rows(table.read()) == [(1, day("2024-01-01"))]
    assert table.listed_days("DATE").count() == 1


def test_run_syncs_publishes_and_restores(spark, lake):
    root = scratch_dir(spark, "snap")
    sources = {
        "a": dated(spark, (1, "2024-01-01")),
        "b": dated(spark, (1, "2024-01-01"), (2, "2024-01-02")),
    }
    reports = run(lake, sources, publish_to=root, today=day("2024-03-01"))
    assert {n: (r.local.days, r.mart.days) for n, r in reports.items()} == {"a": (1, 1), "b": (2, 2)}
    other = Lake(spark, scratch_dir(spark, "other"), prefix=f"{lake.prefix}o_")
    reports = run(other, sources, restore_from=root)
    assert all(r.local.days == 0 and r.mart.days == 0 for r in reports.values())
    with pytest.raises(ValueError, match="day to publish"):
        run(lake, sources, publish_to=root)


def test_a_failing_table_fails_the_run_after_the_others(spark, lake):
    root = scratch_dir(spark, "snap")
    sources = {"bad": spark.range(1), "good": dated(spark, (1, "2024-01-01"))}
    with pytest.raises(ValueError, match="one DATE column"):
        run(lake, sources, publish_to=root, today=day("2024-03-01"))
    assert lake.table("gold", "good").read().count() == 1
    assert files_under(root, ".parquet") == []
