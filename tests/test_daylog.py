import json

import pytest
from helpers import day, files_under, rows
from pyspark.sql import functions as F

from daymark.plans import snapshots
from daymark.plans.sync import sync_days
from daymark.session import LISTING, bounded_listing, scratch_dir
from daymark.sinks.tables import add_days, append, create_as, create_like, put_days, replace
from daymark.sources import daylog
from daymark.sources.tables import Lake


def dated(spark, *pairs):
    return spark.createDataFrame([(a, d and day(d)) for a, d in pairs], "a int, DATE date")


def forget(table):
    """What a later session with an empty catalog knows of a table."""
    table.spark.sql(f"DROP TABLE {table.identifier}")


def log_files(table):
    return files_under(f"{table.location}/{daylog.LOG}", ".json")


def test_later_sessions_replay_the_log(spark, lake):
    target = lake.table("silver", "t")
    sync_days(dated(spark, (1, "2024-01-01"), (2, "2024-01-02")), target)
    sync_days(dated(spark, (3, "2024-01-03"), (9, "2024-01-01")), target)
    put_days(target, dated(spark, (7, "2024-01-02")))
    append(target, dated(spark, (4, "2024-01-04"), (5, "2024-01-01")))  # a folder of its own, and one of a run
    expected = rows(target.read())
    assert [r[0] for r in expected] == [1, 3, 4, 5, 7]
    forget(target)
    assert target.exists() and rows(target.read()) == expected
    assert sync_days(dated(spark, (8, "2024-01-02")), target).days == 0


def test_a_run_without_its_entry_is_not_seen(spark, lake):
    target = lake.table("silver", "t")
    sync_days(dated(spark, (1, "2024-01-01")), target)
    dated(spark, (2, "2024-01-02")).write.partitionBy("DATE").parquet(daylog.run_folder(target.location))
    forget(target)
    assert target.exists() and [r[0] for r in rows(target.read())] == [1]
    with pytest.raises(OSError, match="not written"):
        daylog.written(spark, f"{target.location}/{daylog.RUNS}/none")


def test_a_failed_run_leaves_no_folder(spark, lake):
    target = create_like(lake.table("silver", "t"), dated(spark), ["DATE"])
    bad = dated(spark, (1, "2024-01-01")).select(F.raise_error(F.lit("bad row")).cast("int").alias("a"), "DATE")
    with pytest.raises(Exception, match="bad row"):
        put_days(target, bad)
    assert not files_under(target.location, ".parquet") and not log_files(target)


def test_entries_are_summed_up_and_moved_tables_read(spark, lake, monkeypatch):
    monkeypatch.setattr(daylog, "ENTRIES", 4)
    target = lake.table("silver", "t")
    for n in range(1, 8):
        sync_days(dated(spark, (n, f"2024-01-{n:02}")), target)
    put_days(target, dated(spark, (10, "2024-01-01")))
    whole = [p for p in log_files(target) if "covers" in json.loads(open(p).read())]
    assert whole and len(daylog._entries(spark, target.location)) < 5
    expected = [2, 3, 4, 5, 6, 7, 10]
    assert [r[0] for r in rows(target.read())] == expected
    moved = Lake(spark, scratch_dir(spark, "moved"), prefix=f"{lake.prefix}m_").create_layers().table("gold", "u")
    daylog.remove(spark, moved.location)
    daylog.renamed(spark, target.location, moved.location)
    assert moved.exists() and [r[0] for r in rows(moved.read())] == expected


def test_an_entry_that_came_beside_a_summary_still_counts(spark, lake):
    target = lake.table("silver", "t")
    sync_days(dated(spark, (1, "2024-01-01")), target)
    sync_days(dated(spark, (2, "2024-01-02")), target)
    first, second = (p.rsplit("/", 1)[1] for p in log_files(target))
    # The summary was made by who had seen the first entry only.
    runs = json.loads(open(log_files(target)[0]).read())["runs"]
    daylog._put(spark, target.location, {"runs": runs, "covers": [first]})
    assert set(daylog.logged(spark, target.location)) == {"2024-01-01", "2024-01-02"}


def test_the_source_is_read_once(spark, lake):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    base = dated(spark, *[(i, f"2024-01-{1 + i % 9:02}") for i in range(90)], (99, None), (98, None))
    target = lake.table("silver", "t")
    sync_days(dated(spark, (1, "2024-01-01")), target)
    report = sync_days(base.mapInPandas(counted, base.schema), target)
    assert (report.days, report.rows, report.null_day_rows) == (8, 80, 2)
    assert seen.value == 92


def test_no_file_of_the_copied_days_is_read_back(spark, lake):
    source, target = lake.table("silver", "t"), lake.table("gold", "t")
    sync_days(dated(spark, *[(i, f"2024-01-{1 + i % 9:02}") for i in range(90)]), source)
    group = "copy-days"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert sync_days(source, target).rows == 90
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in tasks if s) <= 4 * spark.sparkContext.defaultParallelism


def test_listing_is_bounded_by_cores(spark, lake):
    assert int(spark.conf.get(LISTING)) == 4 * spark.sparkContext.defaultParallelism
    spark.conf.set(LISTING, "7")
    try:
        bounded_listing(spark)
        assert spark.conf.get(LISTING) == "7"
    finally:
        spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))


def test_columns_are_matched_by_name(spark, lake):
    target = create_like(lake.table("silver", "t"), dated(spark), ["DATE"])
    put_days(target, spark.sql("SELECT DATE'2024-01-01' AS date, 5L AS A"))
    assert rows(target.read()) == [(5, day("2024-01-01"))]
    with pytest.raises(ValueError, match="has columns"):
        put_days(target, dated(spark).withColumn("more", F.lit(1)))


def test_days_of_a_table_laid_out_otherwise_are_appended(spark, lake):
    target = create_as(lake.table("silver", "t"), dated(spark, (1, "2024-01-01")))
    written = add_days(target, dated(spark, (2, "2024-01-02"), (3, None)))
    assert (written.days, written.rows, written.null_day_rows) == (("2024-01-02",), 1, 1)


def test_an_overwrite_forgets_the_log(spark, lake):
    target = lake.table("silver", "t")
    sync_days(dated(spark, (1, "2024-01-01")), target)
    replace(target, dated(spark, (2, "2024-01-02")), ["DATE"])
    forget(target)
    assert target.exists() and rows(target.read()) == [(2, day("2024-01-02"))]


def test_a_second_publish_copies_new_days_only(spark, lake):
    root, target = scratch_dir(spark, "snap"), lake.table("gold", "t")
    sync_days(dated(spark, (1, "2024-01-01"), (2, "2024-01-02")), target)
    snapshots.publish(lake, [("gold", "t")], root, day("2024-02-01"))
    before = set(files_under(f"{root}/data", ".parquet"))
    snapshots.publish(lake, [("gold", "t")], root, day("2024-02-02"))
    assert set(files_under(f"{root}/data", ".parquet")) == before
    sync_days(dated(spark, (3, "2024-01-03")), target)
    append(target, dated(spark, (4, "2024-01-02")))  # this day has one more file now
    snapshots.publish(lake, [("gold", "t")], root, day("2024-02-03"))
    new = set(files_under(f"{root}/data", ".parquet")) - before
    assert spark.read.parquet(*sorted(new)).count() == 3
    assert rows(snapshots.read_newest(spark, root, "gold", "t")) == rows(target.read())
    other = Lake(spark, scratch_dir(spark, "other"), prefix=f"{lake.prefix}o_").create_layers()
    snapshots.restore(other, root)
    assert rows(other.table("gold", "t").read()) == rows(target.read())


def test_publishes_of_one_day_do_not_hide_each_other(spark, lake):
    root = scratch_dir(spark, "snap")
    create_as(lake.table("gold", "a"), spark.range(3))
    create_as(lake.table("gold", "b"), dated(spark, (1, "2024-01-01"), (2, None)), ["DATE"])
    create_as(lake.table("silver", "old"), spark.range(0))
    snapshots.publish(lake, [("silver", "old")], root, day("2024-01-31"))
    snapshots.publish(lake, [("gold", "a")], root, day("2024-02-01"))
    snapshots.publish(lake, [("gold", "b")], root, day("2024-02-01"))
    other = Lake(spark, scratch_dir(spark, "other"), prefix=f"{lake.prefix}o_").create_layers()
    assert {t.name for t in snapshots.restore(other, root)} == {"a", "b", "old"}
    assert other.table("gold", "a").read().count() == 3 and other.table("silver", "old").read().count() == 0
    assert rows(other.table("gold", "b").read()) == rows(lake.table("gold", "b").read())


def test_a_rename_that_is_refused_raises(spark):
    folder = scratch_dir(spark, "names")
    with pytest.raises(Exception):
        daylog.renamed(spark, f"{folder}/absent", f"{folder}/b")
