import pytest
from helpers import day, plan, rows
from pyspark.sql import functions as F

from daymark.operators import counts
from daymark.operators.days import (
    days_held,
    has_rows_on,
    in_days,
    joined_on_days,
    known_days,
    listed,
    missing_days,
    on_day,
    rows_on_days,
)
from daymark.operators.names import unique_names
from daymark.plans.slices import day_slice
from daymark.plans.sync import sync_days
from daymark.sinks.tables import append_by_day


def frame(spark, *days):
    return spark.createDataFrame([(i, d and day(d)) for i, d in enumerate(days)], "a int, DATE date")


def test_day_algebra_and_nulls(spark):
    left = frame(spark, "2024-01-01", "2024-01-01", "2024-01-02", None)
    right = frame(spark, "2024-01-02", "2024-01-03")
    assert missing_days(left, right).count() == 2  # one day and the NULL
    assert missing_days(left, frame(spark, None)).count() == 2  # NULLs compare equal
    assert known_days(left, right).count() == 4
    held = {r["DATE"]: r["held"] for r in days_held(left, right).collect()}
    assert held == {day("2024-01-01"): False, day("2024-01-02"): True, None: False}


def test_rows_without_a_day_are_never_selected(spark):
    df = frame(spark, "2024-01-01", None, "2024-01-02")
    for select in (rows_on_days, joined_on_days):
        assert [r[0] for r in rows(select(df, missing_days(df, df.limit(0))))] == [0, 2]
        assert select(df, frame(spark, None)).count() == 0


def test_listed_days_are_sorted_and_dated(spark):
    days = frame(spark, "2024-01-03", None, "2024-01-01").select("DATE")
    assert listed(days) == [day("2024-01-01"), day("2024-01-03")]


def test_thirty_thousand_days_still_prune(spark, lake):
    """The plan of what a sync runs is the same for any number of days."""
    target = lake.table("silver", "t")
    sync_days(frame(spark, "2024-01-01", "2024-01-02", "2024-01-03"), target)
    every = spark.sql("SELECT explode(sequence(DATE'1970-01-01', DATE'2052-02-19')) AS DATE")
    assert every.count() == 30_000
    for wanted in (every, every.where("DATE BETWEEN '2024-01-01' AND '2024-01-03'")):
        found = rows_on_days(target.read(), wanted)
        text = plan(found)
        assert "Join" not in text and "PartitionFilters: [" in text and found.count() == 3
    text = plan(joined_on_days(target.read(), every.where("DATE < '2024-01-02'")))
    assert "dynamicpruning" in text


def test_a_day_of_text_and_of_any_spelling(spark):
    df = spark.createDataFrame([("2024-01-10", 1), ("2024-01-10T05:00", 2), ("2024-01-11", 3)], "Date string, i int")
    assert [r[1] for r in rows(on_day(df, day("2024-01-10")))] == [1, 2]


def test_in_no_days_is_false(spark):
    assert frame(spark, "2024-01-01").where(in_days("DATE", [])).count() == 0


def test_listed_days_select_without_join_or_shuffle(spark):
    df = frame(spark, "2024-01-01", "2024-01-02", "2024-01-03")
    text = plan(rows_on_days(df, frame(spark, "2024-01-02")))
    assert "Join" not in text and "Exchange" not in text


def test_on_day_reaches_the_scan(spark, lake, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = plan(on_day(orders, day("1996-01-02"), "o_orderdate").select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-02T00:00" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text

    target = lake.table("silver", "t")
    append_by_day(target, frame(spark, "2024-01-01", "2024-01-02"))
    text = plan(day_slice(target.read(), day("2024-01-02")))
    assert "PartitionFilters: [isnotnull(DATE" in text and "= 2024-01-02)]" in text


def test_on_day_with_timestamps_and_texts(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (TIMESTAMP'2024-01-01 23:59:59.999999'), (TIMESTAMP'2024-01-02 00:00:00'),
           (TIMESTAMP'2024-01-02 23:59:59.999999'), (TIMESTAMP'2024-01-03 00:00:00'), (NULL) AS t(ts)"""
    )
    assert on_day(df, day("2024-01-02"), "ts").count() == 2
    assert has_rows_on(df, day("2024-01-03"), "ts") and not has_rows_on(df, day("2024-01-04"), "ts")
    assert on_day(df.select(F.col("ts").cast("string").alias("ts")), day("2024-01-02"), "ts").count() == 2
    with pytest.raises(TypeError, match="not a date"):
        on_day(df.select(F.col("ts").cast("long").alias("ts")), day("2024-01-02"), "ts")


def test_counts_combine_before_the_shuffle(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = plan(counts.count_by(orders, "o_custkey", "n"))
    assert text.count("HashAggregate") >= 2 and "ReadSchema: struct<o_custkey:bigint>" in text
    ordered = [r["n"] for r in counts.count_by_sorted(orders, "o_custkey", "n").collect()]
    assert ordered == sorted(ordered, reverse=True)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = plan(counts.latest_by(events, "user_id", "event_id", "ts", "latest"))
    assert text.count("SortAggregate (") >= 2 and text.count("Exchange (") >= 1  # one on either side of the shuffle


def test_newest_of_several_is_the_greatest(spark):
    rows_ = [(1, 5, "b"), (1, 5, "c"), (1, 4, "z"), (1, 5, "a"), (2, 1, "x")]
    for order in (rows_, rows_[::-1]):
        df = spark.createDataFrame(order, "k int, t int, v string")
        assert rows(counts.latest_by(df, "k", "v", "t", "newest")) == [(1, "c"), (2, "x")]


def test_a_made_name_is_not_one_given_already(spark):
    names = [(1, "a"), (5, "a"), (7, "a-5"), (8, "a-5-5"), (9, "b"), (10, "a-5")]
    df = spark.createDataFrame(names, "id int, name string")
    out = {r["id"]: r["unique_name"] for r in unique_names(df, "name", "id").collect()}
    assert out == {1: "a", 5: "a-5-5-5", 7: "a-5", 8: "a-5-5", 9: "b", 10: "a-5-10"}


def test_names_become_unique(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, "a")], "id int, name string")
    out = {r["id"]: r["unique_name"] for r in unique_names(df, "name", "id").collect()}
    assert out == {1: "a", 3: "a-3", 5: "a-5", 2: "b", 4: None}


def test_few_names_do_not_shuffle_the_rows(spark):
    df = spark.range(10_000).select("id", (F.col("id") % 3).cast("string").alias("name"))
    text = plan(unique_names(df, "name", "id"), "simple")
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_any_keys_make_different_names(spark):
    keys = ["-5", "5", "b-1", "1", "~1", "~0", "~", "-", "--", "~-", "-~", "", "1-", "-1-1", "1-1"]
    rows = [(key, name) for key in keys for name in ("a", "a-", "b", "a-~15")]
    texts = spark.createDataFrame([(f"{k}{n}{i}", n) for i, (k, n) in enumerate(rows)], "id string, name string")
    made = [r["unique_name"] for r in unique_names(texts, "name", "id").collect()]
    assert len(set(made)) == len(rows)
    numbers = spark.createDataFrame([(-9, "a"), (-5, "a"), (5, "a-"), (1, "a-"), (7, "a")], "id int, name string")
    made = {r["id"]: r["unique_name"] for r in unique_names(numbers, "name", "id").collect()}
    assert made == {-9: "a", -5: "a-~15", 1: "a-", 5: "a--5", 7: "a-7"}
