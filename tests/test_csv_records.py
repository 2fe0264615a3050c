import csv
import io
import os
import random
from contextlib import contextmanager

import pytest
from helpers import plan
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.plans.ingest import bootstrap, ingest_all, ingest_new_days, stage
from daymark.session import scratch_dir
from daymark.sinks.files import write_csv
from daymark.sources import csvrecords
from daymark.sources.files import read_csv

SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@contextmanager
def ranges_of(spark, size):
    old = [spark.conf.get(name) for name in SIZES]
    for name, value in zip(SIZES, (size, 1)):
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in zip(SIZES, old):
            spark.conf.set(name, value)


def put(path, name, body):
    with open(os.path.join(path, name), "wb") as out:
        out.write(body)


def written(records, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(records)
    return out.getvalue().encode()


def random_records(seed, rows):
    draw = random.Random(seed)
    parts = ["a", "é", ",", '"', '""', "\n", "\r\n", "x" * 40, " ", "\n\n", '",', ',"', "ß日"]
    texts = ["z" + "".join(draw.choices(parts, k=draw.randrange(8))) + "z" for _ in range(rows)]
    return [(str(i), text, draw.choice(["k", "q,r"])) for i, text in enumerate(texts)]


@pytest.mark.parametrize("size", [37, 150, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_range_gives_the_same_records(spark, size, end):
    path = scratch_dir(spark, "csv")
    wanted = []
    for seed in range(2):
        records = random_records(seed, 25)
        put(path, f"{seed}.csv", written([("id", "text", "kind"), *records], end))
        wanted += records
    with ranges_of(spark, size):
        found = read_csv(spark, path, line_breaks=True)
        assert found.columns == ["id", "text", "kind"]
        assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_hand_made_oddities(spark):
    """Letters like quotes outside quoted fields, blank lines, a mark of byte order, a header
    over two lines, no line feed at the end, an empty field."""
    body = '﻿"i\nd",text\n\n1,5" pipe\n2,"x\ny"\r\n3,a"b"c\n\n4,"p""\n""q"\n5,""\n6,\n7,"end\n"'
    wanted = [("1", '5" pipe'), ("2", "x\ny"), ("3", 'a"b"c'), ("4", 'p"\n"q'), ("5", ""), ("6", None), ("7", "end\n")]
    path = scratch_dir(spark, "csv")
    put(path, "a.csv", body.encode())
    for size in (7, 1000):
        with ranges_of(spark, size):
            found = read_csv(spark, path, T.StructType().add("i", "string").add("t", "string"), line_breaks=True).collect()
            assert [tuple(r) for r in sorted(found)] == wanted, size


def test_a_record_longer_than_many_ranges(spark):
    path = scratch_dir(spark, "csv")
    long = "\n".join(f"line {i}, \"quoted\"" for i in range(120))
    records = [("1", "a"), ("2", long), ("3", "b\nc"), ("4", long), ("5", "d")]
    put(path, "a.csv", written([("id", "text"), *records]))
    with ranges_of(spark, 100):
        assert sorted(map(tuple, read_csv(spark, path, line_breaks=True).collect())) == records


def test_states_by_shuffle_are_the_same(spark):
    path = scratch_dir(spark, "csv")
    records = random_records(7, 60)
    put(path, "a.csv", written([("id", "text", "kind"), *records]))
    with ranges_of(spark, 64):
        sent = csvrecords.broken_records(spark, path)
        shuffled = csvrecords.broken_records(spark, path, most_sent=0)
        assert sorted(sent.collect()) == sorted(shuffled.collect())
        assert sent.count() == len(records)


def test_ranges_that_change_between_readings_are_noticed(spark, monkeypatch):
    path = scratch_dir(spark, "csv")
    records = random_records(8, 40)
    put(path, "a.csv", written([("id", "text", "kind"), *records]))
    sizes = iter([64, 81, 81, 81])
    real, count = csvrecords._starts, []

    def starts(summed):
        found = real(summed)
        count.append(found.count())
        spark.conf.set(SIZES[0], str(next(sizes)))
        return found

    monkeypatch.setattr(csvrecords, "_starts", starts)
    with ranges_of(spark, 50):
        found = read_csv(spark, path, line_breaks=True)
        assert sorted(map(tuple, found.collect())) == sorted(records)
        assert len(count) == 3
        with pytest.raises(RuntimeError, match="changed 1 times"):
            sizes = iter([77])
            csvrecords.broken_records(spark, path, tries=1)


def test_plain_files_are_read_as_before(spark):
    path = scratch_dir(spark, "csv")
    put(path, "a.csv", b'id,text\n1,a\n2,"b,c"\n')
    assert csvrecords.broken_records(spark, path) is None
    df = read_csv(spark, path, line_breaks=True)
    assert "FileScan csv" in plan(df, "simple") and len(df.collect()) == 2
    empty = scratch_dir(spark, "csv")
    put(empty, "a.csv", b"id,text\n")
    assert read_csv(spark, empty, line_breaks=True).collect() == []


def test_one_file_is_read_by_several_tasks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_dir(spark, "csv")
    write_csv(docs.coalesce(1), path)
    with ranges_of(spark, 20_000):
        lines = csvrecords._lines(spark, path)
        assert lines.rdd.getNumPartitions() > 4
        assert lines.select("file").distinct().count() == 1
        found = read_csv(spark, path, docs.schema, line_breaks=True)
        assert sorted(found.collect()) == sorted(docs.collect())


def test_exports_come_back_through_every_ingest(spark, lake, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string"), "text", F.expr("string(date_add(DATE'2024-01-01', int(doc_id % 5)))").alias("date")
    )
    path = f"{lake.root}/landing/docs.csv"
    write_csv(docs, path)
    wanted = sorted(r[:2] for r in docs.collect())

    def held(table):
        return sorted(tuple(r) for r in table.read().select("doc_id", "text").collect())

    assert sorted(tuple(r[:2]) for r in stage(lake, path).collect()) == wanted
    assert held(bootstrap(spark, path, lake.table("silver", "docs"))) == wanted
    target = lake.table("gold", "docs")
    report = ingest_new_days(spark, path, target)
    assert (report.days, report.rows, report.null_day_rows) == (5, len(wanted), 0)
    assert held(target) == wanted
    assert ingest_new_days(spark, path, target).rows == 0
    ingest_all(spark, path, target)
    assert held(target) == sorted(wanted * 2)
