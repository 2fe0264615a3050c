import base64
import hashlib

import pytest
from daymark.llm.warc import MAGIC, archived, read_archives, record, record_offsets, write_archives

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 40\r\n\r\n"
ODD = [
    (None, "u", "page without id"),
    (1, None, None),
    (2, "http://a", ""),
    (3, "http://a\r\nX: y", "same"),
    (4, "", "same"),
    (4, "", "same"),
    (5, "b", FAKE + "inside the payload " * 9 + FAKE),
    (6, "b", FAKE * 40),
    (7, "c", "WARC/1.1\r\n" * 500),
    (8, "c", "ä" * 70_000 + FAKE),
    (9, "c", FAKE + "inside the payload " * 9 + FAKE),
    (10, "d", "page without id"),
]


@pytest.fixture
def pages(spark):
    def make(rows):
        full = [(*r, "x", 1) for r in rows]
        return spark.createDataFrame(full, "page_id long, url string, html string, digest string, size long").repartition(3)

    return make


def by_hand(rows):
    first, out = {}, []
    order = lambda i: (i is not None, i or 0)
    for i, _, html in rows:
        data = (html or "").encode()
        first[data] = min(first.get(data, i), i, key=order)
    for i, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = first[data] != i
        out.append((i, len(data), digest, "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1000, 4 << 20])
def test_archives_round_trip_with_magic_in_payloads(pages, size):
    found = archived(pages(ODD), archive=60_000, size=size).collect()
    assert sorted(map(tuple, found), key=str) == by_hand(ODD)


def test_pages_table(spark, sf_dir):
    import __spark_entry__ as contract

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    found = contract.queries()["op5_warc"](spark, sf_dir).collect()
    assert sorted(map(tuple, found), key=str) == by_hand(rows)


def test_least_payload_of_a_revisit(pages):
    found = archived(pages(ODD), least=5).collect()
    assert {r.record_type for r in found if r.payload_bytes < 5} == {"response"}


def test_no_pages(pages):
    assert archived(pages([]).limit(0)).count() == 0


def test_a_broken_archive_is_an_error(spark, pages):
    folder, files = write_archives(pages([(1, "a", "text"), (2, "b", "more")]))
    name = files.first()["name"]
    path = "/" + folder.removeprefix("file:").lstrip("/") + "/" + name
    with open(path, "ab") as out:
        out.write(b"rest")
    longer = spark.createDataFrame([(name, files.first()["bytes"] + 4)], "name string, bytes long")
    with pytest.raises(ValueError):
        record_offsets(folder, longer).collect()


def test_records_are_warc(pages):
    data = record(7, "http://x", b"hello", "D" * 32, 5, None)
    head, _, block = data.partition(b"\r\n\r\n")
    assert head.startswith(MAGIC) and b"Content-Length: %d" % (len(block) - 4) in head and data.endswith(b"hello\r\n\r\n")
    folder, files = write_archives(pages(ODD))
    assert read_archives(folder, files).count() == len(ODD)


LONG = "http://x/?q=" + "ä/" * 100_000


@pytest.mark.parametrize("size", [1000, 150_000, 4 << 20])
def test_long_urls_are_written_whole(pages, size):
    rows = [(1, LONG + "1", "one"), (2, LONG + "2", "two"), (3, "data:," + "z" * 5000, "one"), (4, "u", FAKE + "in " * 9), *ODD[4:]]
    rows = [(i if i is None else i + 100 * (k > 3), *r) for k, (i, *r) in enumerate(rows)]
    folder, files = write_archives(pages(rows), archive=60_000)
    data = b""
    for r in files.collect():
        with open("/" + folder.removeprefix("file:").lstrip("/") + "/" + r["name"], "rb") as file:
            data += file.read()
    for url in (LONG + "1", LONG + "2", "data:," + "z" * 5000):
        assert b"\r\nWARC-Target-URI: " + url.encode() + b"\r\n" in data
    assert sorted(map(tuple, read_archives(folder, files, size).collect()), key=str) == by_hand(rows)


def test_first_lines_without_a_header_take_linear_time(pages):
    import time

    rows = [(1, "u", "WARC/1.1\r\n" * 300_000), (2, "u", ("WARC/1.1\r\n" * 9 + "Content-Length: 7\r\n") * 30_000)]
    begin = time.perf_counter()
    assert sorted(map(tuple, archived(pages(rows)).collect()), key=str) == by_hand(rows)
    assert time.perf_counter() - begin < 60


def test_payloads_that_share_digest_and_size_are_both_written(spark, pages):
    import pathlib

    from pyspark.sql import functions as F

    rows = [(1, "a", "one text"), (2, "b", "two text"), (3, "c", "one text")]
    folder, files = write_archives(pages(rows), digest=lambda payload: F.lit("00" * 20))
    names = [r["name"] for r in files.collect()]
    body = b"".join(pathlib.Path(folder.removeprefix("file:"), n).read_bytes() for n in names)
    assert body.count(b"WARC-Type: response") == 2 and body.count(b"WARC-Type: revisit") == 1
    assert body.count(b"one text") == 1 and body.count(b"two text") == 1


def test_a_second_attempt_replaces_no_file(spark, pages):
    """Tasks run again give other names; the archives a first attempt reported stay whole."""
    from pyspark.sql import functions as F

    from daymark.llm.warc import _in_base32, _written
    from daymark.llm.stored import shared_dir

    folder = shared_dir(spark, "warc-again")
    one = pages([(i, "u", f"text {i}") for i in range(50)]).select(
        "page_id", "url", F.col("html").cast("binary").alias("payload"), F.unhex(F.sha1("html")).alias("digest"),
        F.octet_length("html").alias("size"), F.lit(None).cast("long").alias("first"),
    )
    kinds = "page_id long, url string, payload binary, digest string, size long, first long"

    def attempt(df):
        return df.mapInArrow(_in_base32, kinds).mapInArrow(_written(folder, 4000), "name string, bytes long").collect()

    first = attempt(one)
    again = attempt(one.sortWithinPartitions(F.desc("page_id")))
    assert not {r["name"] for r in first} & {r["name"] for r in again}
    for made in (first, again):
        found = read_archives(folder, spark.createDataFrame(made, "name string, bytes long"))
        assert sorted(r["page_id"] for r in found.collect()) == list(range(50))
