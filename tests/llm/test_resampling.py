import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from daymark.llm import resampling
from daymark.llm.ranked import ranked
from daymark.llm.resampling import bracket, drawn, resampled
from oracle import compare, connect
from pyspark.sql import functions as F

ODD = [
    (None, "Words of no id " * 6),
    (1, None),
    (2, ""),
    (3, "-- \t ,.;"),
    (4, "ÉÈ é İ ß A1b2 \x00x\x7fy _z_ “q” 🙂"),
    (5, "same words " * 12),
    (5, "same words " * 12),
    (5, "other words " * 12),
    (6, "x" * 100 + " " + "y" * 33 + " " + "z" * 32 + " w" * 30),
    *[(i, f"word{i % 7} and more of it number {i} " * 4) for i in range(10, 40)],
]
TARGET = [(0, "more words and more of it"), (1, None), (2, "word3 word3 x")]


def features(text, order=1):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]


def expected(rows, target, order=1, buckets=10_000, percent=10):
    cell = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(cell(f) for _, t in rows for f in features(t, order)[1])
    t = Counter(cell(f) for _, x in target for f in features(x, order)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    result = []
    for i, text in rows:
        words, found = features(text, order)
        gains = [
            math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
            for b in map(cell, found)
        ]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        result.append([i, len(found), weight, score, None, len(words)])
    may = [r for r in result if r[5] >= 20]
    may.sort(key=lambda r: (-r[3], -(1 << 63) if r[0] is None else r[0], r[1], r[5]))
    for rank, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in result), key=str)


def outcome(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_equals_oracle(spark, sf_dir):
    import __spark_entry__ as contract

    with connect(sf_dir) as con:
        found = contract.queries()["op13_resampling"](spark, sf_dir)
        assert compare(found, con, contract.oracle_sql()["op13_resampling"]) == ""


@pytest.mark.parametrize("order", [1, 3])
def test_odd_rows(frame, order):
    scores = resampling.scored(frame(ODD), frame(TARGET), order=order, buckets=500)
    for percent in (0, 10, 50, 100):
        assert outcome(drawn(scores, percent)) == expected(ODD, TARGET, order, 500, percent)


def test_empty_tables(frame):
    nothing = frame([]).limit(0)
    assert resampled(nothing, frame(TARGET)).count() == 0
    assert outcome(resampled(frame(ODD), nothing)) == expected(ODD, [])


def test_ranks_are_dense_and_ordered(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("score")).repartition(7)
    found = ranked(rows, F.col("score").desc(), F.col("id")).collect()
    assert [(r["score"], r["id"]) for r in sorted(found, key=lambda r: r["rank"])] == sorted(
        ((i % 3, i) for i in range(5000)), key=lambda x: (-x[0], x[1])
    )
    assert sorted(r["rank"] for r in found) == list(range(1, 5001))


@pytest.mark.parametrize("wanted", [1, 37, 2500, 4999, 5000])
def test_the_bracket_holds_the_cutoff(spark, wanted, monkeypatch):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000 % 1700).alias("score"))
    ordered = sorted((r.score for r in rows.collect()), reverse=True)
    for accuracy, margin in ((10_000, 0.0005), (5, 0.0001)):  # the second sketch is far off
        monkeypatch.setattr(resampling, "ACCURACY", accuracy)
        monkeypatch.setattr(resampling, "MARGIN", margin)
        low, high, above = bracket(rows, wanted, 5000)
        assert (low is None or ordered[wanted - 1] >= low) and (high is None or ordered[wanted - 1] <= high)
        assert above == sum(1 for s in ordered if high is not None and s > high)


def test_all_scores_alike(spark):
    kinds = "doc_id long, n_features long, weight long, score long, words long"
    rows = spark.createDataFrame([(i % 60, 30, 0, 5, 30) for i in range(120)], kinds)
    found = [(r["rank"], r.doc_id) for r in drawn(rows, 50).collect() if r["rank"]]
    assert sorted(found) == [(k + 1, k // 2) for k in range(60)]


def test_crc_of_slices():
    data = bytes(range(256)) * 3
    raw = np.frombuffer(data, np.uint8)
    starts, lengths = np.array([0, 5, 9, 100, 300, 767]), np.array([1, 32, 33, 31, 400, 0])
    found = resampling.crc_on(np.zeros(6, np.uint32), raw, starts, lengths)
    assert found.tolist() == [zlib.crc32(data[s : s + n]) for s, n in zip(starts, lengths)]


def test_words_end_with_their_text():
    column = pa.array(["ab", None, "cd ef", "", "g"]).slice(0)
    _, starts, lengths, at = resampling.words_in(column)
    assert lengths.tolist() == [2, 2, 2, 1] and at.tolist() == [0, 1, 1, 3, 3, 4]
