import zlib

import numpy as np
import pytest
from daymark.llm import bestfit
from daymark.llm.bestfit import digested, pack_best_fit, placed
from daymark.llm.tokens import default_path
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

ODD = [
    (None, "no id"),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "Don't <|endoftext|> stop, é “q” 🙂"),
    (5, "same"),
    (5, "same"),
    (5, "another"),
    (6, "word " * 5000),
    (7, "^&" * 700),
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path(bestfit.FILE))


def best_fit_decreasing(lengths, window):
    """The number of sequences that the plain algorithm needs."""
    gaps, begun = [], 0
    for n in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - n)
        else:
            begun += 1
            gaps.append(window - n)
    return begun


def check(found, rows, tokenizer, window=1024):
    """Whole documents in order, whole sequences without gaps; the number of sequences."""
    wanted = sorted(
        (str(i), [zlib.crc32(np.array(ids[s:e], "<u4").tobytes()) for s, e in cuts(len(ids), window)], len(ids))
        for i, t in rows
        for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids + [2]]
    )
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(str(r.doc_id), []).append((r.piece, r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    expected = {}
    for i, crcs, n in wanted:
        parts = [(k, s, e - s, c) for k, ((s, e), c) in enumerate(zip(cuts(n, window), crcs))]
        expected.setdefault(i, []).extend(parts)
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in expected.items()}
    return len(sequences)


def cuts(n, window):
    rest = n % window
    at = ([0] if rest else []) + list(range(rest, n, window)) + [n]
    return list(zip(at[:-1], at[1:]))


def test_query_holds_every_id_once_and_is_tight(spark, sf_dir, tokenizer):
    import __spark_entry__ as contract

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    many = check(contract.queries()["op12_best_fit"](spark, sf_dir).collect(), rows, tokenizer)
    sizes = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    plain = sum(n // 1024 for n in sizes) + best_fit_decreasing([n % 1024 for n in sizes if n % 1024], 1024)
    assert many <= plain * 1.005 + 1


def test_odd_rows(frame, tokenizer):
    check(digested(pack_best_fit(frame(ODD))).collect(), ODD, tokenizer)
    assert pack_best_fit(frame([]).limit(0)).count() == 0


def test_a_third_are_empty(frame, tokenizer):
    rows = [(i, "" if i % 3 == 0 else "some words " * (i % 40)) for i in range(3000)]
    found = digested(pack_best_fit(frame(rows), window=64)).collect()
    many = check(found, rows, tokenizer, 64)
    total = sum(r.length for r in found)
    assert many <= -(-total // 64) * 1.02 + 1


def test_hot_sizes_are_numbered_in_buckets(frame, tokenizer, monkeypatch):
    monkeypatch.setattr(bestfit, "GROUP", 50)
    rows = [(i, "one two" if i % 2 else "word " * (i % 90)) for i in range(600)]
    check(digested(pack_best_fit(frame(rows), window=32)).collect(), rows, tokenizer, 32)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 99), min_size=1, max_size=120))
def test_rounds_place_every_unit(spark, lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    units = []
    for n, many in counts.items():
        step = max(1, 50 // n)
        units += [(n, first, min(step, many - first)) for first in range(0, many, step)]
    where, bins = placed(spark.createDataFrame(units, "ell int, first long, cnt int").coalesce(2), 100)
    held, texts = {}, []
    for r in where.collect():
        held.setdefault(r.bin, []).append((r.offset, r.ell * r.cnt))
        texts += [(r.ell, r.first + k) for k in range(r.cnt)]
    assert sorted(texts) == sorted((n, k) for n, many in counts.items() for k in range(many))
    assert sorted(held) == list(range(bins))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 100
    assert bins <= best_fit_decreasing(lengths, 100) * 1.1 + 1
