import hashlib
import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from daymark.llm import common, near
from daymark.llm.exact import exact_groups, without_copies
from daymark.llm.fingerprints import edited, fingerprints, likeness, merged, read, sketches
from daymark.llm.near import near_components, tree_pairs, without_near_copies
from oracle import compare, connect
from pyspark.sql import functions as F


def words(rng, n, vocabulary=500):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


ODD = [
    (None, "a b c d e f"),
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "a b  c d e f"),
    (5, "A b c d e f"),
    (5, "A b c d e f"),
    (6, "one"),
    (7, "One"),
    (8, "x " * 30_000),
    (9, "x " * 30_000 + "y"),
    (10, "ä ö ü é ß"),
]


def test_exact_dedup_equals_sql(spark, sf_dir):
    import __spark_entry__ as contract

    with connect(sf_dir) as con:
        df = contract.queries()["op3_exact_dedup"](spark, sf_dir)
        assert compare(df, con, contract.oracle_sql()["op3_exact_dedup"]) == ""


def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        body = brute.re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
        groups.setdefault(body, []).append(i)
    out = []
    for body, ids in groups.items():
        keep = min(ids, key=lambda i: (i is not None, i or 0))
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [F.md5, lambda c: F.substring(F.md5(c), 1, 1)], ids=["md5", "colliding"])
def test_exact_dedup_odd_rows_and_collisions(frame, digest):
    rows = ODD + [(100 + i, f"text {i % 20}") for i in range(60)]
    found = sorted((tuple(r) for r in exact_groups(frame(rows), digest=digest).collect()), key=str)
    assert found == exact_by_hand(rows)


def test_without_copies_leaves_one_of_each(frame):
    left = without_copies(frame(ODD))
    assert left.columns == frame(ODD).columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([None, 1, 3, 5, 6, 7, 8, 9, 10], key=str)


def test_empty_tables(frame):
    empty = frame([]).limit(0)
    assert exact_groups(empty).count() == 0
    assert near_components(empty).count() == 0
    assert fingerprints(empty).count() == 0


def test_near_components_equal_brute_force(spark, sf_dir):
    import __spark_entry__ as contract

    df = contract.queries()["op9_ngram_jaccard_join"](spark, sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute.components(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert found == {i: (len(brute.shingles(t)), expected[i]) for i, t in rows}


def test_near_components_of_a_large_group(frame, monkeypatch):
    """Copies of one text that mostly link to it and not to one another, and a text that all quote."""
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = random.Random(5)
    base, passage = words(rng, 120, 5000), words(rng, 40, 5000)
    rows = [(500, " ".join(base))]
    for i in range(120):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(len(copy))] = f"new{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(words(rng, rng.randrange(5, 60)) + passage)) for i in range(80)]
    rows += [(2000 + i, " ".join(passage[: 38 + i % 3] + [f"end{i}"] * 6)) for i in range(60)]
    rows += ODD[1:6] + ODD[7:]
    expected = brute.components(rows)
    found = {r.doc_id: r.component_id for r in near_components(frame(rows)).collect()}
    assert found == expected


def test_near_odd_rows(frame):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in near_components(frame(ODD)).collect()}
    # Null text and texts without words link with nothing; the null id is the smallest.
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, None), (5, 2, None), (None, 2, None)} <= found
    assert {(6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 2, 9), (10, 1, 10)} <= found
    assert sorted(r.doc_id for r in without_near_copies(frame(ODD[1:])).collect()) == [1, 2, 3, 4, 6, 8, 9, 10]


def test_texts_under_one_id_stand_together(frame):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "p q r s t u v"), (3, "p q r s t u v"), (4, "z")]
    found = {r.doc_id: r.component_id for r in near_components(frame(rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}


def peak_of(job, batch):
    """The most bytes that a task's job held at once, and its rows."""
    tracemalloc.start()
    rows = [r for b in job(iter([batch])) for r in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, rows


def test_pairs_of_points_take_bounded_memory():
    rng = np.random.default_rng(4)
    points = rng.poisson(1, (6000, near.GROUPS)).astype("<u4")
    n, node = points.sum(1).astype(np.int64), np.arange(6000)
    cells = pa.array([p.tobytes() for p in points], pa.binary())
    lists = pa.RecordBatch.from_pydict(
        {"key": node // 12, "i": node * 0, "j": node * 0, "node": node, "component": node, "n": n, "point": cells}
    )
    most, found = peak_of(near._tree_join, lists)
    a, b = np.triu_indices(12, 1)
    a, b = ((np.arange(0, 6000, 12)[:, None] + x).ravel() for x in (a, b))
    fits = np.minimum(points[a], points[b]).sum(1) >= near.needed(n[a], n[b])
    assert sorted((r["a"], r["b"]) for r in found) == sorted(zip(a[fits].tolist(), b[fits].tolist()))
    assert most < 30_000_000

    star = {"a": node, "b": node[::-1], "n_a": n, "point_a": cells, "n_b": n[::-1], "point_b": cells.take(pa.array(node[::-1]))}
    most, found = peak_of(near._within_bound, pa.RecordBatch.from_pydict(star).slice(17))
    fits = np.minimum(points, points[::-1]).sum(1) >= near.needed(n, n[::-1])
    assert [r["a"] for r in found] == node[17:][fits[17:]].tolist()
    assert most < 18_000_000


def test_tallies_count_every_shingle(monkeypatch):
    monkeypatch.setattr(near, "TALLY", 1 << 20, raising=False)
    texts = [" ".join(f"w{(i * 7919 + k * k) % 50_021}" for k in range(1000)) for i in range(1300)]
    most, found = peak_of(near._tallies(8), pa.RecordBatch.from_pydict({"text": texts}))
    counts = {}
    for r in found:
        for item, n in zip(np.frombuffer(r["items"], "<u4").tolist(), np.frombuffer(r["counts"], "<u4").tolist()):
            assert item * 8 >> 32 == r["part"]
            counts[item] = counts.get(item, 0) + n
    hashes = (near.shingle_sets(pa.array(texts))[0] >> np.uint64(32)).astype(np.uint32)
    assert counts == dict(zip(*(x.tolist() for x in np.unique(hashes, return_counts=True))))


def test_near_tasks_drop_what_other_operators_kept(monkeypatch):
    from pyspark import cloudpickle  # as jobs travel to their workers

    monkeypatch.setattr(common, "_caches", [*common._caches])
    for job in (near._tallies(8), near._prefix_rows):
        other, own = common.worker_cache(), common.worker_cache("shingles")
        other["tokenizer"] = own[1] = [1]
        assert list(cloudpickle.loads(cloudpickle.dumps(job))(iter([]))) == []
        assert not other and own == {1: [1]}


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(3)
    base = rng.poisson(3, (40, near.GROUPS))
    points = np.abs(np.repeat(base, 20, 0) + rng.integers(-1, 2, (800, near.GROUPS)) * (rng.random((800, 1)) < 0.7))
    sizes, comp = points.sum(1), rng.integers(0, 5, 800)
    bound = np.minimum(points[:, None], points[None]).sum(-1)
    fits = bound >= near.needed(sizes[:, None], sizes[None])
    i, j = np.nonzero(np.triu(fits & (comp[:, None] != comp[None]), 1))
    found = tree_pairs(points.astype(np.uint32), sizes, comp)
    assert len(i) > 100 and sorted(map(tuple, found.tolist())) == sorted(zip(i.tolist(), j.tolist()))


def test_fingerprints_equal_brute_force(spark, sf_dir):
    import __spark_entry__ as contract

    df = contract.queries()["op2_fingerprints"](spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    found = {r.doc_id: r for r in df.collect()}
    assert len(found) == len(rows)
    errors, far = [], []
    for row, after in zip(rows, rows[1:] + rows[:1]):
        text, new = row.text or "", edited(row.text or "", after.text or "")
        n = len(text)
        assert new == text[: n - n // 4] + (after.text or "")[: n // 4]
        got = found[row.doc_id]
        assert (got.n_chars, got.edited_sha256) == (n, hashlib.sha256(new.encode()).hexdigest())
        a, b, c = map(brute.shingles, (text, new, after.text))
        errors.append(got.near_edited - (len(a & b) / len(a | b) if a | b else 1))
        far.append(got.near_next - (len(a & c) / len(a | c) if a | c else 1))
    assert np.abs(errors).mean() < 0.05 and np.abs(far).mean() < 0.02 and abs(np.mean(errors)) < 0.01
    same = {}
    for row in rows:
        assert same.setdefault(row.text or "", found[row.doc_id].fingerprint) == found[row.doc_id].fingerprint


def test_fingerprints_odd_rows_follow_one_another(frame):
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    found = fingerprints(frame(rows)).collect()
    texts = [t or "" for _, t in rows]
    expected = [
        (i, hashlib.sha256(edited(t, u).encode()).hexdigest())
        for (i, _), t, u in zip(rows, texts, texts[1:] + texts[:1])
    ]
    assert sorted(((r.doc_id, r.edited_sha256) for r in found), key=str) == sorted(expected, key=str)
    alone = fingerprints(frame([(3, "a b c d e f g h")])).first()
    assert alone.near_next == 1.0
    assert alone.edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest()


def test_sketches_merge_and_contain():
    rng = random.Random(2)
    small, large = words(rng, 1500, 10**6), words(rng, 30_000, 10**6)
    a, b, both = sketches([" ".join(small), " ".join(large), " ".join(large + small)])
    assert abs(likeness(a, both)[1] - 1) < 0.01 and likeness(a, b)[1] < 0.01
    joined = merged(a, b)
    assert joined.tolist() == both.tolist()
    from daymark.llm.fingerprints import written

    assert read(written(a)).tolist() == a.tolist()


def test_merging_is_exact_at_every_size():
    from daymark.llm.fingerprints import LEAST, SCALE, sketch_of

    rng = np.random.default_rng(3)
    sizes = [0, 1, 10, LEAST - 1, LEAST, LEAST + 1, 56, 130, 250, LEAST * SCALE, 3000]
    for m in sizes:
        for n in sizes:
            a, b = (np.unique(rng.integers(0, 2**64, k, np.uint64, endpoint=False)) for k in (m, n))
            b = np.unique(np.concatenate([b, a[::2]]))
            made = merged(sketch_of(a), sketch_of(b))
            assert made.tolist() == sketch_of(np.union1d(a, b)).tolist(), (m, n)


def test_containment_of_short_texts_in_long_ones_is_near_or_unknown():
    from daymark.llm.fingerprints import sketch_of

    rng = np.random.default_rng(4)
    for size in (5, 10, 20, 50, 200):
        known, whole, half = 0, [], []
        for _ in range(400):
            a = np.unique(rng.integers(0, 2**64, size, np.uint64, endpoint=False))
            rest = rng.integers(0, 2**64, 3000, np.uint64, endpoint=False)
            inside = likeness(sketch_of(a), sketch_of(np.union1d(a, rest)))[1]
            part = likeness(sketch_of(a), sketch_of(np.union1d(rng.permutation(a)[: size // 2], rest)))[1]
            known += inside is not None
            whole += [] if inside is None else [inside]
            half += [] if part is None else [part]
        assert set(whole) == {1.0}  # never told to be absent
        # Unknown as often as no hash of it falls below the fraction.
        assert abs(known / 400 - (1 - (7 / 8) ** size)) < 0.09
        assert abs(np.mean(half) - (size // 2) / size) < 0.07


def test_copies_go_where_ids_repeat_with_different_texts(frame):
    from daymark.llm.exact import without_copies

    rows = [(3, "B"), (5, "A"), (5, "B"), (None, "C"), (None, "D \n"), (7, "C"), (7, "D "), (7, "E"), (7, "E"), (8, None), (8, "A")]
    df = without_copies(frame(rows))
    assert df.schema == frame(rows).schema
    found = sorted((str(r.doc_id), r.text) for r in df.collect())
    assert found == sorted([("3", "B"), ("5", "A"), ("None", "C"), ("None", "D \n"), ("7", "E"), ("8", None)], key=lambda r: (r[0], str(r[1])))


def test_shared_digests_ids_and_nulls_are_told_apart(frame):
    """A digest that all rows share, ids that repeat, and null ids."""
    rows = [(2, "a"), (1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "d"), (4, "d"), (5, None), (6, " "), (7, "e")]
    expected = sorted(map(tuple, exact_groups(frame(rows)).collect()), key=str)
    for weak in (lambda body: F.lit("same"), lambda body: F.length(body).cast("string")):
        assert sorted(map(tuple, exact_groups(frame(rows), digest=weak).collect()), key=str) == expected
    keep = {(r[0], r[4][:8]): r[1:4] for r in expected}
    a, d, e = (hashlib.sha256(t).hexdigest()[:8] for t in (b"a", b"d", b"e"))
    assert keep[(2, a)] == (1, 2, False) and keep[(4, d)] == (None, 2, False) and keep[(7, e)] == (7, 1, True)


def test_many_shared_digests_are_not_sent_around(frame, monkeypatch):
    from daymark.llm import exact

    rows = [(i, f"text {i % 40}") for i in range(100)] + ODD
    expected = sorted(map(tuple, exact_groups(frame(rows)).collect()), key=str)
    monkeypatch.setattr(exact, "SENT", 0)
    assert sorted(map(tuple, exact_groups(frame(rows)).collect()), key=str) == expected
