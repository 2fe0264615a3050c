import brute
import corpus_pipeline
from daymark.llm.common import table


def test_stages_one_by_one(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "n-gram Jaccard join", "secret scans", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == columns
        rows, left = docs.collect(), {r.doc_id: r for r in after.collect()}
        if name == "exact dedup":
            first = {}
            for r in rows:
                body = brute.re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")
                first[body] = min(first.get(body, r.doc_id), r.doc_id)
            assert set(left) == set(first.values())
        if name == "n-gram Jaccard join":
            found = brute.components([(r.doc_id, r.text) for r in rows])
            assert set(left) == {i for i, c in found.items() if i == c}
        if name == "secret scans":
            assert set(left) == {r.doc_id for r in rows}
            changed = [r for r in rows if left[r.doc_id].text != r.text]
            assert all("[secret]" in left[r.doc_id].text for r in changed)
        docs = spark.createDataFrame(list(left.values()), docs.schema).coalesce(2)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(left)


def test_run(spark, sf_dir):
    import __spark_entry__ as contract

    df = contract.queries()["pipeline"](spark, sf_dir)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(df.columns)
    assert df.count() > 0


WORDS = [f"word{i}" for i in range(40)]
LONG = " ".join(WORDS[i % 37] + str(i) for i in range(6_000))
CLASHES = "doc_id long, text string, lang string, source string, n_chars long, stay string, label long, component_id long, " \
    "text_sha256 string, `order` long, place long, score double, node long"


def odd_tables(spark, folder, rows):
    full = [(i, t, None, "s", None if t is None else len(t), "x", 1, 2, "y", 3, 4, 0.5, 6) for i, t in rows]
    spark.createDataFrame(full, CLASHES).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")


def test_odd_rows_through_all_stages(spark, tmp_path):
    near = " ".join(WORDS)
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, near), (5, near.replace("word39", "other")), (6, near), (6, near),
        (7, LONG), (8, LONG + " end"), (9, "few words"), (10, "FEW words"), (11, "some new words\nfew words"),
        (12, "İ ß ﬁ"), (9, "few words"), (None, "a row without an id"),
    ]
    odd_tables(spark, tmp_path, rows)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Without labels no text is toxic; copies and near copies go as brute force says.
    first = {}
    for i, t in sorted(((r for r in rows if r[0] is not None)), key=lambda r: r[0]):
        first.setdefault(brute.re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), (i, t or ""))
    expected = {i for i, c in brute.components(list(first.values())).items() if i == c} | {None}
    assert {1, 3, 4, 7, 9, 11, 12} <= expected and not {2, 5, 6, 8, 10} & expected
    assert {r.doc_id for r in packed} == expected
    for i in expected:
        pieces = sorted((r.start, r.length) for r in packed if r.doc_id == i)
        ends = [0, *(s + n for s, n in pieces)]
        assert [s for s, _ in pieces] == ends[:-1]  # gapless
        assert ends[-1] == next(r.doc_tokens for r in packed if r.doc_id == i)


def test_no_rows_through_all_stages(spark, tmp_path):
    odd_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
