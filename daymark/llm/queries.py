"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces, quality, secrets, toxicity
from .alignment import MEASURES, align
from .bestfit import digested, pack_best_fit
from .common import has_rest, table, training_rows
from .exact import exact_groups
from .fingerprints import fingerprints
from .near import near_components
from .packing import pack, with_digest
from .resampling import resampled
from .tokenfiles import token_files
from .warc import archived

PREDICTED = 0.7  # the score from which a label is predicted


def judged(scores: DataFrame, modulus: int, rest: int) -> DataFrame:
    return scores.select(
        "doc_id",
        has_rest("doc_id", modulus, rest).alias("held_out"),
        "score",
        (F.col("score") >= PREDICTED).cast("int").alias("predicted"),
    )


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.fit(training_rows(docs, labels, "toxic", ~has_rest("doc_id", 3, 1), toxicity.SAMPLE))


def op1_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(pack(table(spark, sf_dir, "documents")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM d
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir)), 3, 1)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.coded(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(training_rows(docs, labels, "quality", ~has_rest("doc_id", 4, 2), quality.SAMPLE))
    return judged(quality.score(docs, model), 4, 2)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit_on(docs))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents")).documents.select("doc_id", *MEASURES, "groups_sha256")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(pack_best_fit(table(spark, sf_dir, "documents")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


# crc32 byte by byte, of every distinct word.
OP13_SQL = r"""
WITH texts AS (
    SELECT doc_id, true AS raw, text FROM documents UNION ALL SELECT NULL, false, text FROM benchmark
),
found AS (
    SELECT doc_id, raw, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM texts
),
words AS (SELECT doc_id, raw, unnest(words) AS word FROM found),
bits AS (
    SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps
),
bucketed AS (
    SELECT word, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(0, octet_length(encode(word))),
            lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: xor(c // 256, steps[CAST(xor(c % 256, b) AS BIGINT) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM words), bits
),
counted AS (
    SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t
    FROM words JOIN bucketed USING (word) GROUP BY bucket
),
sums AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counted),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)
        / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain
    FROM counted, sums
),
weighed AS (
    SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
    FROM words JOIN bucketed USING (word) JOIN gains USING (bucket) WHERE raw GROUP BY doc_id
),
scored AS (
    SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT)
               + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM found LEFT JOIN weighed USING (doc_id) WHERE raw
),
placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank,
           10 * count(*) OVER () // 100 AS wanted
    FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= wanted THEN rank END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_pack_windows,
        op2_fingerprints,
        op3_exact_dedup,
        op4_toxicity,
        op5_warc,
        op6_sentencepiece,
        op7_token_files,
        op8_quality,
        op9_ngram_jaccard_join,
        op10_secrets,
        op11_alignment,
        op12_best_fit,
        op13_resampling,
    )
}
# The others need a tokenizer, a trained model, shingle sets or archives.
ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op13_resampling": OP13_SQL}
