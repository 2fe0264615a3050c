"""A training corpus from documents, in stages; each reads what the one before it wrote.

Toxic documents go, then all but one of equal texts, then all but one of near copies.  What
stays has its secrets replaced and is packed into windows of tokens.

In every stage a null text counts as empty, rows that repeat are judged each, and columns beyond
``doc_id`` and ``text``, whatever their names, are carried along but for the last stage.  Empty
``documents`` give an empty result; without ``labels`` nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daymark.llm import secrets, toxicity
from daymark.llm.common import table
from daymark.llm.exact import without_copies
from daymark.llm.near import without_near_copies
from daymark.llm.packing import pack, with_digest
from daymark.llm.queries import PREDICTED, toxicity_model
from daymark.session import materialised


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model of toxicity marks go; all others stay as they are, empty texts too."""
    return toxicity.without_toxic(docs, toxicity_model(spark, sf_dir), PREDICTED)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal text one stays, that of the smallest id; all empty texts are equal."""
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row of the smallest id stays; texts without words stay."""
    return without_near_copies(docs)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in their texts become ``[secret]``."""
    return secrets.without_secrets(docs, secrets.fit_on(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in windows of tokens; an empty text is its end mark alone."""
    return with_digest(pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", replace_secrets),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


# Trained scores, shingle sets and tokenizers have no SQL.
ORACLE_SQL = None
