"""Exact duplicates: group by a 128-bit content hash, then compare bytes within each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .common import WHITE


SENT = 400_000  # shared digests of some 100 bytes each


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are the same bytes after every run of white space became one
    space.  Null text counts as empty.  Of equal texts the row with the smallest id stays; a
    null id sorts before any other.  Rows that repeat both id and text are all marked as kept
    (``without_copies`` leaves one of them).  Other columns of ``docs`` are not looked at.

    Rows meet by ``digest``; each is then compared, byte by byte, with the text of the group's
    first row.  Where a digest is shared by different texts, its rows are grouped anew by the
    text itself.  Only rows whose digest others share are compared, and only their texts are
    kept for it; up to ``SENT`` such digests go to every executor, so that no text is shuffled
    to find them.  Joins by digest have stored sides, which Spark can split.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    texts = texts.select("doc_id", "body", digest(F.col("body")).alias("digest"))
    first = F.min(F.struct(F.col("doc_id"))).alias("first")  # a struct, for nulls to sort first
    groups = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), first)
    several = materialised(groups.filter("size > 1"), "exact-groups")
    marked = texts.join(F.broadcast(several) if several.count() <= SENT else several, "digest", "left")
    shared = F.col("size").isNotNull()
    marked = marked.select(
        "doc_id", "digest", "size", "first", F.sha2("body", 256).alias("text_sha256"), F.when(shared, F.col("body")).alias("body")
    )
    marked = materialised(marked, "exact-marked")
    copies = marked.filter(shared)
    lead = copies.filter(F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select("digest", F.col("body").alias("lead"))
    lead = materialised(lead.dropDuplicates(["digest"]), "exact-leads")
    found = copies.join(lead, "digest").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        "text_sha256",
        "digest",
        F.lit(True).alias("compared"),
        (F.col("body") == F.col("lead")).alias("same"),
    )
    alone = marked.filter(~shared).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256", "digest",
        F.lit(False).alias("compared"), F.lit(True).alias("same"),
    )
    found = found.unionAll(alone)
    found = materialised(found, "exact-rows")
    mixed = found.filter("compared AND NOT coalesce(same, false)").select("digest").distinct()
    if not mixed.isEmpty():
        again = texts.join(mixed, "digest")
        parts = again.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("group_size"), first)
        parts = again.join(parts, ["digest", "body"]).select(
            "doc_id",
            F.col("first.doc_id").alias("keep_id"),
            "group_size",
            F.sha2("body", 256).alias("text_sha256"),
        )
        found = found.join(mixed, "digest", "left_anti").select(parts.columns).unionAll(parts)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return found.select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text no row of a smaller id has.

    Rows are told by id and text, as ids may repeat with different texts.
    """
    stay = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("stay"), F.col("text_sha256").alias("stay_sha256"))
    once = stay.distinct()
    same = F.sha2(normalised(docs["text"]), 256) == once["stay_sha256"]
    kept = docs.join(once, same & docs["doc_id"].eqNullSafe(once["stay"]), "left_semi")
    if stay.groupBy("stay", "stay_sha256").count().filter("count > 1").isEmpty():
        return kept
    # One row of each id and text.
    again = kept.withColumn("__body", normalised(F.col("text")))
    return again.dropDuplicates(["doc_id", "__body"]).drop("__body")
