"""Counts per owner, totals, and newest rows.  All combine on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_all(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def count_by(df: DataFrame, owner: str, name: str) -> DataFrame:
    """Rows per owner.  Partial counts leave one row per owner and task, so an
    owner with a third of all rows costs the shuffle no more than any other."""
    return df.groupBy(owner).agg(F.count(F.lit(1)).alias(name))


def count_by_sorted(df: DataFrame, owner: str, name: str) -> DataFrame:
    return count_by(df, owner, name).orderBy(F.col(name).desc())


def latest_by(df: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    """Per key, ``value`` of the row with the greatest ``order``; of several, the greatest value."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(name))
