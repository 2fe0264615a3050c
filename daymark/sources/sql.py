"""SQL text to a frame."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import upper_headers


def query(
    spark: SparkSession,
    text: str,
    args: Mapping[str, Any] | None = None,
    views: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Run SQL text and upper-case the headers.

    Values go in as ``:name`` parameters, never as text; ``views`` are frames to
    register as temp views under the given names first.
    """
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return upper_headers(spark.sql(text, args=dict(args or {})))
