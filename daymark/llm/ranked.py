"""Numbering rows in a global order without bringing them together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in that order.

    They are range-partitioned, sorted in their partitions and written; only the number of rows
    of each partition reaches the driver.  With a column of distinct values at the end of
    ``order`` a value that many rows share is split over several partitions.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    # The row's number in its task, written with it, so it holds whatever runs again.
    place = F.monotonically_increasing_id()
    dealt = dealt.select(
        "*",
        F.shiftright(place, 33).cast("int").alias("part"),
        place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
    )
    dealt = materialised(dealt, "ranked")
    sizes = dict(dealt.groupBy("part").count().collect())
    before = np.cumsum([0, *(sizes.get(k, 0) for k in range(max(sizes, default=0)))]).tolist()
    start = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col("part") + 1)
    return dealt.withColumn("rank", start + F.col("place") + 1).drop("part", "place")
