"""Making colliding names unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised


def _without_dashes(text: Column) -> Column:
    """The text in a form without ``-``; different texts have different ones."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("-"), F.lit("~1"))


def unique_names(df: DataFrame, name: str, key: str, out: str = "unique_name") -> DataFrame:
    """The first holder of a name (lowest key) keeps it, others get ``-key`` appended.

    ``key`` is unique per row.  First holders come from a partial aggregate of one
    row per name and task, and are matched back on the key, not on the name: a
    name held by a third of all rows never gathers in one place.  With few names
    their stored size lets Spark broadcast them, and ``df`` is not shuffled.

    A made name that some row has from the start gets ``-key`` once more, until no row has
    it.  In an appended key ``~`` stands as ``~0`` and ``-`` as ``~1``: so what follows the last
    ``-`` of a made name is its own key, whatever the keys are, and made names never meet.
    """
    holders = materialised(df.groupBy(name).agg(F.min(key).alias(key)), "first-holders")
    first = holders.select(key).withColumn("_first", F.lit(True))
    given = holders.select(F.col(name).alias("_made"))
    ending = F.concat(F.lit("-"), _without_dashes(F.col(key).cast("string")))
    others = df.join(first, key, "left_anti").select(key, F.concat(F.col(name), ending).alias("_made"))
    # Per key how often it is appended; most have no row here.
    again, taken = None, others.join(given, "_made", "left_semi")
    times = 1
    while not (taken := materialised(taken, "names-taken")).isEmpty():
        times += 1
        step = taken.select(key, F.lit(times).alias("_times"))
        again = step if again is None else again.unionByName(step)
        taken = taken.select(key, F.concat("_made", ending).alias("_made")).join(given, "_made", "left_semi")
    marked = df.join(first, key, "left")
    if again is not None:
        marked = marked.join(again.groupBy(key).agg(F.max("_times").alias("_times")), key, "left")
        ending = F.repeat(ending, F.coalesce("_times", F.lit(1)))
    made = F.when(F.col("_first"), F.col(name)).otherwise(F.concat(F.col(name), ending))
    return marked.withColumn(out, made).drop("_first", "_times")
