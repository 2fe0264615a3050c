"""Sets of calendar days, and rows selected by them.

A day set is a one-column frame and its algebra runs on the cluster.  Selecting
rows by a computed set is the one place where days reach the driver: a literal
list prunes partitions and row groups, whatever its length.  It holds calendar days,
one each, so it does not grow with the rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import DAY, day_column, quoted
from ..session import materialised

def distinct_days(df: DataFrame, day: str = DAY) -> DataFrame:
    return df.select(day).distinct()


def missing_days(wanted: DataFrame, held: DataFrame, day: str = DAY) -> DataFrame:
    """Days of ``wanted`` that ``held`` lacks; NULLs compare equal.

    Both sides are reduced to one row per day before they meet, unless ``held`` is so
    small that Spark broadcasts it and drops held days on the way into the reduction.
    """
    return distinct_days(wanted, day).subtract(distinct_days(held, day))


def known_days(left: DataFrame, right: DataFrame, day: str = DAY) -> DataFrame:
    """Days of either side, in one aggregate that reduces both before its shuffle."""
    return left.select(day).union(right.select(day)).distinct()


def days_held(probe: DataFrame, held: DataFrame, day: str = DAY) -> DataFrame:
    """Every day of ``probe`` with a flag: does ``held`` have rows on it?"""
    marks = distinct_days(held, day).withColumn("held", F.lit(True))
    return distinct_days(probe, day).join(marks, day, "left").fillna(False, ["held"])


def on_day(df: DataFrame, day: dt.date, column: str = DAY) -> DataFrame:
    """One day's rows; the column may be spelled in any case.

    A timestamp column is compared as a range, and so is text, which may go on behind an ISO
    day: the filter reaches the file scan instead of hiding behind a cast."""
    column = day_column(df, column)
    kind = df.schema[column].dataType
    value = F.col(quoted(column))
    if isinstance(kind, T.StringType):
        after = day + dt.timedelta(days=1)
        return df.where((value >= F.lit(day.isoformat())) & (value < F.lit(after.isoformat())))
    if isinstance(kind, T.DateType):
        return df.where(value == F.lit(day))
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{column} is {kind.simpleString()}, not a date, timestamp or text")
    low, high = (F.lit(d).cast(kind) for d in (day, day + dt.timedelta(days=1)))
    return df.where((value >= low) & (value < high))


def has_rows_on(df: DataFrame, day: dt.date, column: str = DAY) -> bool:
    return not on_day(df, day, column).isEmpty()


def in_days(column: str, days: Sequence[dt.date]) -> Column:
    """Membership in a literal day list.

    Its range is added because Spark turns that into bounds on the scan, even where
    the day is a cast of a timestamp column.
    """
    if not days:
        return F.lit(False)
    name = quoted(column)
    literals = ", ".join(f"DATE'{d.isoformat()}'" for d in days)
    return F.expr(
        f"{name} IN ({literals}) AND {name} BETWEEN "
        f"DATE'{min(days).isoformat()}' AND DATE'{max(days).isoformat()}'"
    )


def listed(days: DataFrame, day: str = DAY) -> list[dt.date]:
    """The non-NULL days of a day set in order, each once."""
    rows = days.select(day).where(F.col(day).isNotNull()).distinct().collect()
    return sorted(row[0] for row in rows)


def rows_on_days(df: DataFrame, days: DataFrame, day: str = DAY) -> DataFrame:
    """Rows of ``df`` whose day is in the set; rows without a day never are.

    The fact rows are filtered in place, without a shuffle.
    """
    return df.where(in_days(day, listed(days, day)))


def joined_on_days(df: DataFrame, days: DataFrame, day: str = DAY) -> DataFrame:
    """The same rows by a semi-join, for a caller who wants no day on the driver but the range.

    The range bounds the scan, and as a filter on the days lets Spark prune partitions by
    what it finds of them while it runs.
    """
    days = materialised(days.select(day).where(F.col(day).isNotNull()).distinct(), "days")
    low, high = days.agg(F.min(day), F.max(day)).first()
    if low is None:
        return df.where(F.lit(False))
    within = F.col(day).between(F.lit(low), F.lit(high))
    joined = df.where(within).join(days.where(within), day, "left_semi")
    return joined.select(*[quoted(c) for c in df.columns])
