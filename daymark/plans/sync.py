"""Copy a table forward by the days its target does not hold.

One pass over the source: what the target holds is known from its catalog, rows of those days
are left out of the scan, and how many rows and days were copied is observed while they are
written.  A day the target holds is skipped whole, even if the source has more rows for it by
now.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DAY, quoted, with_day
from ..operators.days import distinct_days, in_days, listed
from ..sinks.tables import add_days, create_like
from ..sources.tables import Named, Table


@dataclass(frozen=True)
class SyncReport:
    """What one hop found and copied."""

    table: str
    days: int
    rows: int
    null_day_rows: int


def source_days(source: DataFrame | Table, day: str = DAY) -> DataFrame:
    """The source's days, NULL included, with their row counts where known.

    A table laid out by day is answered by the catalog, without row counts; anything
    else by a scan of the day column that reduces before its shuffle.
    """
    if isinstance(source, Named):
        listed = source.listed_days(day)
        if listed is not None:
            return listed.withColumn("rows", F.lit(None).cast("long"))
        source = source.read()
    return with_day(source, day).groupBy(day).agg(F.count(F.lit(1)).alias("rows"))


def held_days(target: Table, day: str = DAY) -> DataFrame:
    """The days an existing target holds, from the catalog where it keeps them."""
    listed = target.listed_days(day)
    return listed if listed is not None else distinct_days(with_day(target.read(), day), day)


def fresh_days(source: DataFrame | Table, target: Table, day: str = DAY) -> DataFrame:
    """``source_days`` that the target lacks.  The NULL day stays: it never matches."""
    days = source_days(source, day)
    return days.join(held_days(target, day), day, "left_anti") if target.exists() else days


def sync_days(
    source: DataFrame | Table,
    target: Table,
    only: Sequence[dt.date] | None = None,
    day: str = DAY,
) -> SyncReport:
    """Copy the days ``target`` lacks, or those of ``only`` that it lacks.

    Rows without a day are never copied, only counted.  A source laid out by day is
    copied without a shuffle.
    """
    if isinstance(source, Named) and source.is_by_day(day):
        return _copy_days(source, target, only, day)
    rows = with_day(source.read() if isinstance(source, Named) else source, day)
    value = F.col(quoted(day))
    if only is not None:
        rows = rows.where(in_days(day, sorted(set(only))))
    held = listed(held_days(target, day), day) if target.exists() else []
    if held:  # rows without a day stay, to be counted as they are written
        rows = rows.where(value.isNull() | ~in_days(day, held))
    new = not target.exists()
    create_like(target, rows, [day])
    done = add_days(target, rows, day)
    if new and not done.days:
        target.drop()
    return SyncReport(target.identifier, len(done.days), done.rows, done.null_day_rows)


def _copy_days(source: Table, target: Table, only: Sequence[dt.date] | None, day: str) -> SyncReport:
    """The same from a table laid out by day: its catalog says what is missing, nothing is shuffled."""
    fresh = fresh_days(source, target, day)
    if only is not None:
        fresh = fresh.where(in_days(day, sorted(set(only))))
    found = fresh.collect()  # one row a calendar day
    undated = 0
    if any(r[day] is None for r in found):
        undated = with_day(source.read(), day).where(F.col(quoted(day)).isNull()).count()
    days = [r[day] for r in found if r[day] is not None]
    if not days:
        return SyncReport(target.identifier, 0, 0, undated)
    rows = with_day(source.read(), day).where(in_days(day, days))
    done = add_days(create_like(target, rows, [day]), rows, day, cluster=False)
    return SyncReport(target.identifier, len(days), done.rows, undated)


@dataclass(frozen=True)
class HopReports:
    local: SyncReport | None
    mart: SyncReport | None


def sync_two_hops(
    source: DataFrame | Table,
    local: Table,
    mart: Table,
    write_local: bool = True,
    write_mart: bool = True,
    only: Sequence[dt.date] | None = None,
    day: str = DAY,
) -> HopReports:
    """Source to local warehouse, then local warehouse to mart.

    The second hop reads the local table as it is after the first, not what the
    first meant to write.
    """
    first = sync_days(source, local, only, day) if write_local else None
    second = sync_days(local, mart, only, day) if write_mart and local.exists() else None
    return HopReports(first, second)
