"""Many tables in one run: restore, sync each, publish."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..functions.columns import DAY
from ..sources.tables import Lake, Table
from . import snapshots
from .sync import HopReports, sync_two_hops
from .threads import each


def run(
    lake: Lake,
    sources: Mapping[str, DataFrame | Table],
    local_layer: str = "silver",
    mart_layer: str = "gold",
    write_local: bool = True,
    write_mart: bool = True,
    restore_from: str | None = None,
    publish_to: str | None = None,
    today: dt.date | None = None,
    day: str = DAY,
    at_once: int = 4,
) -> dict[str, HopReports]:
    """Sync every named source over both hops, a few tables at a time.

    A failing table fails the run once the others are done; nothing is published then.
    """
    if publish_to and today is None:
        raise ValueError("publish_to needs the day to publish under")
    lake.create_layers()
    if restore_from:
        snapshots.restore(lake, restore_from, at_once)

    def sync(name: str) -> HopReports:
        local, mart = lake.table(local_layer, name), lake.table(mart_layer, name)
        return sync_two_hops(sources[name], local, mart, write_local, write_mart, day=day)

    reports = dict(zip(sources, each(lake.spark, sync, sources, at_once)))

    if publish_to:
        written = [(layer, name) for layer in (local_layer, mart_layer) for name in sources]
        present = [pair for pair in written if lake.table(*pair).exists()]
        snapshots.publish(lake, present, publish_to, today, at_once)
    return reports
