"""Time the registered queries and print one JSON line.

    BENCH_SF_DIR   table folder, default /root/testdata/sf0.1
    BENCH_CPUS     local cores, default 8
    BENCH_QUERIES  comma-separated names, default all

``python bench.py --loop`` instead sets one sync job for all missing days against a
loop that checks and copies day by day, on the same rows.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from daymark.operators.days import distinct_days, on_day  # noqa: E402
from daymark.plans.sync import sync_days  # noqa: E402
from daymark.session import Settings, build_session  # noqa: E402
from daymark.showcase import QUERIES  # noqa: E402
from daymark.showcase.registry import events_by_day, orders_by_day, scratch_lake  # noqa: E402
from daymark.sinks.tables import append, create_like  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
# Run once, untimed, so that the first timed query does not pay for a cold JVM.
WARM_UP = ("count_by_owner", "synth_companies", "append_by_date")


def session() -> SparkSession:
    extra = {"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    settings = Settings("daymark-bench", f"local[{CPUS}]", shuffle_partitions=CPUS, extra=extra)
    spark = build_session(settings)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(job) -> float:
    start = time.perf_counter()
    job()
    return round(time.perf_counter() - start, 3)


def day_by_day(source: DataFrame, target) -> None:
    """The loop that one sync job replaces: two checks and a write per day."""
    for (day,) in distinct_days(source).collect():
        if target.exists() and on_day(target.read(), day).count() > 0:
            continue
        rows = on_day(source, day)
        if rows.count() > 0:
            append(create_like(target, rows, ["DATE"]), rows)


def compare_with_loop(spark: SparkSession) -> dict[str, dict[str, float]]:
    result = {}
    for name, frame in (("events", events_by_day), ("orders", orders_by_day)):
        lake = scratch_lake(spark)
        # The source is a table laid out by day, as in a lake.
        source = lake.table("bronze", name)
        sync_days(frame(spark, SF_DIR), source)
        looped, synced = lake.table("silver", name), lake.table("gold", name)
        result[name] = {
            "days": distinct_days(source.read()).count(),
            "one_sync": timed(lambda: sync_days(source, synced)),
            "one_sync_again": timed(lambda: sync_days(source, synced)),
            "loop": timed(lambda: day_by_day(source.read(), looped)),
            "loop_again": timed(lambda: day_by_day(source.read(), looped)),
        }
        differing = looped.read().exceptAll(synced.read()).agg(F.count(F.lit(1))).first()[0]
        assert differing == 0, f"{name}: loop and sync differ in {differing} rows"
    return result


def main() -> None:
    spark = session()
    if "--loop" in sys.argv:
        print(json.dumps({"sf": SF_DIR, "cpus": CPUS, "seconds": compare_with_loop(spark)}))
        return
    names = os.environ.get("BENCH_QUERIES", "").split(",")
    names = [n for n in names if n] or list(QUERIES)
    for name in WARM_UP:
        drain(QUERIES[name](spark, SF_DIR))
    seconds = {name: timed(lambda: drain(QUERIES[name](spark, SF_DIR))) for name in names}
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
