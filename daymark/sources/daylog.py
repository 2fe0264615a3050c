"""The log of a day table: which run's folder holds each day.

A run writes whole days under a folder of its own, ``{table}/_runs/{run}/{DAY}=...``, that
nobody reads.  One entry in ``{table}/_days`` then makes all of its days visible at once: they
are partitions of the table, each with the location of its folder, and no file is moved.  A run
that breaks off has no entry.  Later sessions read the log again; of a day that several entries
hold, the last one counts.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import SparkSession

from ..functions.columns import quoted
from ..session import file_system

LOG, RUNS = "_days", "_runs"
AT_ONCE = 1000  # partitions named by one statement
ENTRIES = 32  # from which on they are summed up in one


def run_folder(location: str) -> str:
    return f"{location}/{RUNS}/{uuid.uuid4().hex}"


def children(spark: SparkSession, path: str) -> Iterator[str]:
    """Names in a folder, listed no further than they are asked for; none if there is no folder."""
    fs, jpath = file_system(spark, path)
    if not fs.exists(jpath):
        return
    entries = fs.listStatusIterator(jpath)
    while entries.hasNext():
        yield entries.next().getPath().getName()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write aside and move into place, so that what is there is whole."""
    folder, name = path.rsplit("/", 1)
    fs, aside = file_system(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    renamed(spark, aside.toString(), path)


def renamed(spark: SparkSession, source: str, target: str) -> None:
    """Rename, or raise: a file system says by its result alone that it did not."""
    fs, path = file_system(spark, source)
    if not fs.rename(path, file_system(spark, target)[1]):
        raise OSError(f"{source} was not renamed to {target}")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that no entry speaks of."""
    fs, jpath = file_system(spark, path)
    fs.delete(jpath, True)


def text_of(spark: SparkSession, path: str) -> str:
    fs, jpath = file_system(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _entries(spark: SparkSession, location: str) -> list[tuple[str, dict]]:
    """Name and content of the entries that still count, the oldest first."""
    names = sorted(n for n in children(spark, f"{location}/{LOG}") if n.endswith(".json") and not n.startswith("."))
    found, covered = [], set()
    for name in reversed(names):
        if name not in covered:
            entry = json.loads(text_of(spark, f"{location}/{LOG}/{name}"))
            covered.update(entry.get("covers", ()))
            found.append((name, entry))
    # A summary stands where the last of what it covers stood.
    return sorted(found, key=lambda e: max(e[1].get("covers", ()), default=e[0]))


def holds(spark: SparkSession, location: str) -> bool:
    return any(n.endswith(".json") and not n.startswith(".") for n in children(spark, f"{location}/{LOG}"))


def logged(spark: SparkSession, location: str) -> dict[str, str]:
    """Each logged day, as its folder's name has it, and the path of that folder below the table."""
    days: dict[str, str] = {}
    for _, entry in _entries(spark, location):
        for run, folders in entry["runs"]:
            for folder in folders:
                days[folder.split("=", 1)[1]] = f"{RUNS}/{run}/{folder}"
    return days


def written(spark: SparkSession, folder: str) -> list[str]:
    """The day folders of a run that has ended; one listing of one folder."""
    names = set(children(spark, folder))
    if "_SUCCESS" not in names:
        raise OSError(f"{folder} was not written to its end")
    return sorted(n for n in names if "=" in n)


def enter(spark: SparkSession, location: str, folder: str, folders: Sequence[str]) -> None:
    """Make the day folders of a run part of the table, for all sessions to come."""
    run = folder.rsplit("/", 1)[1]
    _put(spark, location, {"runs": [[run, list(folders)]]})
    entries = _entries(spark, location)
    if len(entries) >= ENTRIES:
        last: dict[str, str] = {}
        for _, entry in entries:
            for run, held in entry["runs"]:
                last.update((name, run) for name in held)
        runs: dict[str, list[str]] = {}
        for name, run in last.items():
            runs.setdefault(run, []).append(name)
        covers = [name for name, _ in entries] + [c for _, e in entries for c in e.get("covers", ())]
        _put(spark, location, {"runs": list(runs.items()), "covers": covers})


def _put(spark: SparkSession, location: str, entry: dict) -> None:
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.json"
    put_text(spark, f"{location}/{LOG}/{name}", json.dumps(entry))


def name_days(spark: SparkSession, identifier: str, day: str, days: Iterable[tuple[str, str]]) -> None:
    """Tell the catalog where each day lies, in few statements however many there are."""
    held = {r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {identifier}").collect()}
    new, moved = [], []
    for value, path in days:
        clause = f"PARTITION ({quoted(day)} = '{value}')"
        (moved if value in held else new).append((clause, f"LOCATION '{path}'"))
    for low in range(0, len(new), AT_ONCE):
        listed = " ".join(f"{clause} {place}" for clause, place in new[low : low + AT_ONCE])
        spark.sql(f"ALTER TABLE {identifier} ADD IF NOT EXISTS {listed}")
    for clause, place in moved:
        spark.sql(f"ALTER TABLE {identifier} {clause} SET {place}")
    spark.catalog.refreshTable(identifier)
