"""Jobs for spark-submit: ``python -m daymark <job> …`` (``--help`` lists them)."""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans import ingest, snapshots
from .plans.run import run
from .plans.slices import export_day
from .session import ObjectStore, Settings, build_session
from .sources.tables import LAYERS, CatalogTable, Lake, Table
from .synth.companies import CAMEL_CASE, TITLE_CASE
from .synth.landing import land

day = dt.date.fromisoformat


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="daymark")
    parser.add_argument("--root", required=True, help="folder of the lake")
    parser.add_argument("--ref", default="main", help="branch of the lake")
    parser.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="a Spark setting, catalogs included")
    parser.add_argument(
        "--store",
        action="append",
        default=[],
        metavar="BUCKET=PREFIX",
        help="a bucket, its credentials being read from PREFIX_ACCESS_KEY_ID and so on",
    )
    jobs = parser.add_subparsers(dest="job", required=True)

    def target(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("layer", nargs="?")
        sub.add_argument("table", nargs="?")
        sub.add_argument("--into", metavar="CATALOG.NAMESPACE.TABLE", help="a table of a named catalog, instead of layer and table")

    def job(name: str, text: str, *tables: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name, help=text)
        for argument in tables:
            sub.add_argument(argument)
        return sub

    sub = job("bootstrap", "load a whole file or table", "source")
    target(sub)
    sub.add_argument("--partition-by", nargs="*", default=[])
    sub.add_argument("--mode", choices=["append", "overwrite"], default="append")

    sub = job("ingest", "load a CSV file, by default only days not held", "source")
    target(sub)
    sub.add_argument("--all-days", action="store_true")

    sub = job("ingest-folder", "load the new days of {folder}/{name}.csv files", "folder", "layer")
    sub.add_argument("names", nargs="+")

    sub = job("sync", "copy missing days over both hops")
    sub.add_argument("tables", nargs="+")
    sub.add_argument("--source-layer", choices=LAYERS, default="bronze")
    sub.add_argument("--no-local", action="store_true")
    sub.add_argument("--no-mart", action="store_true")
    sub.add_argument("--restore-from")
    sub.add_argument("--publish-to")
    sub.add_argument("--today", type=day)

    sub = job("publish", "publish layer.table names under a day", "snapshots")
    sub.add_argument("day", type=day)
    sub.add_argument("tables", nargs="+")
    job("restore", "bring back the newest snapshot", "snapshots")

    sub = job("slice", "export one day of a table", "layer", "table")
    sub.add_argument("day", type=day)
    sub.add_argument("path")
    sub.add_argument("--file-type", choices=["parquet", "csv"], default="parquet")

    sub = job("synth", "land the synthetic dataset", "path")
    sub.add_argument("size", type=int, help="number of companies")
    sub.add_argument("--style", choices=["title", "camel"], default="title")
    sub.add_argument("--max-employees", type=int)
    sub.add_argument("--file-type", choices=["parquet", "csv"], default="parquet")
    sub.add_argument("--seed", type=int, default=0)
    sub.add_argument("--load-stamp", help="yyyyMMdd-HHmmss: a folder per load and company")
    return parser


def _pairs(texts: Sequence[str], option: str) -> list[tuple[str, str]]:
    pairs = [tuple(text.split("=", 1)) for text in texts]
    if wrong := [p[0] for p in pairs if len(p) < 2 or not p[0]]:
        raise SystemExit(f"{option} takes two parts around a '=': {', '.join(map(repr, wrong))}")
    return pairs


def _settings(args: argparse.Namespace) -> Settings:
    """What the command line says of the session; the last of equal keys holds."""
    stores = tuple(ObjectStore.from_env(*pair) for pair in _pairs(args.store, "--store"))
    return Settings(f"daymark-{args.job}", object_stores=stores, extra=dict(_pairs(args.conf, "--conf")))


def _target(args: argparse.Namespace, lake: Lake) -> Table | CatalogTable:
    if bool(args.into) == bool(args.table):
        raise SystemExit("give a layer and a table, or --into")
    return CatalogTable.named(lake.spark, args.into) if args.into else lake.table(args.layer, args.table)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or build_session(_settings(args))
    lake = Lake(spark, args.root.rstrip("/"), args.ref).create_layers()

    if args.job == "bootstrap":
        ingest.bootstrap(spark, args.source, _target(args, lake), args.partition_by, args.mode)
    elif args.job == "ingest":
        load = ingest.ingest_all if args.all_days else ingest.ingest_new_days
        print(load(spark, args.source, _target(args, lake)))
    elif args.job == "ingest-folder":
        for name, report in ingest.ingest_folder(lake, args.folder, args.names, args.layer).items():
            print(name, report)
    elif args.job == "sync":
        sources = {name: lake.table(args.source_layer, name) for name in args.tables}
        if absent := [name for name, table in sources.items() if not table.exists()]:
            raise SystemExit(f"not in {args.source_layer}: {', '.join(absent)}")
        reports = run(
            lake,
            sources,
            write_local=not args.no_local,
            write_mart=not args.no_mart,
            restore_from=args.restore_from,
            publish_to=args.publish_to,
            today=args.today,
        )
        for name, report in reports.items():
            print(name, report)
    elif args.job == "publish":
        pairs = [tuple(name.split(".", 1)) for name in args.tables]
        if absent := [name for name, p in zip(args.tables, pairs) if not lake.table(*p).exists()]:
            raise SystemExit(f"no such table: {', '.join(absent)}")
        snapshots.publish(lake, pairs, args.snapshots, args.day)
    elif args.job == "restore":
        for table in snapshots.restore(lake, args.snapshots):
            print(table.identifier)
    elif args.job == "slice":
        table = lake.table(args.layer, args.table)
        if not table.exists():
            raise SystemExit(f"no such table: {args.layer}.{args.table}")
        export_day(table.read(), args.day, args.path, args.file_type)
    else:
        profile = CAMEL_CASE if args.style == "camel" else TITLE_CASE
        if args.max_employees is not None:
            low, _ = profile.employees
            profile = dataclasses.replace(profile, employees=(low, args.max_employees))
        stamp = args.load_stamp
        ids = spark.range(args.size)
        land(ids, args.path, profile, args.file_type, args.seed, load_stamp=stamp)


if __name__ == "__main__":
    main()
