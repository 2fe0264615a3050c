"""The command line, end to end."""

import pytest
from helpers import files_under

from daymark.__main__ import main
from daymark.session import scratch_dir
from daymark.sources.tables import Lake


@pytest.fixture
def job(spark):
    root = scratch_dir(spark, "cli")
    # Databases are named by branch, so a branch of its own keeps runs apart.
    ref = "t" + root[-8:]
    return lambda *args: main(["--root", root, "--ref", ref, *map(str, args)], spark), root, ref


def test_synth_to_mart(spark, job):
    call, root, ref = job
    call("synth", f"{root}/landing", 6, "--max-employees", 20, "--style", "camel")
    landed = f"{root}/landing/departments"
    departments = spark.read.parquet(landed)
    dated = f"{root}/dated.csv"
    departments.withColumnRenamed("startDate", "date").write.option("header", True).csv(dated)
    call("ingest", dated, "bronze", "departments")
    call("sync", "departments", "--publish-to", f"{root}/snap", "--today", "2024-01-01")

    lake = Lake(spark, root, ref)
    assert lake.table("gold", "departments").read().count() == departments.count()
    first = departments.agg({"startDate": "min"}).first()[0]
    call("slice", "gold", "departments", first, f"{root}/slice", "--file-type", "csv")
    assert spark.read.option("header", True).csv(f"{root}/slice").count() >= 1

    other = Lake(spark, f"{root}/other", ref + "b").create_layers()
    main(["--root", other.root, "--ref", other.ref, "restore", f"{root}/snap"], spark)
    assert other.table("gold", "departments").read().count() == departments.count()


def test_bootstrap_and_publish(spark, job, sf_dir):
    call, root, ref = job
    call("bootstrap", f"{sf_dir}/nation.parquet", "bronze", "nation", "--partition-by", "n_regionkey")
    call("bootstrap", f"{sf_dir}/nation.parquet", "bronze", "nation", "--mode", "overwrite")
    assert Lake(spark, root, ref).table("bronze", "nation").read().count() == 25
    call("publish", f"{root}/snap", "2024-01-01", "bronze.nation")
    assert files_under(f"{root}/snap/data/bronze/nation", ".parquet")


def test_a_folder_of_csv_files(spark, job):
    call, root, ref = job
    for name, days in (("a", 2), ("b", 3)):
        texts = spark.range(days).selectExpr("id", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS Date")
        texts.write.option("header", True).csv(f"{root}/in/{name}.csv")
    for _ in range(2):
        call("ingest-folder", f"{root}/in", "bronze", "a", "b.csv")
    lake = Lake(spark, root, ref)
    assert [lake.table("bronze", n).read().count() for n in "ab"] == [2, 3]


def test_missing_tables_are_named(job):
    call, root, _ = job
    for args in (
        ("sync", "nothing"),
        ("slice", "gold", "nothing", "2024-01-01", f"{root}/x"),
        ("publish", f"{root}/snap", "2024-01-01", "gold.nothing"),
    ):
        with pytest.raises(SystemExit, match="nothing"):
            call(*args)


def test_loads_by_company(spark, job):
    call, root, _ = job
    for stamp in ("20240101-000000", "20240102-000000"):
        call("synth", f"{root}/landing", 3, "--max-employees", 5, "--load-stamp", stamp)
    folders = files_under(f"{root}/landing/employees", ".parquet")
    assert len(folders) == 6 and len({f.rsplit("/", 2)[1] for f in folders}) == 3
    assert spark.read.parquet(f"{root}/landing/companies").count() == 6
