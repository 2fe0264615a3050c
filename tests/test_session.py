import os

import pytest

from daymark.session import ObjectStore, Settings, materialised, scratch_dir, scratch_root


def test_object_store_reads_its_prefix():
    env = {
        "ARCHIVE_ACCESS_KEY_ID": "id",
        "ARCHIVE_SECRET_ACCESS_KEY": "hidden",
        "ARCHIVE_REGION": "eu-1",
        "ARCHIVE_ENDPOINT": "http://store",
    }
    store = ObjectStore.from_env("snapshots", "ARCHIVE", env)
    base = "spark.hadoop.fs.s3a.bucket.snapshots"
    assert store.conf()[f"{base}.access.key"] == "id"
    assert store.conf()[f"{base}.endpoint"] == "http://store"
    assert "hidden" not in repr(store)


def test_missing_credentials_are_named():
    with pytest.raises(OSError, match="MAIN_SECRET_ACCESS_KEY, MAIN_REGION"):
        ObjectStore.from_env("lake", "MAIN", {"MAIN_ACCESS_KEY_ID": "id"})


def test_settings_become_session_conf():
    conf = Settings(
        warehouse="/lake",
        shuffle_partitions=2000,
        catalogs={"lake": {"": "a.b.Catalog", "ref": "main"}},
        extra={"spark.sql.adaptive.enabled": "false"},
    ).conf()
    assert conf["spark.sql.warehouse.dir"] == "/lake"
    assert conf["spark.sql.shuffle.partitions"] == "2000"
    assert conf["spark.sql.catalog.lake"] == "a.b.Catalog"
    assert conf["spark.sql.catalog.lake.ref"] == "main"
    assert conf["spark.sql.adaptive.enabled"] == "false"
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert initial not in conf and initial in Settings().conf()


def test_scratch_is_where_the_cluster_says(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_root(spark) == root
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first != second and first.startswith(root) and os.path.isdir(first)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Session)


def test_materialised_has_a_known_size(spark):
    df = materialised(spark.range(100).toDF("a").groupBy("a").count(), "t")
    stats = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert stats < 100_000 and df.count() == 100


def test_settings_from_the_command_line(monkeypatch):
    from daymark.__main__ import _parser, _settings

    for part in ("ACCESS_KEY_ID", "SECRET_ACCESS_KEY", "REGION"):
        monkeypatch.setenv(f"RAW_{part}", part.lower())
    given = ["--root", "x", "--conf", "spark.sql.catalog.lake=a.B", "--conf", "k=v=w", "--store", "landing=RAW", "restore", "s"]
    conf = _settings(_parser().parse_args(given)).conf()
    assert conf["spark.sql.catalog.lake"] == "a.B" and conf["k"] == "v=w"
    assert conf["spark.hadoop.fs.s3a.bucket.landing.access.key"] == "access_key_id"
    for wrong in ("--conf", "--store"):
        with pytest.raises(SystemExit, match="two parts"):
            _settings(_parser().parse_args(["--root", "x", wrong, "alone", "restore", "s"]))
