"""Session settings: catalogs, object stores, and where scratch data may go."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

# Defaults that hold from a laptop to a large cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Tables synced side by side share the executors instead of queueing.
    "spark.scheduler.mode": "FAIR",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.hadoop.parquet.block.size": str(128 * 1024 * 1024),
    "spark.ui.enabled": "false",
}

# Without a partition count of their own, shuffles start this wide and AQE folds
# them to the advisory size.  Folding is cheap; too few partitions cannot be split
# under an aggregate.
INITIAL_PARTITIONS = 4096


@dataclass(frozen=True)
class ObjectStore:
    """Credentials and endpoint of one bucket, read from the environment."""

    bucket: str
    access_key: str
    secret_key: str = field(repr=False)
    region: str
    endpoint: str | None = None

    @classmethod
    def from_env(cls, bucket: str, prefix: str, env: Mapping[str, str] | None = None) -> ObjectStore:
        """Read ``{prefix}_ACCESS_KEY_ID``, ``_SECRET_ACCESS_KEY``, ``_REGION`` and, if set, ``_ENDPOINT``."""
        env = os.environ if env is None else env
        names = [f"{prefix}_{part}" for part in ("ACCESS_KEY_ID", "SECRET_ACCESS_KEY", "REGION")]
        missing = [name for name in names if not env.get(name)]
        if missing:
            raise OSError(f"object store {bucket!r}: not set: {', '.join(missing)}")
        return cls(bucket, *(env[name] for name in names), env.get(f"{prefix}_ENDPOINT"))

    def conf(self) -> dict[str, str]:
        """Per-bucket settings, so stores with different credentials share a session."""
        base = f"spark.hadoop.fs.s3a.bucket.{self.bucket}"
        conf = {
            f"{base}.access.key": self.access_key,
            f"{base}.secret.key": self.secret_key,
            f"{base}.endpoint.region": self.region,
        }
        if self.endpoint:
            conf[f"{base}.endpoint"] = self.endpoint
            conf[f"{base}.path.style.access"] = "true"
        return conf


@dataclass(frozen=True)
class Settings:
    """What a session needs to know; holds no secrets of its own.

    ``catalogs`` maps a catalog name to its properties; the empty key is the
    implementing class, e.g. ``{"lake": {"": cls, "ref": "main", "warehouse": ...}}``.
    """

    app_name: str = "daymark"
    master: str | None = None
    warehouse: str | None = None
    shuffle_partitions: int | None = None
    catalogs: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    object_stores: tuple[ObjectStore, ...] = ()
    extra: Mapping[str, str] = field(default_factory=dict)

    def conf(self) -> dict[str, str]:
        conf = dict(DEFAULTS)
        if self.warehouse:
            conf["spark.sql.warehouse.dir"] = self.warehouse
        if self.shuffle_partitions:
            conf["spark.sql.shuffle.partitions"] = str(self.shuffle_partitions)
        else:
            initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
            conf[initial] = str(INITIAL_PARTITIONS)
        for name, properties in self.catalogs.items():
            for key, value in properties.items():
                conf[f"spark.sql.catalog.{name}" + (f".{key}" if key else "")] = value
        for store in self.object_stores:
            conf.update(store.conf())
        conf.update(self.extra)
        return conf


def build_session(settings: Settings = Settings()) -> SparkSession:
    builder = SparkSession.builder.appName(settings.app_name)
    if settings.master:
        builder = builder.master(settings.master)
    for key, value in settings.conf().items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def bounded_listing(spark: SparkSession) -> None:
    """Let no job that lists folders have more tasks than a few times the cores.

    Spark's own bound is one task a folder up to 10,000, which for a table of many days takes
    longer to schedule than to list.  A value that the user set stays.
    """
    if spark.conf.get(LISTING, None) in (None, "10000"):
        spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` decides.  Only a local master may go without it, and
    then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "daymark-scratch")


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The Hadoop file system of a path, and the path as it knows it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, jpath


def qualified(spark: SparkSession, path: str) -> str:
    """The full form of a path, scheme included."""
    fs, jpath = file_system(spark, path)
    return fs.makeQualified(jpath).toString().rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the scratch root, dropped when the session's JVM ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    fs, jpath = file_system(spark, path)
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def materialised(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to scratch and read it back.

    Cuts the lineage in storage that outlives an executor, and gives Spark the
    frame's true size, by which it decides whether a join may broadcast it.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
