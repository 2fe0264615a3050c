"""Reading files, tables and SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ingest import bootstrap, stage
from ..session import file_system, scratch_dir
from ..sinks.files import write_csv, write_entity_csv, write_parquet
from ..sinks.tables import create_as
from ..sources.files import latest_dated_file, latest_file, query_in_place, read_csv, read_json, read_parquet
from ..sources.sql import query as sql_query
from ..sources.tables import Lake, attach
from .registry import query, scratch_lake, table


def _printable_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the balance as a decimal, which prints alike everywhere."""
    df = table(spark, sf_dir, "customer")
    return df.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(15,2)"))


CUSTOMER_STRINGS = """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS c_acctbal, c_mktsegment
FROM customer
"""


@query("SELECT * FROM orders")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/orders.parquet")


@query(CUSTOMER_STRINGS)
def scan_csv_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "customer-csv")
    write_csv(_printable_customers(spark, sf_dir), path)
    return read_csv(spark, path)


@query("SELECT * FROM customer")
def scan_csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "customer-csv")
    customers = table(spark, sf_dir, "customer")
    write_csv(customers, path)
    return read_csv(spark, path, customers.schema)


def _write_json_documents(df: DataFrame, path: str, per_document: int = 50_000) -> None:
    """Fixture: pretty-printed JSON arrays, one per file, of at most ``per_document``
    neighbouring rows each, whatever their values."""
    rows = F.collect_list(F.struct(*df.columns))
    place = F.call_function("div", F.monotonically_increasing_id(), F.lit(per_document))
    (
        df.groupBy(place.alias("document"))
        .agg(F.to_json(rows, {"pretty": "true"}).alias("value"))
        .write.mode("overwrite")
        .partitionBy("document")
        .text(path)
    )


@query(
    """
    SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
    FROM customer
    """
)
def scan_json_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "customer-json")
    customers = table(spark, sf_dir, "customer")
    _write_json_documents(customers, path)
    return read_json(spark, path).select(*customers.columns)


@query("SELECT * FROM customer")
def load_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(scratch_lake(spark), f"{sf_dir}/customer.parquet")


@query(CUSTOMER_STRINGS)
def load_by_suffix_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = scratch_lake(spark)
    path = f"{lake.root}/landing/customer.csv"
    write_csv(_printable_customers(spark, sf_dir), path)
    return stage(lake, path)


@query(CUSTOMER_STRINGS)
def entity_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "entities")
    path = write_entity_csv(_printable_customers(spark, sf_dir), root, "customers")
    return read_csv(spark, path)


@query("SELECT p_partkey, p_name, p_brand FROM part")
def raw_files_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_in_place(spark, f"{sf_dir}/part.parquet", "p_partkey, p_name, p_brand")


@query("SELECT * FROM part")
def moved_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = scratch_lake(spark)
    create_as(lake.table("bronze", "part"), table(spark, sf_dir, "part"))
    moved = Lake(spark, lake.root, ref="moved", prefix=lake.prefix).create_layers()
    old, new = (lk.table("bronze", "part").location for lk in (lake, moved))
    fs, old_path = file_system(spark, old)
    fs.rename(old_path, file_system(spark, new)[1])
    return attach(moved.table("bronze", "part")).read()


@query(
    "SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME, 'customer' AS ORIGIN FROM customer"
)
def query_upper_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_query(
        spark,
        "SELECT c_custkey, c_name, :origin AS origin FROM customer_rows",
        args={"origin": "customer"},
        views={"customer_rows": table(spark, sf_dir, "customer")},
    )


@query("SELECT * FROM supplier")
def bootstrap_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_lake(spark).table("bronze", "supplier")
    return bootstrap(spark, f"{sf_dir}/supplier.parquet", target).read()


@query("SELECT * FROM customer UNION ALL SELECT * FROM customer")
def bootstrap_twice_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_lake(spark).table("bronze", "customer")
    source = f"{sf_dir}/customer.parquet"
    # A handful of segments: a task writes a file for each, and nothing is shuffled.
    for _ in range(2):
        bootstrap(spark, source, target, ["c_mktsegment"], cluster=False)
    return target.read().select(*table(spark, sf_dir, "customer").columns)


@query("SELECT * FROM customer")
def bootstrap_between_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = scratch_lake(spark)
    staged = bootstrap(spark, f"{sf_dir}/customer.parquet", lake.table("bronze", "customer"))
    target = lake.table("silver", "customer")
    bootstrap(spark, staged.identifier, target, ["c_mktsegment"], cluster=False)
    return target.read().select(*staged.read().columns)


@query("SELECT s_suppkey, s_name, s_acctbal + 2 AS s_acctbal FROM supplier")
def latest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three exports of one table, each a little later; the rows of the newest."""
    root = scratch_dir(spark, "artifacts")
    suppliers = table(spark, sf_dir, "supplier")
    for i in range(3):
        balance = (F.col("s_acctbal") + i).alias("s_acctbal")
        write_parquet(suppliers.select("s_suppkey", "s_name", balance), f"{root}/export-{i}")
    newest = latest_file(spark, root, "*.parquet").first()["path"]
    return read_parquet(spark, newest.rsplit("/", 1)[0])


@query("SELECT s_suppkey, s_name, s_acctbal + 2 AS s_acctbal FROM supplier")
def latest_dated_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where exports are named by day: the newest day counts, whatever was touched last."""
    root = scratch_dir(spark, "artifacts")
    suppliers = table(spark, sf_dir, "supplier")
    for i, day in ((2, "2024/10/02"), (1, "2024/9/30"), (0, "2023/12/31")):
        balance = (F.col("s_acctbal") + i).alias("s_acctbal")
        write_parquet(suppliers.select("s_suppkey", "s_name", balance), f"{root}/{day}/supplier")
    newest = latest_dated_file(spark, root, "*.parquet").first()["path"]
    return read_parquet(spark, newest.rsplit("/", 1)[0])


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents"
)
def load_by_suffix_csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = scratch_lake(spark)
    path = f"{lake.root}/landing/documents.csv"
    write_csv(table(spark, sf_dir, "documents"), path)
    return stage(lake, path)


@query("SELECT * FROM customer")
def bootstrap_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_lake(spark).table("bronze", "customer")
    source = f"{sf_dir}/customer.parquet"
    bootstrap(spark, source, target)
    return bootstrap(spark, source, target, mode="overwrite").read()
