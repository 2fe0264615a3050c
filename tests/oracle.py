"""Compare a Spark frame with DuckDB's answer as multisets of rows, types included."""

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(df, con, sql):
    """Problems found, as text; empty when both sides agree."""
    relation = con.sql(sql)
    spark_types = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema}
    duck_types = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    if spark_types != duck_types:
        return f"columns differ: {spark_types} / {duck_types}"
    columns = sorted(spark_types)
    ours = Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = Counter(relation.select(quoted).fetchall())
    if not theirs:
        return "the oracle returns no rows"
    if ours != theirs:
        extra, absent = ours - theirs, theirs - ours
        return (
            f"{sum(ours.values())} / {sum(theirs.values())} rows, {sum(extra.values())} extra "
            f"e.g. {list(extra)[:2]}, {sum(absent.values())} absent e.g. {list(absent)[:2]}"
        )
    return ""
