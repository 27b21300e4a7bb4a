"""Compare a Spark result with a DuckDB result as bags of rows."""

from __future__ import annotations

import os

import duckdb

TESTDATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(name: str) -> str:
    name = str(name).lower()
    names = {"varchar": "string", "integer": "int", "boolean": "boolean"}
    return names.get(name, name)


def rows_of_duck(con, sql: str):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    schema = [(rel.columns[i], _kind(rel.types[i])) for i in order]
    return schema, sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)


def rows_of_spark(df):
    names = sorted(df.columns)
    df = df.select(*names)
    schema = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return schema, sorted((tuple(r) for r in df.collect()), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when names, types, row counts and values are equal; else what differs."""
    spark_schema, spark_rows = rows_of_spark(df)
    duck_schema, duck_rows = rows_of_duck(con, sql)
    if spark_schema != duck_schema:
        return f"schema {spark_schema} != {duck_schema}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} != {len(duck_rows)}"
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            return f"row {a} != {b}"
    return None
