"""The star-schema tables, each read under its fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.scan import scan

# The schemas of the given tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}

LINE_COLUMNS = [part.split()[0] for part in SCHEMAS["lineitem"].split(", ")]
# Casts that make a line's digest canonical.
LINE_CASTS = {
    "l_quantity": "decimal(18,2)", "l_extendedprice": "decimal(18,2)", "l_discount": "decimal(4,2)",
    "l_tax": "decimal(4,2)", "l_shipdate": "date",
}


# How many tasks a fact table's rows are dealt out to, where the session asks for it.
SCAN_TASKS = "spark.plumbline.scan.tasks"
FACT_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "events": "event_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. A file with one row group gives one task however many cores wait, so
    a local session may set ``SCAN_TASKS`` to deal its rows out; a cluster reading many
    splits leaves it unset and pays no shuffle. Filters and columns are pushed below it."""
    df = scan(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])
    tasks = spark.conf.get(SCAN_TASKS, None)
    return df.repartition(int(tasks), FACT_KEYS[name]) if tasks and name in FACT_KEYS else df
