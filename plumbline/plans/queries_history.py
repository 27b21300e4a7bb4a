"""Queries IH-01 to IH-14, each with its check SQL. Orders are the change log of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.timeline import Timeline
from plumbline.functions.values import open_end
from plumbline.operators import history, intervals
from plumbline.operators.history_store import HistoryStore
from plumbline.operators.reference import UNKNOWN
from plumbline.plans import inputs
from plumbline.plans.pipeline import customer_history, keyed_lines, long_keys, short_keys
from plumbline.plans.sql import HISTORY_OUT, KEYED, OPEN_END
from plumbline.plans.sql import history as history_sql
from plumbline.sources.shared import fresh_path
from plumbline.sources.tables import table

QUERIES, ORACLE = {}, {}

LOG = dict(key=["o_custkey"], ts="o_orderdate", tie="o_orderkey", attrs=["o_orderpriority"])
# Buckets of the stored history: the given tables are small.
STORE_BUCKETS = 8


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"
    )


def _batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log in three batches by year: before 2000, 2000, from 2001."""
    log, year = _log(spark, sf), F.year("o_orderdate")
    return log.where(year < 2000), log.where(year == 2000), log.where(year > 2000)


def _out(hist: DataFrame) -> DataFrame:
    return hist.select(
        "o_custkey",
        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
        F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"),
        "o_orderpriority",
        "is_current",
    )


FULL_HISTORY = f"WITH {history_sql()} {HISTORY_OUT} FROM hist"


def ih_01(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer")
    named = history.resolve_key(customers.select("c_name"), "c_name", "#([0-9]+)$")
    members = customers.select(F.col("c_custkey").alias("resolved_key"), "c_mktsegment")
    return named.join(members, "resolved_key", "left")


ORACLE["ih_01"] = """SELECT a.c_name, b.c_custkey AS resolved_key, b.c_mktsegment FROM customer a
LEFT JOIN customer b ON CAST(regexp_extract(a.c_name, '#([0-9]+)$', 1) AS BIGINT) = b.c_custkey"""


def ih_02(spark: SparkSession, sf: str) -> DataFrame:
    return history.assign_sk(table(spark, sf, "customer"), ["c_name"])


ORACLE["ih_02"] = """SELECT c_name, row_number() OVER (ORDER BY c_name) AS sk
FROM (SELECT DISTINCT c_name FROM customer)"""


def ih_03(spark: SparkSession, sf: str) -> DataFrame:
    first, second, third = _batches(spark, sf)
    dim = history.assign_sk(first, ["o_orderkey"])
    return history.extend_sk(dim, second.unionByName(third), ["o_orderkey"])


ORACLE["ih_03"] = """SELECT o_orderkey, row_number() OVER (
  ORDER BY year(o_orderdate) >= 2000, o_orderkey) AS sk FROM orders"""


def ih_04(spark: SparkSession, sf: str) -> DataFrame:
    last = history.latest(_log(spark, sf), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return last.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


ORACLE["ih_04"] = """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
  o_orderpriority FROM orders QUALIFY row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""


def ih_05(spark: SparkSession, sf: str) -> DataFrame:
    return _out(customer_history(spark, sf))


ORACLE["ih_05"] = FULL_HISTORY


LOG_SCHEMA = "o_custkey bigint, o_orderkey bigint, o_orderdate timestamp_ntz, o_orderpriority string"


def _store(spark: SparkSession, first: DataFrame, *later: DataFrame) -> DataFrame:
    """The history after several batches, kept in a store of its own."""
    store = HistoryStore(
        spark, fresh_path(spark, "history"), ("o_custkey",), "o_orderdate", "o_orderkey",
        ("o_orderpriority",), LOG_SCHEMA, STORE_BUCKETS,
    ).build(first, "batch-0")
    for at, batch in enumerate(later, 1):
        store.apply(batch, f"batch-{at}")
    return store.history()


def ih_06(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_store(spark, *_batches(spark, sf)))


ORACLE["ih_06"] = FULL_HISTORY


def ih_07(spark: SparkSession, sf: str) -> DataFrame:
    first, second, third = _batches(spark, sf)
    state = lambda log: history.latest(log, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderpriority"
    )
    dim = history.upsert(state(first), state(second), ["o_custkey"])
    return history.upsert(dim, state(third), ["o_custkey"])


ORACLE["ih_07"] = """SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""


def ih_08(spark: SparkSession, sf: str) -> DataFrame:
    ends = inputs.end_events(spark, sf)
    return _out(history.close_history(customer_history(spark, sf), ends, ["o_custkey"]))


ORACLE["ih_08"] = f"""WITH {history_sql()},
ends AS (SELECT o_custkey, max(o_orderdate) AS end_ts FROM orders
  JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY 1),
closed AS (SELECT h.o_custkey, valid_from, least(valid_to, coalesce(end_ts, valid_to)) AS valid_to,
  o_orderpriority, is_current AND end_ts IS NULL AS is_current
  FROM hist h LEFT JOIN ends e ON h.o_custkey = e.o_custkey)
{HISTORY_OUT} FROM closed WHERE valid_from < valid_to"""


def ih_09(spark: SparkSession, sf: str) -> DataFrame:
    first, late, third = _batches(spark, sf)
    return _out(_store(spark, first.unionByName(third), late))


ORACLE["ih_09"] = FULL_HISTORY


def _probe_lines(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = short_keys(keyed_lines(spark, sf))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "record_key", "o_custkey", "l_shipdate"
    )


def ih_10(spark: SparkSession, sf: str) -> DataFrame:
    placed = intervals.asof(
        _probe_lines(spark, sf), customer_history(spark, sf), ["o_custkey"], "l_shipdate",
        counted=_log(spark, sf),
    )
    return long_keys(placed).select(
        "record_key", "o_custkey", F.coalesce("o_orderpriority", F.lit(UNKNOWN)).alias("priority")
    )


ASOF_SQL = f"""WITH {KEYED}, {history_sql()}
SELECT record_key, o.o_custkey, coalesce(h.o_orderpriority, 'UNKNOWN') AS priority
FROM keyed JOIN orders o ON l_orderkey = o.o_orderkey
LEFT JOIN hist h ON h.o_custkey = o.o_custkey AND h.valid_from <= l_shipdate AND l_shipdate < h.valid_to"""
ORACLE["ih_10"] = ASOF_SQL


def ih_11(spark: SparkSession, sf: str) -> DataFrame:
    placed = history.asof_last(
        _probe_lines(spark, sf), _log(spark, sf), ["o_custkey"], "l_shipdate",
        "o_orderdate", "o_orderkey", ["o_orderpriority"],
    )
    return long_keys(placed).select(
        "record_key", "o_custkey", F.coalesce("o_orderpriority", F.lit(UNKNOWN)).alias("priority")
    )


ORACLE["ih_11"] = ASOF_SQL


def ih_12(spark: SparkSession, sf: str) -> DataFrame:
    at = F.lit("1998-01-01").cast("timestamp_ntz")
    return _out(history.snapshot(customer_history(spark, sf), at))


ORACLE["ih_12"] = f"""WITH {history_sql()} {HISTORY_OUT} FROM hist
WHERE valid_from <= TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-01' < valid_to"""


def ih_13(spark: SparkSession, sf: str) -> DataFrame:
    return history.interval_faults(inputs.faulty_history(spark, sf), ["o_custkey"]).select(
        "o_custkey",
        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
        F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"),
        "fault",
    )


FAULTY_SQL = f"""nexts AS (SELECT o_custkey, o_orderdate, o_orderstatus,
  lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders),
faulty_hist AS (SELECT o_custkey, o_orderdate AS valid_from, coalesce(CASE o_orderstatus
    WHEN 'P' THEN nxt + INTERVAL 10 DAY WHEN 'O' THEN nxt - INTERVAL 5 DAY ELSE nxt END, {OPEN_END}) AS valid_to,
  nxt IS NULL AS is_current FROM nexts),
reached AS (SELECT *, max(valid_to) OVER (PARTITION BY o_custkey ORDER BY valid_from, valid_to
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM faulty_hist),
faults AS (SELECT o_custkey, valid_from, valid_to, CASE WHEN valid_from >= valid_to THEN 'EMPTY'
  WHEN valid_from < reached THEN 'OVERLAP' WHEN valid_from > reached THEN 'GAP' END AS fault FROM reached)"""

ORACLE["ih_13"] = f"""WITH {FAULTY_SQL}
SELECT o_custkey, strftime(valid_from, '%Y-%m-%d') AS valid_from,
  strftime(valid_to, '%Y-%m-%d') AS valid_to, fault FROM faults WHERE fault IS NOT NULL"""


def day_versions(spark: SparkSession, sf: str) -> DataFrame:
    """One version per customer-day, changed or not."""
    states = history.collapse_ties(_log(spark, sf), **LOG)
    return (
        Timeline(states, ["o_custkey"], ["o_orderdate"])
        .next(["o_orderdate"], "_after")
        .rows()
        .select(
            "o_custkey",
            F.col("o_orderdate").alias("valid_from"),
            F.coalesce("_after.o_orderdate", open_end()).alias("valid_to"),
            "o_orderpriority",
        )
    )


def ih_14(spark: SparkSession, sf: str) -> DataFrame:
    return _out(
        history.coalesce_history(day_versions(spark, sf), ["o_custkey"], ["o_orderpriority"])
    )


ORACLE["ih_14"] = FULL_HISTORY

QUERIES.update({n: f for n, f in list(globals().items()) if n.startswith("ih_")})
