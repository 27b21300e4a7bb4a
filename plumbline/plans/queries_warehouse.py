"""Queries WM-01 to WM-06, DF-01 to DF-07 and MT-01 to MT-04, each with its check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from plumbline.operators import facts, metrics, warehouse
from plumbline.operators.history import assign_sk
from plumbline.operators.reference import UNKNOWN
from plumbline.plans.pipeline import customer_history, keyed_lines, long_keys, short_keys
from plumbline.plans.sql import KEYED
from plumbline.plans.sql import history as history_sql
from plumbline.sources.tables import table

QUERIES, ORACLE = {}, {}

LOG = dict(key=["o_custkey"], ts="o_orderdate", tie="o_orderkey", attrs=["o_orderpriority"])
PARTY = (
    StructType()
    .add("key", LongType())
    .add("name", StringType())
    .add("nation", IntegerType())
    .add("balance", DoubleType())
)


def _party(df: DataFrame, p: str, key: str) -> DataFrame:
    balance = F.col(f"{p}_acctbal").cast("decimal(18,2)")
    return warehouse.conform(
        df, PARTY, {"key": key, "name": f"{p}_name", "nation": f"{p}_nationkey", "balance": balance}
    )


def wm_01(spark: SparkSession, sf: str) -> DataFrame:
    return _party(table(spark, sf, "customer"), "c", "c_custkey")


CUSTOMER_PARTY = """SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation,
  CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance FROM customer"""
ORACLE["wm_01"] = CUSTOMER_PARTY


def wm_02(spark: SparkSession, sf: str) -> DataFrame:
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return warehouse.unify(
        {
            "CUSTOMER": _party(customer, "c", "c_custkey").withColumn("segment", F.lit("RETAIL")),
            "SUPPLIER": _party(supplier, "s", "s_suppkey"),
        },
        "source",
    )


ORACLE["wm_02"] = f"""SELECT *, 'RETAIL' AS segment, 'CUSTOMER' AS source FROM ({CUSTOMER_PARTY})
UNION ALL SELECT s_suppkey, s_name, s_nationkey,
  CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE), NULL, 'SUPPLIER' FROM supplier"""


def wm_03(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return warehouse.to_grain(
        table(spark, sf, "lineitem"),
        ["l_orderkey"],
        {
            "n_lines": F.count(F.lit(1)),
            "quantity": F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double"),
            "amount": F.sum(price).cast("double"),
        },
    )


ORACLE["wm_03"] = """SELECT l_orderkey, count(*) AS n_lines,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM lineitem GROUP BY 1"""


def wm_04(spark: SparkSession, sf: str) -> DataFrame:
    # Overdrawn suppliers are not members of the dimension.
    members = assign_sk(table(spark, sf, "supplier").where(F.col("s_acctbal") >= 0), ["s_suppkey"])
    return warehouse.resolve_fk(
        keyed_lines(spark, sf), members, "l_suppkey", "s_suppkey", "supplier_sk"
    ).select("record_key", "l_suppkey", "supplier_sk")


ORACLE["wm_04"] = f"""WITH {KEYED}, dim AS (SELECT s_suppkey,
  row_number() OVER (ORDER BY s_suppkey) AS sk FROM supplier WHERE s_acctbal >= 0)
SELECT record_key, l_suppkey, coalesce(sk, -1) AS supplier_sk FROM keyed
LEFT JOIN dim ON l_suppkey = s_suppkey"""


def wm_05(spark: SparkSession, sf: str) -> DataFrame:
    dates = table(spark, sf, "orders")
    lo = dates.agg(F.trunc(F.min("o_orderdate").cast("date"), "year").alias("lo")).scalar()
    last = F.add_months(F.trunc(F.max("o_orderdate").cast("date"), "year"), 12)
    hi = dates.agg(F.date_sub(last, 1).alias("hi")).scalar()
    return warehouse.calendar(spark, lo, hi).withColumn(
        "day", F.date_format("day", "yyyy-MM-dd")
    )


ORACLE["wm_05"] = """WITH span AS (SELECT date_trunc('year', min(o_orderdate)) AS lo,
  date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS hi FROM orders),
days AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM span)
SELECT strftime(d, '%Y-%m-%d') AS day, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter,
  CAST(month(d) AS INT) AS month, CAST(day(d) AS INT) AS day_of_month,
  CAST(isodow(d) AS INT) AS iso_weekday, CAST(weekofyear(d) AS INT) AS iso_week,
  CAST(d AS DATE) = last_day(CAST(d AS DATE)) AS is_month_end FROM days"""


def wm_06(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "customer").where(F.col("c_acctbal") >= 0).select("c_custkey", "c_name")
    return warehouse.infer_members(table(spark, sf, "orders"), known, "o_custkey", "c_custkey")


ORACLE["wm_06"] = """SELECT c_custkey, c_name, false AS is_inferred FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT DISTINCT o_custkey, NULL, true FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"""


def df_01(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return facts.dim_type1(log, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "sk", "o_custkey", "o_orderkey", "o_orderpriority"
    )


ORACLE["df_01"] = """SELECT row_number() OVER (ORDER BY o_custkey) AS sk, o_custkey, o_orderkey, o_orderpriority
FROM (SELECT * FROM orders QUALIFY row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    return facts.dim_type2(table(spark, sf, "orders"), **LOG)


def df_02(spark: SparkSession, sf: str) -> DataFrame:
    return _versions(spark, sf).select(
        "sk",
        "o_custkey",
        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
        F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"),
        "o_orderpriority",
        "is_current",
    )


VERSION_SK = "row_number() OVER (ORDER BY o_custkey, valid_from)"
ORACLE["df_02"] = f"""WITH {history_sql()} SELECT {VERSION_SK} AS sk, o_custkey,
  strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to,
  o_orderpriority, is_current FROM hist"""


def df_03(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = short_keys(keyed_lines(spark, sf)).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    part = assign_sk(table(spark, sf, "part"), ["p_partkey"])
    supplier = assign_sk(table(spark, sf, "supplier"), ["s_suppkey"])
    fact = facts.fact_line(
        lines, _versions(spark, sf), ["o_custkey"], "l_shipdate",
        {
            "l_partkey": (part, "p_partkey", "part_sk"),
            "l_suppkey": (supplier, "s_suppkey", "supplier_sk"),
        },
        counted=table(spark, sf, "orders").select("o_custkey"),
    )
    return long_keys(fact).select(
        "record_key", "version_sk", "part_sk", "supplier_sk",
        F.col("l_quantity").cast("decimal(18,2)").cast("double").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("double").alias("amount"),
    )


ORACLE["df_03"] = f"""WITH {KEYED}, {history_sql()},
dim AS (SELECT *, {VERSION_SK} AS sk FROM hist),
parts AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS part_sk FROM part),
suppliers AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS supplier_sk FROM supplier)
SELECT record_key, coalesce(sk, -1) AS version_sk, coalesce(part_sk, -1) AS part_sk,
  coalesce(supplier_sk, -1) AS supplier_sk, l_quantity AS quantity, l_extendedprice AS amount
FROM keyed JOIN orders o ON l_orderkey = o_orderkey
LEFT JOIN dim d ON d.o_custkey = o.o_custkey AND valid_from <= l_shipdate AND l_shipdate < valid_to
LEFT JOIN parts ON l_partkey = p_partkey LEFT JOIN suppliers ON l_suppkey = s_suppkey"""


def df_04(spark: SparkSession, sf: str) -> DataFrame:
    life = facts.fact_lifecycle(table(spark, sf, "orders"), table(spark, sf, "lineitem"))
    dates = ["ordered", "first_ship", "last_ship"]
    return life.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates})


ORACLE["df_04"] = """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ordered,
  strftime(min(l_shipdate), '%Y-%m-%d') AS first_ship, strftime(max(l_shipdate), '%Y-%m-%d') AS last_ship,
  count(l_orderkey) AS n_lines, CAST(date_diff('day', o_orderdate, min(l_shipdate)) AS INT) AS lag_days,
  CAST(date_diff('day', min(l_shipdate), max(l_shipdate)) AS INT) AS spread_days
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate"""

def df_05(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    dates = table(spark, sf, "orders")
    ends = dates.agg(F.struct(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi")).alias("at")).scalar()
    bounds = [ends["lo"], ends["hi"]]
    snap = facts.fact_snapshot(
        customer_history(spark, sf), members, "o_custkey", "o_orderpriority", *bounds, UNKNOWN
    )
    return snap.withColumn("period_end", F.date_format("period_end", "yyyy-MM-dd"))


ORACLE["df_05"] = f"""WITH {history_sql()}, periods AS (SELECT last_day(CAST(unnest(generate_series(
  (SELECT date_trunc('month', min(o_orderdate)) FROM orders),
  (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH)) AS DATE)) AS e)
SELECT c_custkey AS o_custkey, strftime(e, '%Y-%m-%d') AS period_end,
  coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority
FROM customer CROSS JOIN periods
LEFT JOIN hist ON o_custkey = c_custkey AND valid_from <= e AND e < valid_to"""


def df_06(spark: SparkSession, sf: str) -> DataFrame:
    lines = keyed_lines(spark, sf).select(
        "record_key", "l_partkey", "l_shipdate",
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
    )
    held = facts.fact_holding(lines, ["l_partkey"], ["l_shipdate", "record_key"], "quantity")
    return held.select("record_key", "l_partkey", F.col("holding").cast("double").alias("holding"))


ORACLE["df_06"] = f"""WITH {KEYED} SELECT record_key, l_partkey,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_partkey
    ORDER BY l_shipdate, record_key ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS holding FROM keyed"""

WEEK = 7 * 24 * 3600


def df_07(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    # Cells of one hour, 168 to the week.
    return facts.fact_trailing(events, "event_type", "ts", "value", WEEK, 168).drop("ts")


ORACLE["df_07"] = """SELECT event_id, event_type, value,
  max(value) OVER w AS trailing_high, min(value) OVER w AS trailing_low FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts
  RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)"""


def _money_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_partkey",
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_discount").cast("decimal(4,2)").alias("discount"),
    )


def mt_01(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    lines = _money_lines(spark, sf).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return metrics.metric(
        lines,
        ["p_brand"],
        {
            "n_lines": metrics.count_rows(),
            "quantity": metrics.total(F.col("quantity")),
            "amount": metrics.total(F.col("price")),
            "discount_rate": metrics.ratio(F.col("price") * F.col("discount"), F.col("price")),
        },
    )


ORACLE["mt_01"] = """WITH money AS (SELECT p_brand, CAST(l_quantity AS DECIMAL(18,2)) AS q,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS d
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand, count(*) AS n_lines, CAST(sum(q) AS DOUBLE) AS quantity, CAST(sum(p) AS DOUBLE) AS amount,
  CAST(sum(p * d) AS DOUBLE) / CAST(sum(p) AS DOUBLE) AS discount_rate FROM money GROUP BY 1"""


def mt_02(spark: SparkSession, sf: str) -> DataFrame:
    by = ["o_orderstatus", "o_orderpriority"]
    finest = metrics.metric(
        table(spark, sf, "orders"),
        by,
        {"n": metrics.count_rows(), "value": F.sum(F.col("o_totalprice").cast("decimal(18,2)"))},
    )
    return metrics.metric_cube(
        finest,
        [by, by[:1], by[1:], []],
        by,
        {"n_orders": F.sum("n"), "amount": metrics.total(F.col("value"))},
    )


ORACLE["mt_02"] = """SELECT o_orderstatus, o_orderpriority,
  CAST(grouping_id(o_orderstatus, o_orderpriority) AS INT) AS level, count(*) AS n_orders,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"""


def mt_03(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderstatus",
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )
    monthly = metrics.metric(orders, ["o_orderstatus", "month"], {"amount": F.sum("price")})
    month_before = F.date_format(
        F.add_months(F.concat("month", F.lit("-01")).cast("date"), -1), "yyyy-MM"
    )
    changed = metrics.metric_change(monthly, ["o_orderstatus"], "month", "amount", month_before)
    return changed.withColumns(
        {c: F.col(c).cast("double") for c in ("amount", "previous", "change")}
    )


ORACLE["mt_03"] = """WITH monthly AS (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month,
  sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount FROM orders GROUP BY 1, 2),
lagged AS (SELECT m.*, p.amount AS previous FROM monthly m LEFT JOIN monthly p
  ON p.o_orderstatus = m.o_orderstatus
  AND p.month = strftime(CAST(m.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m'))
SELECT o_orderstatus, month, CAST(amount AS DOUBLE) AS amount, CAST(previous AS DOUBLE) AS previous,
  CAST(amount - previous AS DOUBLE) AS change FROM lagged"""


def mt_04(spark: SparkSession, sf: str) -> DataFrame:
    spent = metrics.metric(
        table(spark, sf, "orders"),
        ["o_custkey"],
        {"amount": F.sum(F.col("o_totalprice").cast("decimal(18,2)"))},
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    ranked = spent.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    top = metrics.metric_topk(
        ranked, ["c_nationkey"], 3, [F.col("amount").desc(), F.col("c_custkey").asc()]
    )
    return top.select(
        "c_nationkey", "c_custkey", F.col("amount").cast("double").alias("amount"), "place"
    )


ORACLE["mt_04"] = """WITH spent AS (SELECT c_nationkey, c_custkey,
  sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY amount DESC, c_custkey) AS place
  FROM spent)
SELECT c_nationkey, c_custkey, CAST(amount AS DOUBLE) AS amount, CAST(place AS INT) AS place
FROM ranked WHERE place <= 3"""

QUERIES.update(
    {n: f for n, f in list(globals().items()) if n.startswith(("wm_", "df_", "mt_"))}
)
