"""Queries IN-01 to IN-13 and RF-01 to RF-07, each with its check SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.values import open_end
from plumbline.operators import ingest, reference
from plumbline.operators.warehouse import unify
from plumbline.plans import inputs
from plumbline.plans.pipeline import geography, keyed_lines
from plumbline.plans.policy import BANDS, STATUS
from plumbline.plans.sql import KEYED, LINE_KEY
from plumbline.sources.relations import relation
from plumbline.sources.scan import CORRUPT, scan, scan_delimited, scan_xml, write_stage
from plumbline.sources.shared import fresh_path
from plumbline.sources.tables import LINE_CASTS, LINE_COLUMNS, SCHEMAS, table

QUERIES, ORACLE = {}, {}


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def in_01(spark: SparkSession, sf: str) -> DataFrame:
    lines = scan(spark, f"{sf}/lineitem.parquet", SCHEMAS["lineitem"])
    return lines.withColumn("l_shipdate", day("l_shipdate"))


ORACLE["in_01"] = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
  strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem"""

# The raw order lines as the check SQL sees them.
ORDER_FAULTS = """faulty AS (SELECT *,
    o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AS bad_date,
    o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' AS short FROM orders)"""


def in_02(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "order-lines")
    inputs.order_raw_lines(spark, sf).write.text(path)
    return scan_delimited(spark, path, inputs.ORDER_SCHEMA).select(
        "order_key", "cust_key", "status",
        F.col("price").cast("double").alias("price"),
        F.date_format("order_date", "yyyy-MM-dd").alias("order_date"),
        F.col(CORRUPT).isNotNull().alias("is_corrupt"),
    )


ORACLE["in_02"] = f"""WITH {ORDER_FAULTS}
SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS status,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
  CASE WHEN NOT bad_date AND NOT short THEN strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
  bad_date OR short AS is_corrupt FROM faulty"""


def in_03(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.split_line(
        inputs.order_raw_lines(spark, sf), "line", "|", inputs.ORDER_FIELDS
    ).drop("line")


ORACLE["in_03"] = f"""WITH {ORDER_FAULTS}
SELECT CAST(o_orderkey AS VARCHAR) AS order_key, CAST(o_custkey AS VARCHAR) AS cust_key,
  o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price,
  CASE WHEN short THEN NULL WHEN bad_date THEN '31/12/1999'
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
  NOT short AS arity_ok FROM faulty"""


def in_04(spark: SparkSession, sf: str) -> DataFrame:
    customers = inputs.mixed_records(spark, sf).where(F.col("line").startswith("CUS"))
    return ingest.cut_fixed(customers, "line", inputs.LAYOUTS["CUS"]).select(
        "key", "name", F.col("amount").cast("double").alias("amount")
    )


ORACLE["in_04"] = """SELECT c_custkey AS key, c_name AS name,
  CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM customer"""


def in_05(spark: SparkSession, sf: str) -> DataFrame:
    routed = ingest.route_once(
        inputs.mixed_records(spark, sf, faulty=True), "line", F.substring("line", 1, 3), inputs.LAYOUTS,
        fresh_path(spark, "routed"),
    )
    return unify(routed, "tag").select(
        "tag", "key", "name", F.col("amount").cast("double").alias("amount"),
        F.concat_ws(",", "errors").alias("errors"), "line",
    )


def _fixed(tag: str, key: str, name: str, amount: str = "''") -> str:
    return f"{tag} || lpad(CAST({key} AS VARCHAR), 12, ' ') || rpad({name}, 30, ' ') || {amount}"


_MONEY = "CAST(CAST({c} AS DECIMAL(18,2)) AS DOUBLE)"
_PADDED = "lpad(CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR), 14, ' ')"
ORACLE["in_05"] = f"""SELECT 'CUS' AS tag, c_custkey AS key, c_name AS name,
  CASE WHEN c_acctbal >= 0 THEN {_MONEY.format(c='c_acctbal')} END AS amount,
  CASE WHEN c_acctbal < 0 THEN 'BAD:amount' ELSE '' END AS errors,
  CASE WHEN c_acctbal < 0 THEN {_fixed("'CUS'", 'c_custkey', 'c_name', "lpad('n/a', 14, ' ')")} END AS line FROM customer
UNION ALL SELECT 'SUP', s_suppkey, s_name, {_MONEY.format(c='s_acctbal')}, '', NULL FROM supplier WHERE s_acctbal >= 0
UNION ALL SELECT 'UNROUTED', NULL, NULL, NULL, 'BAD:tag', {_fixed("'SPX'", 's_suppkey', 's_name', _PADDED)}
  FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'PRT', p_partkey, p_name, NULL, '', NULL FROM part WHERE p_size <= 45
UNION ALL SELECT 'UNROUTED', NULL, NULL, NULL, 'BAD:tag', {_fixed("'   '", 'p_partkey', 'p_name')} FROM part WHERE p_size > 45"""


def in_06(spark: SparkSession, sf: str) -> DataFrame:
    """The same events as JSON texts, some cut off, and as XML files, some with a bad value."""
    from_json = ingest.flatten_record(
        inputs.nested_actions(spark, sf), "record", "action string, items array<struct<k: bigint>>", each="items"
    ).select(F.lit("json").alias("source"), "event_id", "action", "k", "errors")
    path = fresh_path(spark, "actions")
    inputs.xml_actions(spark, sf).write.format("xml").option("rootTag", "acts").option("rowTag", "act").save(path)
    records = scan_xml(spark, path, inputs.ACTION_SCHEMA, "act")
    flat = ingest.flatten_record(records, "body", inputs.ACTION_SCHEMA, each="items")
    flat = flat.select(F.col("_id").alias("event_id"), "action", "k", F.col("errors").alias("_shape"))
    typed = ingest.cast_fields(flat, StructType.fromDDL("event_id bigint, action string, k bigint"))
    from_xml = typed.select(
        F.lit("xml").alias("source"), "event_id", "action", "k", F.concat("_shape", "errors").alias("errors")
    )
    return from_json.unionByName(from_xml).withColumn("errors", F.concat_ws(",", "errors"))


ORACLE["in_06"] = """SELECT 'json' AS source, event_id, event_type AS action,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k, '' AS errors FROM events WHERE event_type <> 'signup'
UNION ALL SELECT 'json', event_id, event_type, user_id, '' FROM events WHERE event_type <> 'signup'
UNION ALL SELECT 'json', event_id, NULL, NULL, 'BAD:record' FROM events WHERE event_type = 'signup'
UNION ALL SELECT 'xml', event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT), '' FROM events
UNION ALL SELECT 'xml', event_id, event_type, CASE WHEN event_type <> 'error' THEN user_id END,
  CASE WHEN event_type = 'error' THEN 'BAD:k' ELSE '' END FROM events"""


def _parsed_orders(spark: SparkSession, sf: str) -> DataFrame:
    fields = ingest.split_line(
        inputs.order_raw_lines(spark, sf), "line", "|", inputs.ORDER_FIELDS
    ).drop("line")
    return ingest.cast_fields(fields, inputs.ORDER_SCHEMA)


def in_07(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed_orders(spark, sf).select(
        "order_key", "cust_key", "status",
        F.col("price").cast("double").alias("price"),
        F.date_format("order_date", "yyyy-MM-dd").alias("order_date"),
        F.concat_ws(",", "errors").alias("errors"),
    )


ORACLE["in_07"] = f"""WITH {ORDER_FAULTS}
SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS status,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
  CASE WHEN NOT bad_date AND NOT short THEN strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
  CASE WHEN short THEN 'MISSING:order_date,BAD:arity' WHEN bad_date THEN 'BAD:order_date' ELSE '' END AS errors
FROM faulty"""


def _clean_segments(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.normalize_text(
        inputs.dirty_segments(spark, sf), [ingest.TextRule("segment")]
    )


def in_08(spark: SparkSession, sf: str) -> DataFrame:
    return _clean_segments(spark, sf)


ORACLE["in_08"] = """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment
FROM customer"""


def in_09(spark: SparkSession, sf: str) -> DataFrame:
    """Prices in four units: large money under a factor of one, tiny units under a small factor, and
    a unit that nobody declared."""
    units = relation(
        spark,
        "unit string, to_unit string, factor decimal(18,12)",
        [("USD", "USD", Decimal(1)), ("CENT", "USD", Decimal("0.01")), ("NANO", "USD", Decimal("0.000000001"))],
    )
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    scale = F.when(status == "F", 100).when(flag == "A", 1_000_000_000).when(flag == "R", 10_000_000_000).otherwise(1)
    unit = F.when(status == "F", "CENT").when(flag == "A", "NANO").when(flag == "N", "POINT").otherwise("USD")
    tagged = keyed_lines(spark, sf).select(
        "record_key", (price * scale.cast("decimal(12,0)")).cast("decimal(18,2)").alias("price"), unit.alias("unit")
    )
    out = ingest.normalize_units(tagged, units, "price")
    return out.select(
        "record_key", F.col("price").cast("double").alias("price"), "unit", F.concat_ws(",", "errors").alias("errors")
    )


ORACLE["in_09"] = f"""WITH tagged AS (SELECT {LINE_KEY} AS record_key, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
  l_linestatus <> 'F' AND l_returnflag = 'R' AS large, l_linestatus <> 'F' AND l_returnflag = 'N' AS unknown FROM lineitem)
SELECT record_key, CASE WHEN NOT unknown THEN CAST(CASE WHEN large THEN CAST(price AS DECIMAL(30,2)) * 10000000000 ELSE price END AS DOUBLE) END AS price,
  CASE WHEN NOT unknown THEN 'USD' END AS unit, CASE WHEN unknown THEN 'BAD:unit' ELSE '' END AS errors FROM tagged"""


def in_10(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    repeated = lines.unionByName(lines.where(F.col("l_returnflag") == "R"))
    return ingest.dedupe_raw(repeated).withColumn("l_shipdate", day("l_shipdate"))


ORACLE["in_10"] = """SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
  strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R')"""


def in_11(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = ingest.split_disposition(_parsed_orders(spark, sf))
    return good.unionByName(bad).select(
        "order_key", "disposition", F.concat_ws(",", "errors").alias("errors")
    )


ORACLE["in_11"] = f"""WITH {ORDER_FAULTS}
SELECT o_orderkey AS order_key,
  CASE WHEN short OR bad_date THEN 'QUARANTINED' ELSE 'ACCEPTED' END AS disposition,
  CASE WHEN short THEN 'MISSING:order_date,BAD:arity' WHEN bad_date THEN 'BAD:order_date' ELSE '' END AS errors
FROM faulty"""


def in_12(spark: SparkSession, sf: str) -> DataFrame:
    lines = ingest.record_key(table(spark, sf, "lineitem"), LINE_COLUMNS, LINE_CASTS)
    return lines.select("record_key", "l_orderkey", "l_linenumber")


ORACLE["in_12"] = f"WITH {KEYED} SELECT record_key, l_orderkey, l_linenumber FROM keyed"


def in_13(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "lines-by-year")
    lines = table(spark, sf, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    write_stage(lines, path, ["ship_year"])
    # A second write of two years replaces those two partitions and no other.
    stored = write_stage(lines.where(F.col("ship_year").isin(1996, 1997)), path, ["ship_year"])
    return stored.groupBy("ship_year").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
    )


ORACLE["in_13"] = """SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS n_lines,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM lineitem GROUP BY 1"""


def _status_ref(spark: SparkSession, codes=STATUS) -> DataFrame:
    return relation(spark, "o_orderstatus string, meaning string", codes)


# A reference version that does not know 'P'.
NO_PENDING = [pair for pair in STATUS if pair[0] != "P"]


def rf_01(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return reference.decode(orders, _status_ref(spark, NO_PENDING), "o_orderstatus", "meaning")


ORACLE["rf_01"] = """SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'FILLED'
  WHEN 'O' THEN 'OPEN' ELSE 'UNKNOWN' END AS meaning FROM orders"""


def rf_02(spark: SparkSession, sf: str) -> DataFrame:
    return reference.unresolved(
        table(spark, sf, "orders"), _status_ref(spark, NO_PENDING), "o_orderstatus"
    )


ORACLE["rf_02"] = """SELECT o_orderstatus, count(*) AS n FROM orders
WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1"""


def rf_03(spark: SparkSession, sf: str) -> DataFrame:
    return reference.ambiguous(table(spark, sf, "part"), "p_name", "p_brand")


ORACLE["rf_03"] = """SELECT p_name, count(DISTINCT p_brand) AS meanings, count(*) AS entries
FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1 OR count(*) > 1"""


def rf_04(spark: SparkSession, sf: str) -> DataFrame:
    # Meanings by time; 'O' has none before 1996.
    dated = relation(
        spark,
        "o_orderstatus string, lo string, hi string, meaning string",
        [
            ("F", "1900-01-01", "1998-01-01", "FILLED"),
            ("F", "1998-01-01", None, "CLOSED"),
            ("O", "1996-01-01", None, "OPEN"),
            ("P", "1900-01-01", "2000-01-01", "PENDING"),
            ("P", "2000-01-01", None, "ON HOLD"),
        ],
    ).select(
        "o_orderstatus",
        F.col("lo").cast("timestamp_ntz").alias("valid_from"),
        F.coalesce(F.col("hi").cast("timestamp_ntz"), open_end()).alias("valid_to"),
        "meaning",
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return reference.decode_at(orders, dated, "o_orderstatus", "o_orderdate", "meaning").select(
        "o_orderkey", "meaning"
    )


ORACLE["rf_04"] = """SELECT o_orderkey, CASE
  WHEN o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'FILLED'
  WHEN o_orderstatus = 'F' THEN 'CLOSED'
  WHEN o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' THEN 'OPEN'
  WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2000-01-01' THEN 'PENDING'
  WHEN o_orderstatus = 'P' THEN 'ON HOLD' ELSE 'UNKNOWN' END AS meaning FROM orders"""


def rf_05(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "value")
    return reference.decode_band(events, BANDS, "value")


ORACLE["rf_05"] = """SELECT event_id, value, CASE WHEN value >= 0 AND value < 10 THEN 'LOW'
  WHEN value >= 10 AND value < 50 THEN 'MID' WHEN value >= 50 AND value < 100 THEN 'HIGH'
  WHEN value >= 100 THEN 'TOP' ELSE 'UNKNOWN' END AS band FROM events"""


def rf_06(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return geography(spark, sf, customers, "c_nationkey", ["n_name", "r_name"])


ORACLE["rf_06"] = """SELECT c_custkey, c_nationkey, coalesce(n_name, 'UNKNOWN') AS n_name,
  coalesce(r_name, 'UNKNOWN') AS r_name FROM customer
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""


def rf_07(spark: SparkSession, sf: str) -> DataFrame:
    # NULL is the code of customers no segment was assigned to.
    ref = relation(
        spark,
        "segment string, desk string",
        [(None, "UNASSIGNED"), ("BUILDING", "DESK A"), ("MACHINERY", "DESK A"), ("FURNITURE", "DESK B")],
    )
    return reference.decode_nullsafe(_clean_segments(spark, sf), ref, "segment", "desk")


ORACLE["rf_07"] = """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment,
  CASE WHEN c_acctbal < 0 THEN 'UNASSIGNED' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY')
    THEN 'DESK A' WHEN c_mktsegment = 'FURNITURE' THEN 'DESK B' ELSE 'UNKNOWN' END AS desk
FROM customer"""

QUERIES.update({n: f for n, f in list(globals().items()) if n.startswith(("in_", "rf_"))})
