"""Queries VF-01 to VF-13, each with its check SQL (VF-01 has no SQL form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators import classify, contracts, ingest, verify
from plumbline.operators.govern import RUN, inject
from plumbline.plans import inputs
from plumbline.plans.pipeline import customer_history, keyed_lines, order_lines, short_keys
from plumbline.plans.policy import FAULT, LINE_RULES, STATUS
from plumbline.plans.queries_classify import RULED
from plumbline.plans.queries_history import FAULTY_SQL
from plumbline.plans.queries_ingest import ORDER_FAULTS, NO_PENDING
from plumbline.plans.sql import JOINED, KEYED, LINE_KEY
from plumbline.plans.sql import history as history_sql
from plumbline.sources.relations import relation
from plumbline.sources.shared import store
from plumbline.sources.tables import LINE_CASTS, LINE_COLUMNS, SCHEMAS, table

QUERIES, ORACLE = {}, {}

LINE_PAIR = ["l_orderkey", "l_linenumber"]


def some_lines(spark: SparkSession, sf: str, short: bool) -> DataFrame:
    """Keyed lines; with ``short`` under keys of 16 bytes."""
    return short_keys(keyed_lines(spark, sf)) if short else keyed_lines(spark, sf)


def priced_lines(spark: SparkSession, sf: str, short: bool = False) -> DataFrame:
    return some_lines(spark, sf, short).select(
        "record_key", "l_orderkey", "l_suppkey",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
    )


def unit_fault(df: DataFrame) -> DataFrame:
    """The lines after the unit fault F1."""
    return inject(df.withColumn(RUN, F.lit("F1")), FAULT["F1"]).drop(RUN)


# A target that expects money as decimals, a tax code, and no tax rate.
OTHER_LINES = (
    SCHEMAS["lineitem"]
    .replace("l_extendedprice double", "l_extendedprice decimal(18,2)")
    .replace("l_tax double", "l_taxcode string")
)


def vf_01(spark: SparkSession, sf: str) -> DataFrame:
    target = StructType.fromDDL(OTHER_LINES)
    return verify.check_schema(spark.read.parquet(f"{sf}/lineitem.parquet"), target)


WANTED = ", ".join("('{}', '{}')".format(*field.split()) for field in OTHER_LINES.split(", "))
ORACLE["vf_01"] = f"""WITH have AS (SELECT column_name AS c, CASE column_type WHEN 'VARCHAR' THEN 'string'
    WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS t
  FROM (DESCRIBE lineitem)), want AS (SELECT * FROM (VALUES {WANTED}) AS v(c, t))
SELECT coalesce(w.c, h.c) AS "column", CASE WHEN h.c IS NULL THEN 'MISSING' WHEN w.c IS NULL THEN 'EXTRA'
    ELSE 'RETYPED' END AS problem, w.t AS expected, h.t AS found
FROM want w FULL JOIN have h ON w.c = h.c WHERE w.t IS DISTINCT FROM h.t"""


def vf_02(spark: SparkSession, sf: str) -> DataFrame:
    return verify.check_grain(table(spark, sf, "lineitem"), LINE_PAIR)


ORACLE["vf_02"] = """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1"""


def _status_domain(spark: SparkSession, codes) -> DataFrame:
    return relation(spark, "code string, meaning string", codes)


def vf_03(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("status")
    )
    return verify.check_domain(orders, "status", _status_domain(spark, NO_PENDING), "code")


ORACLE["vf_03"] = """SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS status FROM orders)
WHERE status IS NULL OR status NOT IN ('F', 'O') GROUP BY 1"""


def vf_04(spark: SparkSession, sf: str) -> DataFrame:
    solvent = table(spark, sf, "supplier").where(F.col("s_acctbal") >= 0)
    return verify.check_fk(table(spark, sf, "lineitem"), solvent, "l_suppkey", "s_suppkey")


ORACLE["vf_04"] = """SELECT l_suppkey, count(*) AS n FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY 1"""


def valued_lines(spark: SparkSession, sf: str, short: bool = False) -> DataFrame:
    cents, price = F.col("l_linestatus") == "F", F.col("l_extendedprice").cast("decimal(18,2)")
    # Returned lines say so when they are in cents; other filled lines carry a wrong tag.
    tagged = some_lines(spark, sf, short).select(
        "record_key", "l_partkey",
        F.when(cents, price * 100).otherwise(price).alias("price"),
        F.when(cents & (F.col("l_returnflag") == "R"), "CENT").otherwise("USD").alias("unit"),
    )
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return tagged.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")


def vf_05(spark: SparkSession, sf: str) -> DataFrame:
    valued = valued_lines(spark, sf)
    bad = verify.check_unit(valued, "price", "unit", "USD", F.col("p_retailprice"), 0.0, 120.0)
    return bad.select("record_key", "unit", F.col("price").cast("double").alias("price"))


ORACLE["vf_05"] = f"""WITH {KEYED}, tagged AS (SELECT record_key, p_retailprice,
  CAST(l_extendedprice AS DECIMAL(18,2)) * CASE l_linestatus WHEN 'F' THEN 100 ELSE 1 END AS price,
  CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'CENT' ELSE 'USD' END AS unit
  FROM keyed LEFT JOIN part ON l_partkey = p_partkey)
SELECT record_key, unit, CAST(price AS DOUBLE) AS price FROM tagged
WHERE unit <> 'USD' OR NOT coalesce(CAST(price AS DOUBLE) / p_retailprice BETWEEN 0 AND 120, false)"""


def vf_06(spark: SparkSession, sf: str) -> DataFrame:
    versions = verify.check_time(inputs.faulty_history(spark, sf), ["o_custkey"]).select(
        F.concat_ws("@", F.col("o_custkey").cast("string"), F.date_format("valid_from", "yyyy-MM-dd")).alias("subject"),
        "fault",
    )
    early = verify.check_cause(order_lines(spark, sf), "o_orderdate", "l_shipdate")
    return versions.unionByName(
        early.select(F.col("record_key").alias("subject"), F.lit("BEFORE_CAUSE").alias("fault"))
    )


ORACLE["vf_06"] = f"""WITH {FAULTY_SQL}, {JOINED}
SELECT CAST(o_custkey AS VARCHAR) || '@' || strftime(valid_from, '%Y-%m-%d') AS subject, fault
FROM faults WHERE fault IS NOT NULL
UNION ALL SELECT CAST(o_custkey AS VARCHAR) || '@' || strftime(max(valid_from), '%Y-%m-%d'), 'CURRENT'
FROM faulty_hist GROUP BY o_custkey HAVING count(*) FILTER (is_current) <> 1
UNION ALL SELECT record_key, 'BEFORE_CAUSE' FROM joined WHERE l_shipdate < o_orderdate"""


def damaged_verdicts(spark: SparkSession, sf: str, short: bool = False) -> DataFrame:
    said = classify.classify(order_lines(spark, sf, short), LINE_RULES)
    # High-tax lines lose one part of their provenance each.
    tax, empty = F.col("l_tax"), F.create_map().cast("map<string,string>")
    return said.withColumns(
        {
            "rule_id": F.when(tax == 0.08, "R9").otherwise(F.col("rule_id")),
            "disposition": F.when(tax != 0.07, F.col("disposition")),
            "evidence": F.when(tax == 0.06, empty).otherwise(F.col("evidence")),
        }
    )


def vf_07(spark: SparkSession, sf: str) -> DataFrame:
    rules = classify.rules_relation(spark, [*LINE_RULES, HOLE_RULE])
    return verify.check_provenance(damaged_verdicts(spark, sf), rules).select("record_key", "rule_id", "problem")


HOLE_RULE = classify.Rule(classify.HOLE, 0, 0, "false", (), classify.UNDECIDED)

ORACLE["vf_07"] = f"""WITH {RULED}
SELECT record_key, CASE WHEN l_tax = 0.08 THEN 'R9' ELSE rule_id END AS rule_id,
  CASE WHEN l_tax = 0.07 THEN 'ABSENT' WHEN l_tax = 0.08 THEN 'ILLEGAL' ELSE 'NO_EVIDENCE' END AS problem
FROM ruled WHERE l_tax IN (0.07, 0.08) OR (l_tax = 0.06 AND rule_id <> 'HOLE')"""


def lossy_parse(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw lines, accepted rows and quarantined rows of a stage that forgets to quarantine the lines
    with too few fields."""
    raw = inputs.order_raw_lines(spark, sf)
    fields = ingest.split_line(raw, "line", "|", inputs.ORDER_FIELDS).drop("line")
    good, bad = ingest.split_disposition(ingest.cast_fields(fields, inputs.ORDER_SCHEMA))
    return raw, good, bad.where(~F.array_contains(ingest.ERRORS, "BAD:arity"))


def vf_08(spark: SparkSession, sf: str) -> DataFrame:
    return verify.edge_rows(*lossy_parse(spark, sf))


ORACLE["vf_08"] = f"""WITH {ORDER_FAULTS}
SELECT count(*) AS rows_in, count(*) FILTER (NOT bad_date AND NOT short) AS rows_accepted,
  count(*) FILTER (bad_date AND NOT short) AS rows_quarantined, count(*) FILTER (short) AS lost FROM faulty"""


def vf_09(spark: SparkSession, sf: str) -> DataFrame:
    before = priced_lines(spark, sf)
    out = verify.edge_measure(before, unit_fault(before), ["l_suppkey"], "price")
    return out.withColumns({c: F.col(c).cast("double") for c in ("before", "after")})


PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
F1_PRICE = f"{PRICE} * CASE WHEN l_orderkey % 97 = 0 THEN 100 ELSE 1 END"
ORACLE["vf_09"] = f"""SELECT l_suppkey, CAST(sum({PRICE}) AS DOUBLE) AS before,
  CAST(sum({F1_PRICE}) AS DOUBLE) AS after FROM lineitem GROUP BY 1
HAVING sum({PRICE}) <> sum({F1_PRICE})"""


def vf_10(spark: SparkSession, sf: str) -> DataFrame:
    # A content key changes when the content does.
    lines = table(spark, sf, "lineitem")
    faulty = unit_fault(lines.withColumn("price", F.col("l_extendedprice").cast("decimal(18,2)")))
    rekeyed = ingest.record_key(
        faulty.withColumn("l_extendedprice", F.col("price").cast("double")), LINE_COLUMNS, LINE_CASTS
    )
    return verify.edge_keys(keyed_lines(spark, sf), rekeyed, ["record_key"])


REKEYED = LINE_KEY.replace(PRICE, f"CAST({F1_PRICE} AS DECIMAL(18,2))")
ORACLE["vf_10"] = f"""WITH a AS (SELECT {LINE_KEY} AS record_key FROM lineitem),
b AS (SELECT {REKEYED} AS record_key FROM lineitem)
SELECT record_key, 'LOST' AS change FROM (SELECT record_key FROM a EXCEPT SELECT record_key FROM b)
UNION ALL SELECT record_key, 'INVENTED' FROM (SELECT record_key FROM b EXCEPT SELECT record_key FROM a)"""


def fanned_lines(lines: DataFrame) -> DataFrame:
    pairs = lines.groupBy(*LINE_PAIR).agg(F.count(F.lit(1)).alias("n"))
    # What a join on the pair that looks like a key would make of the lines.
    return lines.join(pairs, LINE_PAIR).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))
    )


def vf_11(spark: SparkSession, sf: str) -> DataFrame:
    lines = keyed_lines(spark, sf).select("record_key", *LINE_PAIR)
    return verify.edge_fanout(lines, fanned_lines(lines), ["record_key"])


ORACLE["vf_11"] = f"""WITH {KEYED} SELECT a.record_key, CAST(1 AS BIGINT) AS n_before, count(*) AS n_after
FROM keyed a JOIN keyed b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
GROUP BY 1 HAVING count(*) > 1"""


def vf_12(spark: SparkSession, sf: str) -> DataFrame:
    before = priced_lines(spark, sf)
    out = verify.edge_equal(before, unit_fault(before))
    return out.withColumn("price", F.col("price").cast("double"))


ORACLE["vf_12"] = f"""WITH {KEYED},
a AS (SELECT record_key, l_orderkey, l_suppkey, CAST({PRICE} AS DOUBLE) AS price FROM keyed),
b AS (SELECT record_key, l_orderkey, l_suppkey, CAST({F1_PRICE} AS DOUBLE) AS price FROM keyed)
SELECT *, 'LEFT' AS side, count(*) AS copies FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL
UNION ALL SELECT *, 'RIGHT', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL"""


# The contracts of the clean run.
PAIR, LINE, CUST = ("l_orderkey", "l_linenumber"), ("record_key",), ("o_custkey",)
CONTRACTS = [
    contracts.Contract(1, "stage", "grain_pair", "grain", "lines", None, PAIR, PAIR, None, None, "C1", "REVIEW"),
    contracts.Contract(1, "stage", "grain_key", "grain", "lines", None, LINE, LINE, None, None, "C2", "REJECT"),
    contracts.Contract(2, "stage", "domain", "domain", "orders", "status", ("o_orderkey",), ("o_orderstatus", "code"), "code", None, "C3", "QUARANTINE"),
    contracts.Contract(3, "stage", "fk", "fk", "orders", "customer", ("o_orderkey",), ("o_custkey", "c_custkey"), None, None, "C4", "QUARANTINE"),
    contracts.Contract(3, "stage", "time", "time", "history", None, CUST, ("valid_from", "valid_to", "is_current"), "day", "[valid_from, valid_to)", "C5", "REJECT"),
    contracts.Contract(4, "stage", "cause", "cause", "joined", None, LINE, ("o_orderdate", "l_shipdate"), "day", "o_orderdate <= l_shipdate", "C6", "REVIEW"),
    contracts.Contract(4, "edge", "keys", "keys", "lines", "joined", LINE, LINE, None, None, "C7", "REJECT"),
]


def vf_13(spark: SparkSession, sf: str) -> DataFrame:
    """The gate of a clean run, driven by a relation of contracts. Stage 1 and the history are stored
    once, as several checks read them."""
    orders = table(spark, sf, "orders")
    lines = store(keyed_lines(spark, sf).select("record_key", *LINE_PAIR, "l_shipdate"), "keyed")
    frames = {
        "lines": lines,
        "orders": orders,
        "joined": lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")),
        "customer": table(spark, sf, "customer"),
        "status": _status_domain(spark, STATUS),
        "history": store(customer_history(spark, sf), "history"),
    }
    return contracts.contract_gate(contracts.contracts_relation(spark, CONTRACTS), frames)


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


def carried(some: list) -> str:
    return ", ".join(
        f"({c.stage}, '{c.scope}', '{c.check}', '{','.join(c.grain)}', {_text(c.unit)}, "
        f"{_text(c.time_semantics)}, '{','.join(c.reads)}', '{c.rule_id}', '{c.disposition}')"
        for c in some
    )


CARRIED = carried(CONTRACTS)

ORACLE["vf_13"] = f"""WITH {JOINED}, {history_sql()},
pairs AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1),
early AS (SELECT record_key FROM joined WHERE l_shipdate < o_orderdate),
rows AS (
SELECT 1 AS stage, 'stage' AS scope, 'grain_pair' AS check, count(*) AS violations,
  min(concat_ws('|', l_orderkey, l_linenumber)) AS sample_key FROM pairs
UNION ALL SELECT 1, 'stage', 'grain_key', count(*), min(record_key)
  FROM (SELECT record_key FROM keyed GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 2, 'stage', 'domain', count(*), min(o_orderstatus) FROM (SELECT DISTINCT o_orderstatus
  FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O', 'P'))
UNION ALL SELECT 3, 'stage', 'fk', count(*), min(CAST(o_custkey AS VARCHAR)) FROM (SELECT DISTINCT o_custkey
  FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 3, 'stage', 'time', count(*), min(CAST(o_custkey AS VARCHAR)) FROM hist WHERE valid_from >= valid_to
UNION ALL SELECT 4, 'stage', 'cause', count(*), min(record_key) FROM early
UNION ALL SELECT 4, 'edge', 'keys', count(*), min(record_key) FROM (
  SELECT record_key FROM keyed EXCEPT SELECT record_key FROM joined))
SELECT rows.*, violations = 0 AS passed, grain, unit, time_semantics, evidence, rule_id,
  CASE WHEN violations = 0 THEN 'NONE' ELSE said END AS disposition
FROM rows JOIN (VALUES {CARRIED}) AS c(stage, scope, chk, grain, unit, time_semantics, evidence, rule_id, said)
  ON c.stage = rows.stage AND c.scope = rows.scope AND c.chk = rows.check"""

# One contract of every kind that the clean run has none of, on runs with faults in them.
FAULTY_CONTRACTS = [
    contracts.Contract(1, "stage", "unit", "unit", "valued", None, LINE, ("price", "unit", "p_retailprice"), "USD", None, "K1", "REJECT", (0.0, 120.0)),
    contracts.Contract(1, "stage", "schema", "schema", "lineitem", "target", LINE, LINE, None, None, "K2", "REJECT"),
    contracts.Contract(1, "edge", "rows", "rows", "raw", "accepted+quarantined", (), (), None, None, "K3", "REJECT"),
    contracts.Contract(1, "edge", "measure", "measure", "lines", "faulty", ("l_suppkey",), ("price",), "USD", None, "K4", "REJECT"),
    contracts.Contract(1, "edge", "equal", "equal", "lines", "faulty", LINE, LINE, "USD", None, "K5", "REVIEW"),
    contracts.Contract(4, "stage", "provenance", "provenance", "judged", "rules", LINE, ("rule_id", "disposition", "evidence"), None, None, "K6", "QUARANTINE"),
    contracts.Contract(5, "edge", "fanout", "fanout", "keyed", "fanned", LINE, LINE, None, None, "K7", "REJECT"),
    contracts.Contract(5, "edge", "keys", "keys", "keyed", "fanned", LINE, LINE, None, None, "K8", "REJECT"),
    contracts.Contract(5, "stage", "grain", "grain", "fanned", None, LINE, LINE, None, None, "K9", "REJECT"),
]


def vf_13_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The gate over runs with faults: unit, schema, rows, measure, equality, provenance and
    fan-out, all from the relation. Lines are joined and counted under keys of 16 bytes."""
    lines = priced_lines(spark, sf, short=True)
    keyed = some_lines(spark, sf, short=True).select("record_key", *LINE_PAIR)
    raw, accepted, quarantined = lossy_parse(spark, sf)
    frames = {
        "valued": valued_lines(spark, sf, short=True), "lineitem": table(spark, sf, "lineitem"),
        "target": spark.createDataFrame([], OTHER_LINES), "raw": raw, "accepted": accepted,
        "quarantined": quarantined, "lines": lines, "faulty": unit_fault(lines),
        "judged": damaged_verdicts(spark, sf, short=True), "rules": classify.rules_relation(spark, [*LINE_RULES, HOLE_RULE]),
        "keyed": keyed, "fanned": fanned_lines(keyed),
    }
    return contracts.contract_gate(contracts.contracts_relation(spark, FAULTY_CONTRACTS), frames)


def _counted(stage: int, scope: str, check: str, sql: str, sample: str) -> str:
    return f"SELECT {stage} AS stage, '{scope}' AS scope, '{check}' AS check, count(*) AS violations, {sample} AS sample_key FROM ({sql})"


KEY_SAMPLE = "min(record_key)"
ORACLE["vf_13_kinds"] = f"""WITH rows AS (
{_counted(1, 'stage', 'unit', ORACLE['vf_05'], KEY_SAMPLE)}
UNION ALL {_counted(1, 'stage', 'schema', ORACLE['vf_01'], 'CAST(NULL AS VARCHAR)')}
UNION ALL SELECT 1, 'edge', 'rows', lost, 'rows' FROM ({ORACLE['vf_08']})
UNION ALL {_counted(1, 'edge', 'measure', ORACLE['vf_09'], 'min(CAST(l_suppkey AS VARCHAR))')}
UNION ALL {_counted(1, 'edge', 'equal', ORACLE['vf_12'], KEY_SAMPLE)}
UNION ALL {_counted(4, 'stage', 'provenance', ORACLE['vf_07'], KEY_SAMPLE)}
UNION ALL {_counted(5, 'edge', 'fanout', ORACLE['vf_11'], KEY_SAMPLE)}
UNION ALL SELECT 5, 'edge', 'keys', 0, NULL
UNION ALL {_counted(5, 'stage', 'grain', ORACLE['vf_11'], KEY_SAMPLE)})
SELECT rows.*, violations = 0 AS passed, grain, unit, time_semantics, evidence, rule_id,
  CASE WHEN violations = 0 THEN 'NONE' ELSE said END AS disposition
FROM rows JOIN (VALUES {carried(FAULTY_CONTRACTS)}) AS c(stage, scope, chk, grain, unit, time_semantics, evidence, rule_id, said)
  ON c.stage = rows.stage AND c.scope = rows.scope AND c.chk = rows.check"""

QUERIES.update({n: f for n, f in list(globals().items()) if n.startswith("vf_")})
