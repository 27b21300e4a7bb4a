"""Queries EC-01 to EC-09, each with its check SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import classify
from plumbline.operators.rule_index import classify_indexed
from plumbline.plans.pipeline import keyed_lines, long_keys, order_lines, short_keys
from plumbline.plans.policy import EVENT_TYPES, line_policy
from plumbline.plans.sql import JOINED, KEYED, RULE
from plumbline.sources.relations import relation
from plumbline.sources.tables import table

QUERIES, ORACLE = {}, {}

SAID = """CASE rule_id WHEN 'R1' THEN 'REJECT' WHEN 'R2' THEN 'REVIEW' WHEN 'R3' THEN 'DISCOUNT'
  WHEN 'R4' THEN 'ACCEPT' ELSE 'UNDECIDED' END"""
RULED = f"{JOINED}, ruled AS (SELECT *, {RULE} AS rule_id FROM joined)"
M1, M2 = "l_shipdate < o_orderdate", "(l_returnflag = 'R' AND l_linestatus = 'O')"
M3, M4 = "l_discount >= 0.08", "l_returnflag = 'N'"
MATCHED = f"""concat_ws(',', CASE WHEN {M1} THEN 'R1' END, CASE WHEN {M2} THEN 'R2' END,
  CASE WHEN {M3} THEN 'R3' END, CASE WHEN {M4} THEN 'R4' END)"""


def _evidence_text():
    return F.concat_ws(
        ";",
        F.transform(
            F.map_entries("evidence"), lambda e: F.concat_ws("=", e["key"], e["value"])
        ),
    ).alias("evidence")


def ec_01(spark: SparkSession, sf: str) -> DataFrame:
    return classify.classify(order_lines(spark, sf), line_policy(spark)).select(
        "record_key", "rule_id", "disposition", _evidence_text()
    )


ORACLE["ec_01"] = f"""WITH {RULED} SELECT record_key, rule_id, {SAID} AS disposition,
CASE rule_id WHEN 'R1' THEN 'l_shipdate=' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')
    || ';o_orderdate=' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
  WHEN 'R2' THEN 'l_returnflag=' || l_returnflag || ';l_linestatus=' || l_linestatus
  WHEN 'R3' THEN 'l_discount=' || CAST(l_discount AS VARCHAR)
  WHEN 'R4' THEN 'l_returnflag=' || l_returnflag ELSE '' END AS evidence FROM ruled"""


def part_policy(spark: SparkSession, sf: str) -> DataFrame:
    """A policy of one rule per part and one per supplier: small quantities of a part, of parts of odd
    size only where the line was returned; then whatever else a supplier got back."""
    odd = F.when(F.col("p_size") % 2 == 1, F.array(F.lit("returned"))).otherwise(F.array().cast("array<string>"))
    text = lambda c: F.col(c).cast("string")
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("P"), "p_partkey").alias("rule_id"), F.col("p_partkey").alias("ord"), F.lit("SMALL").alias("disposition"),
        F.create_map(F.lit("l_partkey"), text("p_partkey")).alias("equals"), F.lit("l_quantity").alias("ranged"),
        F.lit(0.0).alias("lo"), F.col("p_size").cast("double").alias("hi"), odd.alias("tests"),
    )
    back = F.create_map(F.lit("l_suppkey"), text("s_suppkey"), F.lit("l_returnflag"), F.lit("R"))
    nothing = F.lit(None).cast("double")
    suppliers = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("rule_id"), (F.col("s_suppkey") + (1 << 40)).alias("ord"),
        F.lit("BACK").alias("disposition"), back.alias("equals"), F.lit(None).cast("string").alias("ranged"),
        nothing.alias("lo"), nothing.alias("hi"), F.array().cast("array<string>").alias("tests"),
    )
    return parts.unionByName(suppliers)


def ec_01_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """A policy too long for one expression."""
    lines = short_keys(keyed_lines(spark, sf)).select("record_key", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    judged = classify_indexed(lines, ["record_key"], part_policy(spark, sf), {"returned": "l_returnflag = 'R'"})
    return long_keys(judged).select("record_key", "rule_id", "disposition", F.size("evidence").alias("n_evidence"))


ORACLE["ec_01_indexed"] = f"""WITH {KEYED}, judged AS (SELECT record_key, CASE
    WHEN l_quantity >= 0 AND l_quantity < p_size AND (p_size % 2 = 0 OR l_returnflag = 'R') THEN 'P' || l_partkey
    WHEN l_returnflag = 'R' THEN 'S' || l_suppkey ELSE 'HOLE' END AS rule_id
  FROM keyed JOIN part ON p_partkey = l_partkey)
SELECT record_key, rule_id, CASE left(rule_id, 1) WHEN 'P' THEN 'SMALL' WHEN 'S' THEN 'BACK' ELSE 'UNDECIDED' END AS disposition,
  CASE WHEN rule_id = 'HOLE' THEN 0 ELSE 2 END AS n_evidence FROM judged"""


def ec_02(spark: SparkSession, sf: str) -> DataFrame:
    return classify.holes(order_lines(spark, sf), line_policy(spark)).select("record_key", "rule_id")


ORACLE["ec_02"] = f"WITH {RULED} SELECT record_key, rule_id FROM ruled WHERE rule_id = 'HOLE'"


def ec_03(spark: SparkSession, sf: str) -> DataFrame:
    return classify.matches(order_lines(spark, sf), line_policy(spark)).select(
        "record_key", F.concat_ws(",", "matched").alias("matched")
    )


ORACLE["ec_03"] = f"WITH {JOINED} SELECT record_key, {MATCHED} AS matched FROM joined"


# A policy in which R1 and R2 say the same: lines that only these two match are no conflict.
def agreeing(rules: list[classify.Rule]) -> list[classify.Rule]:
    return [replace(r, disposition="REJECT") if r.rule_id == "R2" else r for r in rules]


def ec_04(spark: SparkSession, sf: str) -> DataFrame:
    return classify.conflicts(order_lines(spark, sf), agreeing(line_policy(spark))).select(
        "record_key", F.concat_ws(",", "matched").alias("matched")
    )


ORACLE["ec_04"] = f"""WITH {JOINED} SELECT record_key, {MATCHED} AS matched FROM joined
WHERE CAST(({M1} OR {M2}) AS INT) + CAST({M3} AS INT) + CAST({M4} AS INT) > 1"""


def ec_05(spark: SparkSession, sf: str) -> DataFrame:
    return classify.coverage(order_lines(spark, sf), line_policy(spark))


ORACLE["ec_05"] = f"""WITH {RULED}, seen AS (
  SELECT 'R1' AS rule_id, count(*) FILTER ({M1}) AS matched FROM ruled
  UNION ALL SELECT 'R2', count(*) FILTER ({M2}) FROM ruled
  UNION ALL SELECT 'R3', count(*) FILTER ({M3}) FROM ruled
  UNION ALL SELECT 'R4', count(*) FILTER ({M4}) FROM ruled),
won AS (SELECT rule_id, count(*) AS won FROM ruled GROUP BY 1)
SELECT rule_id, matched, coalesce(won, 0) AS won, matched - coalesce(won, 0) AS shadowed
FROM seen LEFT JOIN won USING (rule_id)"""


def ec_06(spark: SparkSession, sf: str) -> DataFrame:
    return classify.classify_by_authority(order_lines(spark, sf), line_policy(spark)).select(
        "record_key", "rule_id", "disposition"
    )


ORACLE["ec_06"] = f"""WITH {JOINED}, ruled AS (SELECT *, CASE WHEN {M3} THEN 'R3'
  WHEN {M1} THEN 'R1' WHEN {M2} THEN 'R2' WHEN {M4} THEN 'R4' ELSE 'HOLE' END AS rule_id FROM joined)
SELECT record_key, rule_id, {SAID} AS disposition FROM ruled"""


def ec_07(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    # One rule per part that is not ECONOMY; lower part keys come first.
    rules = part.where(F.col("p_type") != "ECONOMY").select(
        "p_brand",
        "p_type",
        F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("rule_id"),
        F.col("p_partkey").alias("ord"),
        F.when(F.col("p_size") > 25, "BULK").otherwise("PARCEL").alias("disposition"),
    )
    lines = keyed_lines(spark, sf).join(
        part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")
    )
    return classify.classify_join(lines, rules, ["p_brand", "p_type"]).select(
        "record_key", "rule_id", "disposition"
    )


ORACLE["ec_07"] = f"""WITH {KEYED}, firsts AS (SELECT * FROM part WHERE p_type <> 'ECONOMY'
  QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1)
SELECT record_key,
  coalesce(f.p_brand || '/' || f.p_type || '/' || CAST(f.p_size AS VARCHAR), 'HOLE') AS rule_id,
  CASE WHEN f.p_size IS NULL THEN 'UNDECIDED' WHEN f.p_size > 25 THEN 'BULK' ELSE 'PARCEL' END
    AS disposition
FROM keyed JOIN part p ON l_partkey = p.p_partkey
LEFT JOIN firsts f ON f.p_brand = p.p_brand AND f.p_type = p.p_type"""


def transitions(spark: SparkSession) -> DataFrame:
    """A purchase straight after an error and a repeated signup are illegal; a
    first view or click is legal, other first events are a hole."""
    rows = []
    for prior in [classify.START, *EVENT_TYPES]:
        for current in EVENT_TYPES:
            if prior == classify.START:
                if current in ("view", "click", "signup"):
                    rows.append((prior, current, "T0", "LEGAL"))
            elif current == "signup":
                rows.append((prior, current, "T2", "ILLEGAL"))
            elif (prior, current) == ("error", "purchase"):
                rows.append((prior, current, "T1", "ILLEGAL"))
            else:
                rows.append((prior, current, "T0", "LEGAL"))
    return relation(spark, "prior string, current string, rule_id string, disposition string", rows)


def ec_08(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return classify.classify_transition(
        events, ["user_id"], ["ts", "event_id"], "event_type", transitions(spark)
    ).select("event_id", "user_id", "prior", "event_type", "rule_id", "disposition")


ORACLE["ec_08"] = """WITH chained AS (SELECT event_id, user_id, event_type,
  coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'START') AS prior FROM events),
ruled AS (SELECT *, CASE WHEN prior = 'START' AND event_type IN ('view', 'click', 'signup') THEN 'T0'
  WHEN prior = 'START' THEN 'HOLE' WHEN event_type = 'signup' THEN 'T2'
  WHEN prior = 'error' AND event_type = 'purchase' THEN 'T1' ELSE 'T0' END AS rule_id FROM chained)
SELECT *, CASE rule_id WHEN 'T0' THEN 'LEGAL' WHEN 'HOLE' THEN 'UNDECIDED' ELSE 'ILLEGAL' END
  AS disposition FROM ruled"""


def ec_09(spark: SparkSession, sf: str) -> DataFrame:
    dims = ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority"]
    return classify.hole_profile(order_lines(spark, sf), line_policy(spark), dims, k=10)


ORACLE["ec_09"] = f"""WITH {RULED}
SELECT l_returnflag, l_linestatus, o_orderstatus, o_orderpriority, count(*) AS n FROM ruled
WHERE rule_id = 'HOLE' GROUP BY 1, 2, 3, 4
ORDER BY n DESC, l_returnflag, l_linestatus, o_orderstatus, o_orderpriority LIMIT 10"""

QUERIES.update({n: f for n, f in list(globals().items()) if n.startswith("ec_")})
