"""The flagship and queries GV-01 to GV-13, each with its check SQL."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from plumbline.operators import classify, govern
from plumbline.operators.govern import ALL_FAULTS, CONTROL, RUN
from plumbline.operators.reference import lookup
from plumbline.operators.stages import close_over, own_divergence, rerun, run_stages
from plumbline.plans import arms, pipeline, raw_run, stages
from plumbline.plans.policy import FAULT, FAULTS, STATUS, line_policy
from plumbline.plans.queries_classify import M1, M2, RULED, SAID
from plumbline.plans.sql import JOINED, RULE, rule
from plumbline.plans.sql import history as history_sql
from plumbline.sources.relations import relation
from plumbline.sources.shared import store
from plumbline.sources.tables import table

QUERIES, ORACLE = {}, {}

QUERIES["flagship"] = pipeline.flagship
PLACED = f"""{RULED}, {history_sql()}, placed AS (
  SELECT r.*, coalesce(r_name, 'UNKNOWN') AS region, coalesce(h.o_orderpriority, 'UNKNOWN') AS priority,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price
  FROM ruled r LEFT JOIN hist h ON h.o_custkey = r.o_custkey
    AND h.valid_from <= l_shipdate AND l_shipdate < h.valid_to
  LEFT JOIN customer ON c_custkey = r.o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""
ORACLE["flagship"] = f"""WITH {PLACED} SELECT region, rule_id, priority, count(*) AS n_lines,
  CAST(sum(price) AS DOUBLE) AS amount FROM placed GROUP BY 1, 2, 3"""


QUERIES["raw_run"], ORACLE["raw_run"] = raw_run.raw_run, raw_run.RAW_RUN_SQL


def gv_01(spark: SparkSession, sf: str) -> DataFrame:
    parsed = pipeline.order_lines(spark, sf).withColumns(
        {"rule_id": F.lit("PARSE"), "disposition": F.lit("ACCEPTED")}
    )
    trailed = govern.with_provenance(parsed, "parse")
    judged = classify.classify(trailed.drop("rule_id", "disposition"), line_policy(spark))
    trail = F.transform(
        govern.TRAIL, lambda s: F.concat_ws(":", s["stage"], s["rule_id"], s["disposition"])
    )
    return govern.with_provenance(judged, "classify").select(
        "record_key", F.concat_ws(">", trail).alias("trail")
    )


ORACLE["gv_01"] = f"""WITH {RULED} SELECT record_key,
  'parse:PARSE:ACCEPTED>classify:' || rule_id || ':' || {SAID} AS trail FROM ruled"""

CEX = f"""{RULED}, sides AS (
  SELECT *, 'B1' AS boundary_id, rule_id = 'R1' AS inside FROM ruled
  UNION ALL SELECT *, 'B2', rule_id = 'R2' FROM ruled WHERE rule_id <> 'R1'
  UNION ALL SELECT *, 'B3', rule_id = 'R3' FROM ruled WHERE rule_id NOT IN ('R1', 'R2')
  UNION ALL SELECT *, 'B4', rule_id = 'R4' FROM ruled WHERE rule_id IN ('R4', 'HOLE')
  UNION ALL SELECT *, 'O12', true FROM ruled WHERE {M1} AND {M2}),
picked AS (SELECT *, boundary_id || CASE WHEN inside THEN '-in' ELSE '-out' END AS id FROM sides
  QUALIFY row_number() OVER (PARTITION BY boundary_id, inside ORDER BY record_key) = 1),
cex AS (
  SELECT id AS cex_id, boundary_id, rule_id AS expected_rule_id, o_orderdate + INTERVAL 365 DAY AS reviewed_at,
    CASE WHEN boundary_id = 'B4' AND NOT inside THEN 'PENDING' ELSE 'ACCEPTED' END AS status,
    record_key, l_shipdate, o_orderdate, l_returnflag, l_linestatus, l_discount FROM picked
  UNION ALL SELECT id || '-old', boundary_id, 'HOLE', o_orderdate,
    CASE WHEN boundary_id = 'B4' AND NOT inside THEN 'PENDING' ELSE 'ACCEPTED' END,
    record_key, l_shipdate, o_orderdate, l_returnflag, l_linestatus, l_discount FROM picked)"""


def gv_02(spark: SparkSession, sf: str) -> DataFrame:
    cex = arms.counterexamples(spark, sf)
    return govern.replay(cex, line_policy(spark, "next")).select(
        "cex_id", "boundary_id", "record_key", "expected_rule_id", "rule_id", "passed"
    )


ORACLE["gv_02"] = f"""WITH {CEX}, replayed AS (SELECT *, {rule(discount='0.07')} AS rule_id FROM cex)
SELECT cex_id, boundary_id, record_key, expected_rule_id, rule_id,
  rule_id = expected_rule_id AS passed FROM replayed"""


def gv_03(spark: SparkSession, sf: str) -> DataFrame:
    return govern.accepted(arms.counterexamples(spark, sf), ["record_key"]).select(
        "cex_id", "boundary_id", "record_key", "expected_rule_id"
    )


ACCEPTED = """SELECT * FROM cex WHERE status = 'ACCEPTED' QUALIFY row_number() OVER (
  PARTITION BY record_key ORDER BY reviewed_at DESC, cex_id DESC) = 1"""
ORACLE["gv_03"] = f"""WITH {CEX}
SELECT cex_id, boundary_id, record_key, expected_rule_id FROM ({ACCEPTED})"""


def gv_04(spark: SparkSession, sf: str) -> DataFrame:
    kept = govern.accepted(arms.counterexamples(spark, sf), ["record_key"])
    return govern.curate(kept).select("cex_id", "boundary_id", "record_key", "expected_rule_id")


ORACLE["gv_04"] = f"""WITH {CEX}, kept AS ({ACCEPTED})
SELECT cex_id, boundary_id, record_key, expected_rule_id FROM kept
QUALIFY row_number() OVER (PARTITION BY boundary_id ORDER BY reviewed_at, cex_id) = 1"""


def runs_sql(runs: list[str]) -> str:
    """CTEs of the faulted pipeline, ending in ``stages`` and ``six``."""
    on = lambda f: f"run IN ('{f}', 'ALL')"
    return f"""{JOINED}, {history_sql()},
runs AS (SELECT unnest([{', '.join(f"'{r}'" for r in runs)}]) AS run),
two AS (SELECT run, record_key, l_orderkey, l_linenumber, l_shipdate, o_orderdate, l_returnflag,
    l_linestatus, l_discount,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN {on('F1')} AND l_orderkey % 97 = 0
      THEN 100 ELSE 1 END AS DECIMAL(18,2)) AS price,
    CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_discount AS DECIMAL(4,2)) AS discount,
    CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'OPEN' WHEN 'P'
      THEN CASE WHEN {on('F2')} THEN 'FILLED' ELSE 'PENDING' END END AS status_meaning,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS raw_price, o_orderstatus AS code, o_custkey AS source_key,
    o_custkey + CASE WHEN {on('F3')} AND o_custkey % 50 = 0 THEN 1 ELSE 0 END AS customer_key
  FROM joined CROSS JOIN runs),
three AS (SELECT two.*, coalesce(o_orderpriority, 'UNKNOWN') AS priority,
    coalesce(l_shipdate >= valid_to, false) AS extra
  FROM two LEFT JOIN hist ON o_custkey = customer_key AND valid_from <= l_shipdate
    AND (l_shipdate < valid_to OR ({on('F4')} AND l_shipdate = valid_to))),
four AS (SELECT *, CASE WHEN {on('F5')} THEN {rule('R2', 'R1')} ELSE {RULE} END AS rule_id FROM three),
pairs AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2),
five AS (SELECT four.*, unnest(range(CASE WHEN {on('F6')} THEN n ELSE 1 END)) AS copy
  FROM four JOIN pairs USING (l_orderkey, l_linenumber)),
members AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS sk FROM customer),
six AS (SELECT five.*, coalesce(sk, -1) AS customer_sk FROM five LEFT JOIN members ON c_custkey = customer_key
  WHERE NOT ({on('F7')} AND priority = 'UNKNOWN')),
stages AS (
  SELECT run, record_key, 1 AS stage, md5(concat_ws('|', price, quantity, discount, l_shipdate)) AS d FROM two
  UNION ALL SELECT run, record_key, 2, md5(status_meaning) FROM two
  UNION ALL SELECT run, record_key, 3, md5(concat_ws('|', customer_key, priority)) FROM four
  UNION ALL SELECT run, record_key, 4, md5(rule_id) FROM four
  UNION ALL SELECT run, record_key, 5, md5(concat_ws('|', price, quantity, discount, l_shipdate,
    status_meaning, customer_key, priority, rule_id)) FROM five
  UNION ALL SELECT run, record_key, 6, md5(concat_ws('|', customer_sk, priority, rule_id, price)) FROM six),
digests AS (SELECT run, record_key, stage, md5(concat(count(*), ':', string_agg(d, ',' ORDER BY d))) AS d
  FROM stages GROUP BY 1, 2, 3),
pairs_of_runs AS (SELECT run, record_key, stage, d FROM digests WHERE run <> 'NONE'),
control AS (SELECT runs.run, record_key, stage, d FROM digests JOIN runs ON runs.run <> 'NONE'
  WHERE digests.run = 'NONE'),
first AS (SELECT run, record_key, min(stage) AS first_stage
  FROM pairs_of_runs a FULL JOIN control b USING (run, record_key, stage)
  WHERE a.d IS DISTINCT FROM b.d GROUP BY 1, 2)"""


def _all_faults(spark: SparkSession, sf: str, rule: Column | None = None, rules: Sequence[str] = ()) -> DataFrame:
    run = pipeline.governed_run(spark, sf, [ALL_FAULTS], paired=True, short=True)
    return pipeline.line_sums(run, rule, rules).where(F.col("first_stage").isNotNull())


def gv_05(spark: SparkSession, sf: str) -> DataFrame:
    """Every line-grain fault at once: each line is traced to the earliest."""
    return pipeline.long_keys(_all_faults(spark, sf))


ORACLE["gv_05"] = f"""WITH {runs_sql(['NONE', 'ALL'])}
SELECT record_key, CAST(first_stage AS INT) AS first_stage FROM first"""


def gv_05_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Every fault at once, each stage replayed on what it should have been given: a line is traced
    to every stage that fails it, behind whatever other fault."""
    reviewed = stages.pipeline_stages(spark, sf, paired=True)
    run = run_stages(stages.source(spark, sf, paired=True), reviewed, stages.KEPT)
    return own_divergence(stages.pipeline_stages(spark, sf, stages.ALL, paired=True), reviewed, run)


GROUPED = f"""{PLACED}, metrics AS (SELECT region || '|' || rule_id || '|' || priority AS record_key,
  CAST(CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*) AS DECIMAL(18,9)) AS mean,
  CAST(CAST(sum(price * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / CAST(sum(price) AS DOUBLE) AS DECIMAL(18,9)) AS weighted
  FROM placed GROUP BY region, rule_id, priority)"""
ORACLE["gv_05_replay"] = f"""WITH {GROUPED}
SELECT record_key, 1 AS stage_ord FROM placed WHERE l_orderkey % 97 = 0 AND price <> price * 100
UNION ALL SELECT record_key, 2 FROM placed WHERE o_orderstatus = 'P'
UNION ALL SELECT record_key, 3 FROM placed p WHERE o_custkey % 50 = 0 OR EXISTS (SELECT 1 FROM hist h
  WHERE h.o_custkey = p.o_custkey + CASE WHEN p.o_custkey % 50 = 0 THEN 1 ELSE 0 END AND h.valid_to = p.l_shipdate)
UNION ALL SELECT record_key, 4 FROM placed WHERE {M1} AND {M2}
UNION ALL SELECT record_key, 5 FROM placed JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2
  HAVING count(*) > 1) USING (l_orderkey, l_linenumber)
UNION ALL SELECT record_key, 6 FROM placed WHERE priority = 'UNKNOWN'
UNION ALL SELECT record_key, 7 FROM metrics WHERE mean <> weighted"""


def gv_06(spark: SparkSession, sf: str) -> DataFrame:
    """The rule of a line travels with what is compared of it: each key counts its lines by rule."""
    rules = line_policy(spark)
    names = [*dict.fromkeys([*[r.rule_id for r in rules], classify.HOLE])]
    wrong = _all_faults(spark, sf, classify.rule_of(rules), names)
    by_rule = [F.struct(F.lit(r).alias("rule_id"), F.col(f"lines_{n}").alias("n")) for n, r in enumerate(names)]
    entries = wrong.select("first_stage", F.inline(F.array(*by_rule))).where(F.col("n") > 0)
    return govern.blame(entries, weight=F.col("n"))


ORACLE["gv_06"] = f"""WITH {runs_sql(['NONE', 'ALL'])}, ruled AS (SELECT record_key, {RULE} AS rule_id FROM joined)
SELECT CAST(first_stage AS INT) AS first_stage, rule_id, count(*) AS n
FROM first JOIN ruled USING (record_key) GROUP BY 1, 2"""


def gv_07(spark: SparkSession, sf: str) -> DataFrame:
    diff = govern.policy_diff(pipeline.order_lines(spark, sf), line_policy(spark), line_policy(spark, "next"))
    return diff.select("record_key", "old_rule", "new_rule")


DIFF = f"""{JOINED}, judged AS (SELECT *, {RULE} AS old_rule, {rule(discount='0.07')} AS new_rule FROM joined),
diff AS (SELECT * FROM judged WHERE old_rule <> new_rule)"""
ORACLE["gv_07"] = f"WITH {DIFF} SELECT record_key, old_rule, new_rule FROM diff"


def gv_08(spark: SparkSession, sf: str) -> DataFrame:
    diff = govern.policy_diff(pipeline.order_lines(spark, sf), line_policy(spark), line_policy(spark, "next"))
    # The change was authorized to fill the hole, and nothing else.
    scope = (F.col("old_rule") == classify.HOLE) & (F.col("new_rule") == "R3")
    return govern.collateral(diff, scope).select("record_key", "old_rule", "new_rule")


ORACLE["gv_08"] = f"""WITH {DIFF} SELECT record_key, old_rule, new_rule FROM diff
WHERE NOT (old_rule = 'HOLE' AND new_rule = 'R3')"""


def gv_09(spark: SparkSession, sf: str) -> DataFrame:
    diff = govern.policy_diff(pipeline.order_lines(spark, sf), line_policy(spark), line_policy(spark, "next"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    reached = govern.affected(
        diff,
        "o_orderkey",
        [
            govern.Edge("customer", orders, "o_orderkey", "o_custkey"),
            govern.Edge("nation", customers, "c_custkey", "c_nationkey"),
        ],
    )
    levels = [
        keys.select(F.lit(name).alias("level"), F.col(keys.columns[0]).cast("bigint").alias("key"))
        for name, keys in reached.items()
    ]
    return levels[0].unionByName(levels[1])


ORACLE["gv_09"] = f"""WITH {DIFF}
SELECT DISTINCT 'customer' AS level, o_custkey AS key FROM diff
UNION ALL SELECT DISTINCT 'nation', CAST(c_nationkey AS BIGINT) FROM diff JOIN customer ON c_custkey = o_custkey"""

def _policy_change(spark: SparkSession, sf: str) -> tuple:
    """The recorded run under the old policy, the stages under the new one, and the condition on the lines
    whose rule the change moves."""
    before, after = line_policy(spark), line_policy(spark, "next")
    run = run_stages(stages.source(spark, sf), stages.pipeline_stages(spark, sf, rules=before), stages.KEPT)
    return run, stages.pipeline_stages(spark, sf, rules=after), govern.rule_moves(before, after)


def gv_09_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """What the policy change reaches in the stored outputs of stages 4 to 7, by recorded lineage."""
    run, changed, moved = _policy_change(spark, sf)
    out = None
    for number, keys in close_over(run, changed, 4, moved).items():
        keys = pipeline.long_keys(keys) if isinstance(keys.schema["record_key"].dataType, BinaryType) else keys
        level = keys.select(F.lit(number).alias("stage"), "record_key")
        out = level if out is None else out.unionByName(level)
    return out


ORACLE["gv_09_recorded"] = f"""WITH {PLACED}, moved AS (
  SELECT * FROM placed WHERE rule_id <> {rule(discount='0.07')})
SELECT stage::INT AS stage, record_key FROM moved CROSS JOIN range(4, 7) t(stage)
UNION ALL SELECT DISTINCT 7, region || '|' || rule_id || '|' || priority FROM moved"""


def gv_10(spark: SparkSession, sf: str) -> DataFrame:
    """The metric after the policy change, stages 4 to 7 recomputed for the lines it moves."""
    run, changed, moved = _policy_change(spark, sf)
    return rerun(run, changed, 4, moved).outputs[7].select(
        "region", "rule_id", "priority", "n_lines", F.col("amount").cast("double").alias("amount")
    )


NEXT = PLACED.replace(RULE, rule(discount="0.07"))
ORACLE["gv_10"] = f"""WITH {NEXT} SELECT region, rule_id, priority, count(*) AS n_lines,
  CAST(sum(price) AS DOUBLE) AS amount FROM placed GROUP BY 1, 2, 3"""


def gv_11(spark: SparkSession, sf: str) -> DataFrame:
    """Per stage the rows after the policy change, those by which the selective rerun differs from
    the full one, and those by which a rerun differs that forgets what rows move out of."""
    run, changed, moved = _policy_change(spark, sf)
    whole = dict(run.outputs)
    for stage in changed[3:]:
        out = stage.run(whole[stage.number - 1])
        whole[stage.number] = store(out, f"full-{stage.number}") if stage.number in run.keep else out
    selective = rerun(run, changed, 4, moved)
    forgetful = rerun(replace(run, lineage={n: rows.limit(0) for n, rows in run.lineage.items()}), changed, 4, moved)
    out = None
    for number in range(4, 8):
        others = {"differing": selective.outputs[number], "missed": forgetful.outputs[number]}
        row = govern.count_differences(whole[number], others).select(F.lit(number).alias("stage"), "rows", *others)
        out = row if out is None else out.unionByName(row)
    return out


def _groups(rule_column: str) -> str:
    return f"""SELECT region, {rule_column} AS rule_id, priority, count(*) AS n, sum(price) AS amount,
    CAST(CAST(sum(price * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / CAST(sum(price) AS DOUBLE) AS DECIMAL(18,9)) AS discount
  FROM both_rules GROUP BY 1, 2, 3"""


ORACLE["gv_11"] = f"""WITH {PLACED}, both_rules AS (SELECT *, {rule(discount='0.07')} AS new_rule FROM placed),
before AS ({_groups('rule_id')}), after AS ({_groups('new_rule')}),
entered AS (SELECT DISTINCT region, new_rule AS rule_id, priority FROM both_rules WHERE rule_id <> new_rule),
forgetful AS (SELECT * FROM before ANTI JOIN entered USING (region, rule_id, priority)
  UNION ALL SELECT * FROM after SEMI JOIN entered USING (region, rule_id, priority)),
missed AS (SELECT * FROM (SELECT * FROM forgetful EXCEPT ALL SELECT * FROM after)
  UNION ALL SELECT * FROM (SELECT * FROM after EXCEPT ALL SELECT * FROM forgetful))
SELECT stage::INT AS stage, (SELECT count(*) FROM both_rules) AS rows, 0::BIGINT AS differing, 0::BIGINT AS missed
FROM range(4, 7) t(stage)
UNION ALL SELECT 7, (SELECT count(*) FROM after), 0, (SELECT count(*) FROM missed)"""


def gv_12(spark: SparkSession, sf: str) -> DataFrame:
    faults = relation(spark, "run string, fault_stage int", [(f.fault_id, f.stage) for f in FAULTS])
    return govern.compare_arms(arms.findings(spark, sf), faults)


RUNS = [CONTROL, *[f.fault_id for f in FAULTS]]
IDS = "('R1', 'R2', 'R3', 'R4', 'HOLE')"
BAD_STATUS = "status_meaning NOT IN ('FILLED', 'OPEN', 'PENDING')"


def _grain(arm: str, stage: int, check: str, source: str, key: str) -> str:
    return f"""UNION ALL SELECT run, '{arm}', {stage}, '{check}', count(*) FILTER (n > 1)
  FROM (SELECT run, count(*) AS n FROM {source} GROUP BY run, {key}) GROUP BY run"""


_CEX_FOR_ARMS = CEX[len(JOINED):].lstrip(", ")
ORACLE["gv_12"] = f"""WITH {runs_sql(RUNS)}, {_CEX_FOR_ARMS},
groups AS (SELECT run, coalesce(r_name, 'UNKNOWN') AS region, rule_id, priority,
    CASE WHEN run = 'F8' THEN CAST(sum(discount) AS DOUBLE) / count(*)
      ELSE CAST(sum(price * discount) AS DOUBLE) / CAST(sum(price) AS DOUBLE) END AS discount
  FROM six LEFT JOIN customer ON c_custkey = customer_key LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY run, r_name, rule_id, priority),
own AS (SELECT count(*) AS n FROM (SELECT rule_id, priority, r_name FROM six
    LEFT JOIN customer ON c_custkey = customer_key LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey WHERE run = 'NONE' GROUP BY ALL
    HAVING CAST(CAST(sum(discount) AS DOUBLE) / count(*) AS DECIMAL(18,9))
      <> CAST(CAST(sum(price * discount) AS DOUBLE) / CAST(sum(price) AS DOUBLE) AS DECIMAL(18,9)))),
kept AS ({ACCEPTED}),
kept_rows AS (SELECT * FROM (SELECT run, record_key, count(*) AS n4 FROM four GROUP BY ALL)
  JOIN (SELECT run, record_key, count(*) AS n5 FROM five GROUP BY ALL) USING (run, record_key)
  LEFT JOIN (SELECT run, record_key, count(*) AS n6 FROM six GROUP BY ALL) USING (run, record_key)),
replayed AS (SELECT run, expected_rule_id,
    CASE WHEN run = 'F5' THEN {rule('R2', 'R1')} ELSE {RULE} END AS got FROM kept CROSS JOIN runs),
findings AS (
SELECT run, 'native' AS arm, 1 AS stage, 'not_null' AS chk,
  count(*) FILTER (price IS NULL OR quantity IS NULL OR l_shipdate IS NULL) AS n FROM two GROUP BY run
UNION ALL SELECT run, 'native', 2, 'accepted_values', count(*) FILTER ({BAD_STATUS}) FROM two GROUP BY run
UNION ALL SELECT run, 'native', 6, 'relationship', count(*) FILTER (customer_sk = -1) FROM six GROUP BY run
{_grain('native', 5, 'unique_key', 'five', 'record_key')}
{_grain('native', 5, 'unique_pair', 'five', 'l_orderkey, l_linenumber')}
{_grain('native', 6, 'unique_key', 'six', 'record_key')}
UNION ALL SELECT run, 'stage', 1, 'unit', count(*) FILTER (price > 105000) FROM two GROUP BY run
UNION ALL SELECT run, 'stage', 2, 'domain', count(*) FILTER ({BAD_STATUS}) FROM two GROUP BY run
UNION ALL SELECT run, 'stage', 3, 'time', count(*) FILTER (extra) FROM three GROUP BY run
UNION ALL SELECT run, 'stage', 4, 'cause', count(*) FILTER ({M1}) FROM two GROUP BY run
UNION ALL SELECT run, 'stage', 4, 'provenance', count(*) FILTER (rule_id NOT IN {IDS}) FROM four GROUP BY run
UNION ALL SELECT run, 'stage', 4, 'replay', count(*) FILTER (got <> expected_rule_id) FROM replayed GROUP BY run
UNION ALL SELECT run, 'stage', 7, 'range', count(*) FILTER (discount NOT BETWEEN 0 AND 0.1) FROM groups GROUP BY run
{_grain('stage', 3, 'grain', 'three', 'record_key')}
{_grain('stage', 5, 'grain', 'five', 'record_key')}
{_grain('stage', 6, 'grain', 'six', 'record_key')}
UNION ALL SELECT run, 'composed', 1, 'source_price', count(*) FILTER (price <> raw_price) FROM two GROUP BY run
UNION ALL SELECT run, 'composed', 2, 'source_meaning', count(*) FILTER (status_meaning <> CASE code
  WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'OPEN' ELSE 'PENDING' END) FROM two GROUP BY run
UNION ALL SELECT run, 'composed', 3, 'source_key', count(*) FILTER (customer_key <> source_key) FROM two GROUP BY run
{_grain('composed', 3, 'fanout', 'three', 'record_key')}
UNION ALL SELECT run, 'composed', 4, 'replay', count(*) FILTER (got <> expected_rule_id) FROM replayed GROUP BY run
UNION ALL SELECT run, 'composed', 5, 'fanout', count(*) FILTER (n5 > n4) FROM kept_rows GROUP BY run
UNION ALL SELECT run, 'composed', 6, 'lost', count(*) FILTER (coalesce(n6, 0) < n5) FROM kept_rows GROUP BY run
UNION ALL SELECT run, 'composed', 7, 'definition', CASE WHEN run = 'F8' THEN (SELECT n FROM own) ELSE 0 END FROM runs
UNION ALL SELECT runs.run, 'ideal', s, 'first_divergence', (SELECT count(*) FROM first
  WHERE first.run = runs.run AND first_stage = s)
  + CASE WHEN runs.run = 'F8' AND s = 7 THEN (SELECT n FROM own) ELSE 0 END
  FROM runs CROSS JOIN range(1, 8) t(s)),
faults AS (SELECT * FROM (VALUES {', '.join(f"('{f.fault_id}', {f.stage})" for f in FAULTS)}) t(run, fault_stage)),
compared AS (SELECT f.run, fault_stage, f.arm, f.stage, abs(f.n - c.n) AS change, c.n AS base
  FROM findings f JOIN findings c ON c.run = 'NONE' AND c.arm = f.arm AND c.stage = f.stage AND c.chk = f.chk
  JOIN faults ON faults.run = f.run),
summed AS (SELECT run AS fault, fault_stage, arm, min(stage) FILTER (change > 0) AS hit,
  CAST(sum(base) AS BIGINT) AS false_alarms,
  CAST(coalesce(sum(change) FILTER (stage <> fault_stage), 0) AS BIGINT) AS collateral
  FROM compared GROUP BY 1, 2, 3)
SELECT fault, CAST(fault_stage AS INT) AS fault_stage, arm, hit IS NOT NULL AS detected,
  coalesce(hit = fault_stage, false) AS located, CAST(coalesce(hit, -1) AS INT) AS first_stage,
  false_alarms, collateral FROM summed"""


def gv_13(spark: SparkSession, sf: str) -> DataFrame:
    clean = pipeline.order_lines(spark, sf).select(
        F.lit(ALL_FAULTS).alias(RUN), "record_key", "l_orderkey", "o_orderstatus",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        lookup(STATUS, "o_orderstatus").alias("status_meaning"),
        F.col("o_custkey").alias("customer_key"),
    )
    for name in ("F1", "F2", "F3"):
        clean = govern.inject(clean, FAULT[name])
    return clean.select(
        "record_key", F.col("price").cast("double").alias("price"), "status_meaning", "customer_key"
    )


ORACLE["gv_13"] = f"""WITH {runs_sql(['ALL'])}
SELECT record_key, CAST(price AS DOUBLE) AS price, status_meaning, customer_key FROM two"""

QUERIES.update({n: f for n, f in list(globals().items()) if n.startswith("gv_")})
