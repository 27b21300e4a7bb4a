"""Counts measured beforehand on the given tables (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import classify, govern, history
from plumbline.plans import arms, pipeline
from plumbline.plans.policy import EVENT_RULES, LINE_RULES, LINE_RULES_SWAPPED
from plumbline.plans.queries_history import day_versions
from plumbline.plans.registry import QUERIES
from plumbline.sources.shared import cut_lineage
from plumbline.sources.tables import table

COUNTS = {"ih_05": 1226, "ih_12": 148, "ih_14": 1226, "df_04": 1500, "wm_05": 2557, "flagship": 130}


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_row_count(spark, sf, name):
    assert QUERIES[name](spark, sf).count() == COUNTS[name]


def test_customer_days_and_current_versions(spark, sf):
    assert day_versions(spark, sf).count() == 1499
    assert pipeline.customer_history(spark, sf).where("is_current").count() == 150


def test_lines_with_a_version(spark, sf):
    known = QUERIES["ih_10"](spark, sf).groupBy((F.col("priority") == "UNKNOWN").alias("u")).count()
    assert {r["u"]: r["count"] for r in known.collect()} == {False: 5526, True: 474}


def test_rule_counts(spark, sf):
    rows = QUERIES["ec_05"](spark, sf).collect()
    assert {r["rule_id"]: (r["matched"], r["won"]) for r in rows} == {
        "R1": (2815, 2815), "R2": (1001, 545), "R3": (1482, 663), "R4": (2070, 788),
    }
    assert QUERIES["ec_02"](spark, sf).count() == 1189
    assert classify.conflicts(pipeline.order_lines(spark, sf), LINE_RULES).count() == 2226
    # Where R1 and R2 say the same, lines that only these two match are no conflict.
    assert QUERIES["ec_04"](spark, sf).count() == 1865


def test_event_hole(spark, sf):
    assert classify.holes(table(spark, sf, "events"), EVENT_RULES).count() == 517


def test_policy_diff_counts(spark, sf):
    moves = QUERIES["gv_07"](spark, sf).groupBy("old_rule", "new_rule").count().collect()
    assert {(r[0], r[1]): r[2] for r in moves} == {("HOLE", "R3"): 164, ("R4", "R3"): 118}
    assert QUERIES["gv_08"](spark, sf).count() == 118


def test_transitions(spark, sf):
    rows = QUERIES["ec_08"](spark, sf).groupBy("rule_id").count().collect()
    counts = {r["rule_id"]: r["count"] for r in rows}
    assert (counts["T1"], counts["T2"]) == (40, 195)


LINE_FAULTS = {
    "F1": (1, 67), "F2": (2, 1933), "F3": (3, 114), "F4": (3, 16), "F5": (4, 456), "F7": (6, 474),
}


@pytest.fixture(scope="module")
def digests(spark, sf):
    runs = [govern.CONTROL, *[f"F{i}" for i in range(1, 8)]]
    return cut_lineage(pipeline.line_digests(pipeline.governed_run(spark, sf, runs)))


def test_each_fault_is_located_at_its_stage(digests):
    faults = [f"F{i}" for i in range(1, 8)]
    first = govern.first_run_divergence(digests, ["record_key"], faults)
    found = first.groupBy("run", "first_stage").count().collect()
    by_fault = {r["run"]: (r["first_stage"], r["count"]) for r in found}
    assert len(found) == 7
    assert by_fault.pop("F6")[0] == 5
    assert by_fault == LINE_FAULTS


@pytest.mark.parametrize("fault", ["F4", "F6", "F7"])
def test_two_relations_and_one_relation_of_runs_agree(digests, fault):
    long = govern.stage_digests(digests, ["run", "record_key"])
    actual = long.where(F.col("run") == fault).drop("run")
    expected = long.where(F.col("run") == govern.CONTROL).drop("run")
    two = govern.first_divergence(actual, expected, ["record_key"])
    one = govern.first_run_divergence(digests, ["record_key"], [fault]).drop("run")
    assert two.exceptAll(one.select(*two.columns)).isEmpty()
    assert one.count() == two.count() > 0


def test_fan_out_size(spark, sf):
    run = pipeline.governed_run(spark, sf, ["F6"])
    assert run.count() == 9368


def test_arms(spark, sf):
    rows = {(r["fault"], r["arm"]): r for r in QUERIES["gv_12"](spark, sf).collect()}
    assert len(rows) == 32
    for (fault, arm), r in rows.items():
        if arm == "ideal":
            assert r["detected"] and r["located"], fault
            assert r["false_alarms"] == 0 and r["collateral"] == 0
    assert not rows["F2", "native"]["detected"] and not rows["F2", "stage"]["detected"]
    assert rows["F6", "stage"]["located"] and rows["F1", "stage"]["located"]


def test_accepted_counterexamples_pass(spark, sf):
    kept = govern.accepted(arms.counterexamples(spark, sf), ["record_key"])
    assert kept.count() == 5
    assert govern.replay(kept, LINE_RULES).where(~F.col("passed")).isEmpty()
    failing = govern.replay(kept, LINE_RULES_SWAPPED).where(~F.col("passed"))
    assert "O12-in" in {r["cex_id"] for r in failing.collect()}


def test_backdating_does_not_depend_on_order(spark, sf):
    full = QUERIES["ih_05"](spark, sf)
    for name in ("ih_06", "ih_09"):
        assert QUERIES[name](spark, sf).exceptAll(full).isEmpty()


def test_coalescing_is_idempotent(spark, sf):
    once = history.coalesce_history(day_versions(spark, sf), ["o_custkey"], ["o_orderpriority"])
    twice = history.coalesce_history(once, ["o_custkey"], ["o_orderpriority"])
    assert once.exceptAll(twice).isEmpty() and once.count() == twice.count()
