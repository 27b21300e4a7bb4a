"""What the comparisons of runs hand to their shuffles."""

from pyspark.sql import functions as F

from plumbline.operators import stages
from plumbline.operators.govern import ALL_FAULTS, count_differences, surplus_divergence
from plumbline.operators.stages import Stage
from plumbline.plans import arms, pipeline
from plumbline.plans.registry import QUERIES
from tests.test_queries import plan


def test_only_changed_outputs_are_compared(spark, sf):
    """gv_05: no row carries the digests of all stages, and lines without a fault hand on nothing."""
    assert "digests" not in plan(QUERIES["gv_05"](spark, sf))
    changes = pipeline.line_changes(pipeline.governed_run(spark, sf, [ALL_FAULTS], paired=True))
    wrong = {r.record_key for r in QUERIES["gv_05"](spark, sf).collect()}
    assert {r.record_key for r in changes.select("record_key").distinct().collect()} == wrong
    # Both runs together have twelve stage outputs a line at least.
    assert changes.count() < pipeline.order_lines(spark, sf).count() * 12 / 3


def test_blame_compares_changed_outputs_only(spark, sf):
    assert "digests" not in plan(QUERIES["gv_06"](spark, sf))


def test_blame_carries_the_rule_with_the_line(spark, sf):
    """gv_06: lines are joined with orders once, under keys of 16 bytes, and each key is summed in one row."""
    text = plan(QUERIES["gv_06"](spark, sf))
    assert text.count("unhex") > 0 and "stage_ord" not in text
    run = pipeline.governed_run(spark, sf, [ALL_FAULTS], paired=True, short=True)
    # One row for a line, but for repeats and second versions; not one for each of its changed outputs.
    sums = pipeline.line_sums(run, F.lit("R"), ["R"])
    assert sums.count() == sums.agg(F.sum("lines_0")).first()[0] == pipeline.order_lines(spark, sf).count()


def test_sums_tell_bags_apart(spark, sf):
    """A key whose rows trade outputs has the same bag; one with a row more or less has not."""
    run = pipeline.governed_run(spark, sf, [ALL_FAULTS], paired=True)
    row = run.where("customer_key = o_custkey AND copy = 1 AND NOT extra AND priority <> 'UNKNOWN' AND price = raw_price"
                    " AND o_orderstatus <> 'P' AND NOT (l_returnflag = 'R' AND l_linestatus = 'O') AND _pairs = 1").limit(1)
    kept = spark.createDataFrame(row.collect(), run.schema)
    again = kept.withColumns({"price": F.col("price") * 2, "raw_price": F.col("raw_price")})
    other = kept.withColumns({"raw_price": F.col("raw_price") * 2})
    first = lambda df: [r.first_stage for r in pipeline.line_sums(df).collect()]
    assert first(kept) == first(again.unionByName(other)) == [None]
    assert first(again) == [1] and first(kept.unionByName(kept.withColumn("copy", F.lit(2).cast("bigint")))) == [5]


def test_arms_group_lines_by_short_keys(spark, sf, monkeypatch):
    """gv_12: the runs are stored with keys of 16 bytes, and each line's sides cancel before the shuffle."""
    stored, handed = {}, []
    real_store, real_changes = arms.store, arms.line_changes
    monkeypatch.setattr(arms, "store", lambda df, name: stored.setdefault(name, real_store(df, name)))
    monkeypatch.setattr(arms, "line_changes", lambda *a: handed.append(real_changes(*a)) or handed[-1])
    arms.findings(spark, sf)
    assert stored["runs"].schema["record_key"].dataType.simpleString() == "binary"
    # Unchanged stages of a line are not handed on: F2 leaves stages 1, 3, 4 and 6 as they were.
    stages = {r.stage_ord for r in handed[0].where("run = 'F2'").select("stage_ord").distinct().collect()}
    assert stages == {2, 5}


def test_rows_of_one_key_that_trade_outputs_do_not_diverge(spark):
    rows = [("a", 1, "x", 1), ("a", 1, "x", -1), ("b", 2, "x", 1), ("b", 2, "y", -1), ("c", 3, "x", 2), ("c", 3, "x", -1)]
    changes = spark.createDataFrame(rows, "record_key string, stage_ord int, digest string, surplus long")
    got = surplus_divergence(changes, ["record_key"]).orderBy(F.col("record_key"))
    assert [tuple(r) for r in got.collect()] == [("b", 2), ("c", 3)]


def test_differences_are_counted_in_one_pass(spark, sf):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    full = rows(("a", 1), ("a", 1), ("b", None), ("c", 3))
    others = {"same": rows(("c", 3), ("b", None), ("a", 1), ("a", 1)), "other": rows(("a", 1), ("b", None), ("d", 4))}
    assert tuple(count_differences(full, others).first()) == (4, 0, 3)
    assert tuple(count_differences(full.limit(0), {"other": full}).first()) == (0, 3)
    # gv_11: rows travel as fingerprints, and the full run is counted once for both reruns.
    text = plan(QUERIES["gv_11"](spark, sf))
    assert "_a#" in text and "_r_record_key" not in text and text.count("Subquery") == 0


def test_stages_of_single_rows_hand_on_what_differs(spark):
    """gv_05_replay: both sides of such a stage meet in the row, not in a shuffle."""
    handed = []
    stage = lambda n: Stage(1, "scale", lambda df: df.withColumn("v", F.when(F.col("v") > 2, F.col("v") * n).otherwise(F.col("v"))), ("v",), single=True)
    source = spark.createDataFrame([("a", 1), ("b", None), ("c", 3), ("c", 3)], "record_key string, v long")
    keep = stages.surplus_divergence
    try:
        stages.surplus_divergence = lambda rows, key: handed.append(rows) or keep(rows, key)
        got = stages.own_divergence([stage(2)], [stage(1)], stages.run_stages(source, [stage(1)]))
    finally:
        stages.surplus_divergence = keep
    assert [tuple(r) for r in got.collect()] == [("c", 1)]
    assert handed[0].count() == 4
