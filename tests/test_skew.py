"""Hot keys: one key holds a third of all rows, and the split forms must equal plain ones."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.timeline import SLICE, Timeline
from plumbline.operators import classify, facts, history, intervals, reference
from plumbline.plans.queries_classify import transitions
from plumbline.sources.tables import table

HOT = 40


@pytest.fixture(scope="module")
def log(spark, sf):
    """Orders of which a third belong to customer 1."""
    return table(spark, sf, "orders").withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(F.col("o_custkey"))
    ).cache()


def equal(a, b):
    b = b.select(*a.columns)
    assert a.count() == b.count()
    assert a.exceptAll(b).isEmpty()


def test_a_hot_key_is_split(log):
    timeline = Timeline(log, ["o_custkey"], ["o_orderdate", "o_orderkey"], HOT)
    sizes = timeline.frame.groupBy("o_custkey", SLICE).count()
    assert sizes.where("o_custkey = 1").count() > 10
    assert sizes.where("o_custkey <> 1").groupBy("o_custkey").count().where("count > 1").isEmpty()
    assert sizes.agg(F.max("count")).first()[0] <= HOT


ORDER = ["o_orderdate", "o_orderkey"]


def price():
    return F.col("o_totalprice").cast("decimal(18,2)")


def pending():
    return F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))


@pytest.mark.parametrize(
    "step",
    [
        lambda t: t.previous(["o_orderpriority"], "x"),
        lambda t: t.next(["o_orderpriority"], "x"),
        lambda t: t.last_known(pending(), "x"),
        lambda t: t.running_sum(price(), "x"),
        lambda t: t.max_before(F.col("o_totalprice"), "x"),
        lambda t: t.previous(["o_orderdate"], "x").next(["o_orderdate"], "y"),
    ],
    ids=["previous", "next", "last_known", "running_sum", "max_before", "chained"],
)
def test_split_windows_equal_plain_windows(log, step):
    split = step(Timeline(log, ["o_custkey"], ORDER, HOT)).rows()
    plain = step(Timeline(log, ["o_custkey"], ORDER, None)).rows()
    equal(split, plain)


def test_a_burst_is_cut_as_finely_as_it_is_dense(spark):
    """Most rows of the hot key fall into one hour of ten years."""
    start = F.lit("2015-01-01").cast("timestamp_ntz")
    burst = (
        spark.range(8000)
        .withColumn("k", F.when(F.col("id") < 6000, 1).otherwise(F.col("id")))
        .withColumn(
            "ts",
            F.when(F.col("id") % 10 == 0, F.timestamp_add("DAY", (F.col("id") / 2).cast("int"), start))
            .otherwise(F.timestamp_add("SECOND", (F.col("id") % 3600).cast("int"), start)),
        )
    )
    timeline = Timeline(burst, ["k"], ["ts", "id"], 500)
    sizes = timeline.frame.groupBy("k", SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 500
    bounds = (
        timeline.frame.where("k = 1").groupBy(SLICE).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        .orderBy(SLICE).collect()
    )
    assert all(a["hi"] <= b["lo"] for a, b in zip(bounds, bounds[1:]))
    step = lambda t: t.previous(["id"], "x").running_sum(F.col("id"), "y").rows()
    equal(step(timeline), step(Timeline(burst, ["k"], ["ts", "id"], None)))


def test_a_hot_null_key_is_split_too(log):
    unknown = log.withColumn("o_custkey", F.when(F.col("o_custkey") != 1, F.col("o_custkey")))
    timeline = Timeline(unknown, ["o_custkey"], ORDER, HOT)
    sizes = timeline.frame.where("o_custkey IS NULL").groupBy(SLICE).count()
    assert sizes.count() > 10
    step = lambda t: t.previous(["o_orderdate"], "x").running_sum(price(), "y").rows()
    equal(step(timeline), step(Timeline(unknown, ["o_custkey"], ORDER, None)))


def test_facts_without_a_key_have_no_version(spark, log):
    hist = history.build_history(log, **ARGS, hot_rows=None)
    facts_ = log.select(
        "o_orderkey", "o_orderdate",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"),
    )
    for got in (
        intervals.asof(facts_, hist, ["o_custkey"], "o_orderdate"),
        intervals.asof(facts_, hist, ["o_custkey"], "o_orderdate", dense=20, hot_rows=HOT),
        history.asof_last(
            facts_, log, ["o_custkey"], "o_orderdate", "o_orderdate", "o_orderkey",
            ["o_orderpriority"], HOT,
        ),
    ):
        assert got.count() == 1500
        assert got.where("o_custkey IS NULL AND o_orderpriority IS NOT NULL").isEmpty()
        assert got.where("o_custkey IS NOT NULL AND o_orderpriority IS NULL").isEmpty()


def test_plain_running_sum_is_the_window(log):
    w = Window.partitionBy("o_custkey").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    equal(
        facts.fact_holding(log.withColumn("q", price()), ["o_custkey"], ORDER, "q", HOT),
        log.withColumn("q", price()).withColumn("holding", F.sum("q").over(w)),
    )


ARGS = dict(key=["o_custkey"], ts="o_orderdate", tie="o_orderkey", attrs=["o_orderpriority"])


def test_history_of_a_hot_key(log):
    split = history.build_history(log, **ARGS, hot_rows=HOT)
    plain = history.build_history(log, **ARGS, hot_rows=None)
    equal(split, plain)
    faults = history.interval_faults(split, ["o_custkey"], HOT)
    assert faults.isEmpty()
    equal(history.coalesce_history(split, ["o_custkey"], ["o_orderpriority"], HOT), plain)


def test_asof_forms_agree_on_a_hot_key(spark, sf, log):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    probes = lines.join(log.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    hist = history.build_history(log, **ARGS, hot_rows=HOT)
    pick = ["l_orderkey", "l_linenumber", "l_shipdate", "o_orderpriority"]
    plain = intervals.asof(probes, hist, ["o_custkey"], "l_shipdate", dense=None).select(*pick)
    assert hist.groupBy("o_custkey").count().where("count > 50").count() == 1
    tree = intervals.asof(
        probes, hist, ["o_custkey"], "l_shipdate", dense=50, depth=2, flat_cells=0, hot_rows=HOT
    ).select(*pick)
    last = history.asof_last(
        probes, log, ["o_custkey"], "l_shipdate", "o_orderdate", "o_orderkey",
        ["o_orderpriority"], HOT,
    ).select(*pick)
    hot = intervals.asof(
        probes, hist, ["o_custkey"], "l_shipdate", dense=50, hot_rows=HOT
    ).select(*pick)
    equal(tree, plain)
    equal(last, plain)
    equal(hot, plain)


def test_transitions_of_a_hot_user(spark, sf):
    events = table(spark, sf, "events").withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id"))
    )
    args = (["user_id"], ["ts", "event_id"], "event_type", transitions(spark))
    equal(
        classify.classify_transition(events, *args, hot_rows=HOT),
        classify.classify_transition(events, *args, hot_rows=None),
    )


@pytest.mark.parametrize("parts", [1, 7, 168])
def test_trailing_extremes_equal_the_range_window(spark, sf, parts):
    events = table(spark, sf, "events")
    week = 7 * 86400
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("event_type").orderBy(at).rangeBetween(-week * 1_000_000, 0)
    plain = events.withColumn("trailing_high", F.max("value").over(w)).withColumn(
        "trailing_low", F.min("value").over(w)
    )
    equal(facts.fact_trailing(events, "event_type", "ts", "value", week, parts), plain)


def test_band_table_equals_case(spark, sf):
    from plumbline.plans.policy import BANDS
    from plumbline.sources.relations import relation

    events = table(spark, sf, "events").select("event_id", "value")
    bands = relation(spark, "label string, lo double, hi double", BANDS)
    for width in (1.0, 25.0, 1000.0):
        equal(
            reference.decode_band_table(events, bands, "value", width),
            reference.decode_band(events, BANDS, "value"),
        )


def test_surrogate_keys_are_dense_and_ordered(log):
    keys = history.assign_sk(log, ["o_custkey", "o_orderdate"]).orderBy("o_custkey", "o_orderdate")
    rows = [r["sk"] for r in keys.collect()]
    assert rows == list(range(1, len(rows) + 1))


def test_a_hot_key_at_one_instant_is_cut(spark):
    """All rows of the hot key share the first order column."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 4 > 0, 1).otherwise(F.col("id")).alias("k"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("ts"), "id",
    )
    timeline = Timeline(rows, ["k"], ["ts", "id"], 100)
    assert timeline.frame.where("k = 1").groupBy(SLICE).count().agg(F.max("count")).first()[0] <= 100
    step = lambda t: t.previous(["id"], "x").running_sum(F.col("id"), "y").rows()
    equal(step(timeline), step(Timeline(rows, ["k"], ["ts", "id"], None)))
