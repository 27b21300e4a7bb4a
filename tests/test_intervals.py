"""As-of joins of dense keys: equal to the plain join, with few versions compared per fact."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import intervals

START = datetime(2020, 1, 1)
HIST = "k long, valid_from timestamp_ntz, valid_to timestamp_ntz, v long"


def at(minute):
    return START + timedelta(minutes=minute)


def history(kind, rng, n=400):
    """Versions of one key as (from, to) minutes."""
    if kind == "chain":
        return [(i * 3, i * 3 + 3) for i in range(n)]
    if kind == "overlaps":
        return [(a, a + rng.randint(-2, 60)) for a in (rng.randint(0, 900) for _ in range(n))]
    if kind == "long":
        return [(i, 10_000 - i) for i in range(n)]
    if kind == "burst":
        # All begin at one instant; a third of them end together as well.
        return [(500, 500 + (i if i % 3 else 77)) for i in range(n)]
    gaps = [(i * 10, i * 10 + 4) for i in range(n)]
    return gaps + [(0, 10_000)] * 5 + [(1, 9_000), (17, 20)]


def tables(spark, kinds, seed=1):
    rng = random.Random(seed)
    versions, facts = [], []
    for k, kind in enumerate(kinds):
        made = history(kind, rng)
        versions += [(k, at(a), at(b), i) for i, (a, b) in enumerate(made)]
        ends = [t for pair in made for t in pair]
        times = [rng.choice(ends) + rng.choice([-1, 0, 0, 1]) for _ in range(150)] + [-5, 10**6]
        facts += [(k, at(t), n) for n, t in enumerate(times)]
    versions += [(99, at(0), at(50), 1), (None, at(0), at(50), 2), (98, None, at(5), 3)]
    facts += [(99, at(7), 1), (None, at(7), 2), (97, at(7), 3), (0, None, 4)] + [(0, at(4), 5)] * 3
    return spark.createDataFrame(facts, "k long, ts timestamp_ntz, n long"), spark.createDataFrame(versions, HIST)


def bag(df):
    return sorted(map(tuple, df.select("k", "ts", "n", "valid_from", "valid_to", "v").collect()), key=repr)


@pytest.mark.parametrize("how", [dict(), dict(depth=2, heavy=2), dict(depth=5, heavy=3, flat_cells=0), dict(depth=8, flat_cells=1000)])
def test_dense_keys_equal_the_plain_join(spark, how):
    fact, hist = tables(spark, ["chain", "overlaps", "long", "burst", "gaps"])
    want = bag(intervals.asof(fact, hist, ["k"], "ts", dense=None))
    assert len(want) > 5_000
    assert bag(intervals.asof(fact, hist, ["k"], "ts", dense=100, **how)) == want


def test_hot_key_and_two_key_columns(spark):
    fact, hist = tables(spark, ["overlaps", "chain"])
    two = lambda df: df.withColumn("j", F.when(F.col("k") == 0, "x").otherwise("y"))
    fact, hist = two(fact), two(hist)
    want = bag(intervals.asof(fact, hist, ["k", "j"], "ts", dense=None))
    assert bag(intervals.asof(fact, hist, ["k", "j"], "ts", dense=50, hot_rows=60)) == want


@pytest.mark.parametrize("kind", ["chain", "overlaps", "long", "burst", "gaps"])
@pytest.mark.parametrize("flat", [0, intervals.FLAT_CELLS])
def test_few_versions_are_compared_in_vain(spark, kind, flat):
    fact, hist = tables(spark, [kind])
    only = lambda df: df.where("k = 0")
    probes, nodes = intervals.cells(only(fact), only(hist), ["k"], "ts", 4, 3, flat)
    met = probes.join(nodes, ["k", "_level", "_node"])
    vain = met.where("NOT (valid_from <= _at AND _at < valid_to)").groupBy("k", "_at").count().agg(F.max("count")).first()[0]
    assert (vain or 0) < 4 * 3
    # A version takes rows by the logarithm of the cells it covers, or few on average.
    entries = nodes.count() / max(1, hist.where("k = 0 AND valid_from < valid_to").count())
    assert entries <= (2 + 2 * 9 if flat == 0 else 2 + 2 * 9 + flat)


def test_tree_nodes_cover_each_range_once(spark):
    ranges = spark.range(24).select(F.col("id").alias("low")).crossJoin(spark.range(24).select(F.col("id").alias("high")))
    node = lambda level, at: F.struct(level.cast("int").alias("l"), at.alias("n"))
    for r in ranges.withColumn("nodes", intervals.tree_nodes(F.col("low"), F.col("high"), node)).collect():
        covered = sorted(c for x in r.nodes or [] for c in range(x.n << x.l, (x.n + 1) << x.l))
        assert covered == list(range(r.low, r.high + 1))
        assert len(r.nodes or []) <= 2 * 5


def test_no_dense_key_is_one_plain_join(spark):
    fact, hist = tables(spark, ["gaps"])
    joined = intervals.asof(fact, hist, ["k"], "ts", dense=1_000_000)
    assert bag(joined) == bag(intervals.asof(fact, hist, ["k"], "ts", dense=None))
    assert intervals.asof(fact.limit(0), hist, ["k"], "ts", dense=5).count() == 0
    assert intervals.asof(fact, hist.limit(0), ["k"], "ts", dense=5).count() == fact.count()
