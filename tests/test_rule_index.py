"""A policy as an index against the same policy as one CASE, and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.classify import Rule, classify
from plumbline.operators.rule_index import TERMS_SCHEMA, classify_indexed

TESTS = {"big": "n > 50", "tail": "s like '%z'"}


def policy(rng, n):
    """Rules over text columns a and b and the number n: (rule_id, ord, disposition, equals, ranged, lo, hi, tests)."""
    rules = []
    for i in range(n):
        equals = {}
        if rng.random() < 0.8:
            equals["a"] = rng.choice("xyzw|")
        if rng.random() < 0.5:
            equals["b"] = str(rng.randint(0, 4))
        lo, hi, ranged = None, None, None
        if rng.random() < 0.7:
            ranged, lo = "n", float(rng.randint(-20, 100))
            hi = lo + rng.choice([0.5, 1, 3, 40, 500])
            lo, hi = rng.choice([(lo, hi)] * 6 + [(None, hi), (lo, None)])
        rules.append((f"r{i}", rng.randint(0, n), rng.choice("DE"), equals, ranged, lo, hi, rng.sample(sorted(TESTS), rng.choice([0, 0, 1, 2]))))
    return rules


def as_text(r):
    terms = [f"{c} = '{v}'" for c, v in r[3].items()] + [TESTS[t] for t in r[7]]
    terms += [f"n >= {r[5]}D"] if r[5] is not None else []
    terms += [f"n < {r[6]}D"] if r[6] is not None else []
    return " AND ".join(terms) or "true"


def rows(spark, rng, n=400):
    made = [
        (i, rng.choice(["x", "y", "z", "w", "|", None]), rng.choice([0, 1, 2, 3, 4, None]), rng.choice([None, float("nan")] + [rng.uniform(-60, 160)] * 9), rng.choice(["az", "q", None]))
        for i in range(n)
    ]
    return spark.createDataFrame(made, "id long, a string, b long, n double, s string")


@pytest.mark.parametrize("seed", [1, 2])
def test_index_equals_one_expression(spark, seed):
    rng = random.Random(seed)
    # A rule without terms would leave the rest nothing to do.
    rules = [r for r in policy(rng, 150) if r[3] or r[4]]
    df = rows(spark, rng).where("n IS NULL OR NOT isnan(n)")
    ordered = sorted(rules, key=lambda r: (r[1], r[0]))
    told = [Rule(r[0], at, 1, as_text(r), (), r[2]) for at, r in enumerate(ordered)]
    want = {r.id: (r.rule_id, r.disposition) for r in classify(df, told).collect()}
    got = classify_indexed(df, ["id"], spark.createDataFrame(rules, TERMS_SCHEMA), TESTS).collect()
    assert {r.id: (r.rule_id, r.disposition) for r in got} == want and len(got) == len(want)
    assert len({v for v, _ in want.values()}) > 15 and "HOLE" in {v for v, _ in want.values()}
    reads = {r[0]: set(r[3]) | ({r[4]} if r[4] else set()) for r in rules}
    for r in got:
        assert set(r.evidence) == reads.get(r.rule_id, set())


def test_fifty_thousand_rules(spark):
    rng = random.Random(5)
    rules = [(f"r{i}", i, "D", {"a": f"k{i % 9000}"}, "n", float(i % 7), float(i % 7 + 1 + i % 3), []) for i in range(50_000)]
    df = spark.createDataFrame([(i, f"k{rng.randint(0, 9500)}", rng.uniform(-1, 10)) for i in range(500)], "id long, a string, n double")
    by_value = {}
    for r in rules:
        by_value.setdefault(r[3]["a"], []).append(r)
    got = {r.id: r.rule_id for r in classify_indexed(df, ["id"], spark.createDataFrame(rules, TERMS_SCHEMA)).collect()}
    for row in df.collect():
        first = next((r[0] for r in by_value.get(row.a, []) if r[5] <= row.n < r[6]), "HOLE")
        assert got[row.id] == first
    assert len(set(got.values())) > 100


def test_empty_policy_and_odd_rows(spark):
    rng = random.Random(1)
    df = rows(spark, rng, 30)
    none = spark.createDataFrame([], TERMS_SCHEMA)
    assert {r.rule_id for r in classify_indexed(df, ["id"], none).collect()} == {"HOLE"}
    every = spark.createDataFrame([("all", 1, "D", {}, None, None, None, None)], TERMS_SCHEMA)
    assert {r.rule_id for r in classify_indexed(df, ["id"], every).collect()} == {"all"}
    assert classify_indexed(df.limit(0), ["id"], every).count() == 0
    ranged = spark.createDataFrame([("low", 1, "D", {}, "n", None, 0.0, []), ("high", 2, "D", {}, "n", 0.0, None, [])], TERMS_SCHEMA)
    got = classify_indexed(df, ["id"], ranged)
    assert got.where("rule_id = 'HOLE' AND n IS NOT NULL AND NOT isnan(n)").count() == 0
    assert got.where("rule_id <> 'HOLE' AND (n IS NULL OR isnan(n))").count() == 0
    assert got.where(F.expr("rule_id = 'low' AND n >= 0")).count() == 0
