"""Counterexamples, and the ways of checking that GV-12 compares.

- ``native``: what a pipeline tool checks out of the box: not null, accepted values, unique,
  relationships.
- ``stage``: each stage against its own contract: unit, domain, grain, time, cause,
  provenance, range, and a replay of the accepted counterexamples.
- ``composed``: contracts on the edges, read off the run alone: what a stage hands on against
  what it was given (raw price, code meaning, source key), rows kept per key from stage to
  stage, the metric against its own definition, and the replay.
- ``ideal``: the first divergence of each record from the fault-free run, which no real check
  has; stage 7 is recomputed on expected input, so that it shows only a fault of its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.classify import HOLE, rule_of
from plumbline.operators.govern import (
    CONTROL, RUN, accepted, active, run_divergence, surplus_divergence,
)
from plumbline.operators.reference import lookup
from plumbline.operators.verify import repeated_keys
from plumbline.plans.pipeline import (
    LABEL, SIGN, governed_run, line_changes, metric_digests, metric_sums, metrics_of, order_lines, present,
)
from plumbline.plans.policy import FAULTS, LINE_RULES, LINE_RULES_SWAPPED, STATUS
from plumbline.sources.relations import relation
from plumbline.sources.shared import checked_keys, store

RULE_INPUTS = ["l_shipdate", "o_orderdate", "l_returnflag", "l_linestatus", "l_discount"]
# The run whose fault looks lines up under another key.
MOVING = "F3"
# The plausible bounds of the stage contracts.
HIGHEST_PRICE, HIGHEST_DISCOUNT = 105_000, 0.1


def counterexamples(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    """For each rule boundary the lowest-key line on each side, over all lines (``lines``, where they are
    stored with what the rules read). ``O12`` guards
    the order of R1 and R2. The hole side of R4 is not accepted yet. Each has an older review
    that called the line a hole."""
    rule = F.col("rule_id")
    side = lambda boundary, inside: F.struct(
        F.lit(boundary).alias("boundary_id"), inside.alias("inside")
    )
    both = F.expr(LINE_RULES[0].predicate) & F.expr(LINE_RULES[1].predicate)
    sides = F.array(
        side("B1", rule == "R1"),
        F.when(rule != "R1", side("B2", rule == "R2")),
        F.when(~rule.isin("R1", "R2"), side("B3", rule == "R3")),
        F.when(rule.isin("R4", HOLE), side("B4", rule == "R4")),
        F.when(both, side("O12", F.lit(True))),
    )
    picked = (
        (order_lines(spark, sf) if lines is None else lines)
        .withColumn("rule_id", rule_of(LINE_RULES))
        .select("record_key", *RULE_INPUTS, "rule_id", F.explode(sides).alias("_side"))
        .where(F.col("_side").isNotNull())
        .groupBy("_side.boundary_id", "_side.inside")
        .agg(F.min_by(F.struct("record_key", *RULE_INPUTS, "rule_id"), "record_key").alias("_row"))
        .select("boundary_id", "inside", "_row.*")
        .withColumn("_id", F.concat_ws("-", "boundary_id", F.when(F.col("inside"), "in").otherwise("out")))
    )
    reviews = F.array(
        F.struct(
            F.col("_id").alias("cex_id"),
            rule.alias("expected_rule_id"),
            (F.col("o_orderdate") + F.expr("interval 365 days")).alias("reviewed_at"),
        ),
        F.struct(
            F.concat("_id", F.lit("-old")).alias("cex_id"),
            F.lit(HOLE).alias("expected_rule_id"),
            F.col("o_orderdate").alias("reviewed_at"),
        ),
    )
    pending = (F.col("boundary_id") == "B4") & ~F.col("inside")
    return picked.select(
        "record_key", "boundary_id", *RULE_INPUTS,
        F.when(pending, "PENDING").otherwise("ACCEPTED").alias("status"),
        F.explode(reviews).alias("_review"),
    ).select("*", "_review.*").drop("_review")


def _long(df: DataFrame, counts: Mapping[tuple[str, int, str], Column]) -> DataFrame:
    """One row per run and check from one aggregate row per run."""
    entries = [
        F.struct(
            F.lit(arm).alias("arm"), F.lit(stage).alias("stage"), F.lit(check).alias("check"),
            value.cast("bigint").alias("violations"),
        )
        for (arm, stage, check), value in counts.items()
    ]
    return df.groupBy(RUN).agg(F.array(*entries).alias("_e")).select(
        RUN, F.explode("_e").alias("_e")
    ).select(RUN, "_e.*")


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """``run, arm, stage, check, violations`` for the control run and every fault. The control run
    is stored once, and of every other run the lines that its fault reaches; their counts are the
    control run's plus the difference that those lines make."""
    faults = [f.fault_id for f in FAULTS]
    runs = [CONTROL, *faults]
    kept = [
        LABEL, SIGN, "record_key", "l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate", "price",
        "quantity", "discount", "status_meaning", "customer_key", "priority", "rule_id",
        "customer_sk", "extra", "copy", "dropped", "raw_price", "o_orderstatus", "o_custkey",
        "l_returnflag", "l_linestatus", "l_discount", "copies", "two_versions", "regions",
    ]
    # Keys are only grouped by, so they are kept as 16 bytes.
    signed = governed_run(spark, sf, runs, signed=True, short=True).select(*kept).withColumnRenamed(LABEL, RUN)
    run = store(signed, "runs")
    p = present()
    lines = run.where((F.col(RUN) == CONTROL) & p[1])
    again = checked_keys(repeated_keys(lines, "record_key")).withColumn("_again", F.lit(True))
    # A line that has its key for itself and one version is all its key has: what counts by key is read off it.
    run = run.join(again, "record_key", "left").withColumn("lone", F.col("_again").isNull() & ~F.col("two_versions")).drop("_again")
    each_run = F.explode(F.array(*[F.lit(r) for r in runs]))
    count = lambda test: F.sum(F.when(test, F.col(SIGN)).otherwise(0))

    ids = [r.rule_id for r in LINE_RULES] + [HOLE]
    null = F.col("price").isNull() | F.col("quantity").isNull() | F.col("l_shipdate").isNull()
    alien = ~F.col("status_meaning").isin(*[m for _, m in STATUS])
    by_row = _long(
        run,
        {
            ("native", 1, "not_null"): count(p[1] & null),
            ("native", 2, "accepted_values"): count(p[2] & alien),
            ("native", 6, "relationship"): count(p[6] & (F.col("customer_sk") == -1)),
            ("stage", 1, "unit"): count(p[1] & (F.col("price") > HIGHEST_PRICE)),
            ("stage", 2, "domain"): count(p[2] & alien),
            ("stage", 3, "time"): count(p[3] & F.col("extra")),
            ("stage", 4, "cause"): count(p[1] & (F.col("l_shipdate") < F.col("o_orderdate"))),
            ("stage", 4, "provenance"): count(p[4] & ~F.col("rule_id").isin(*ids)),
            ("composed", 1, "source_price"): count(p[1] & (F.col("price") != F.col("raw_price"))),
            ("composed", 2, "source_meaning"): count(
                p[2] & (F.col("status_meaning") != lookup(STATUS, "o_orderstatus"))
            ),
            ("composed", 3, "source_key"): count(p[1] & (F.col("customer_key") != F.col("o_custkey"))),
        },
    )
    # A fault reaches all rows of a line or none, so keys are whole on both sides.
    keys = run.where(~F.col("lone")).groupBy(RUN, SIGN, "record_key").agg(
        *[F.count_if(p[s]).alias(f"n{s}") for s in (3, 5, 6)]
    )
    one = F.lit(1).cast("bigint")
    alone = run.where(F.col("lone") & (F.col("copy") == 1)).select(
        RUN, SIGN, "record_key", one.alias("n3"), F.col("copies").alias("n5"),
        F.when(F.col("dropped"), one - 1).otherwise(F.col("copies")).alias("n6"),
    )
    keys = keys.unionByName(alone)
    repeated = {s: count(F.col(f"n{s}") > 1) for s in (3, 5, 6)}
    by_key = _long(
        keys,
        {
            ("native", 5, "unique_key"): repeated[5],
            ("native", 6, "unique_key"): repeated[6],
            ("stage", 3, "grain"): repeated[3],
            ("stage", 5, "grain"): repeated[5],
            ("stage", 6, "grain"): repeated[6],
            ("composed", 3, "fanout"): repeated[3],
            ("composed", 5, "fanout"): count(F.col("n5") > F.col("n3")),
            ("composed", 6, "lost"): count(F.col("n6") < F.col("n5")),
        },
    )
    # Pairs are shared by lines, so what a fault adds to a pair meets the control run's count.
    pair = ["l_orderkey", "l_linenumber"]
    base = run.where(F.col(RUN) == CONTROL).groupBy(*pair).agg(F.count_if(p[5]).alias("_n"))
    # Every line of a faulty run is there with both signs, so only its further rows add to a pair.
    further = run.where((F.col(RUN) != CONTROL) & (F.col("extra") | (F.col("copy") > 1)))
    more = further.groupBy(RUN, *pair).agg(count(p[5]).alias("_more")).where(F.col("_more") != 0)
    twice = lambda n: (n > 1).cast("int")
    turned = more.join(base, pair).select(RUN, (twice(F.col("_n") + F.col("_more")) - twice(F.col("_n"))).alias("_v"))
    pairs = base.select(F.lit(CONTROL).alias(RUN), twice(F.col("_n")).alias("_v")).unionByName(turned)
    by_pair = _long(pairs, {("native", 5, "unique_pair"): F.sum("_v")})
    differences = by_row.unionByName(by_key).unionByName(by_pair)
    level = differences.where(F.col(RUN) == CONTROL).select("arm", "stage", "check", F.col("violations").alias("_base"))

    sums = store(metric_sums(run), "sums")
    amounts = ["n_lines", "amount", "_product", "_rates"]
    expected = sums.where(F.col(RUN) == CONTROL).withColumn(RUN, each_run)
    own = expected.unionByName(sums.where(F.col(RUN) != CONTROL)).groupBy(RUN, "region", "rule_id", "priority").agg(
        *[F.sum(c).alias(c) for c in amounts]
    )
    by_group = _long(
        metrics_of(own),
        {
            ("stage", 7, "range"): F.count_if(~F.col("discount").between(0, HIGHEST_DISCOUNT)),
            ("composed", 7, "definition"): F.count_if(
                F.col("discount").cast("decimal(18,9)") != F.col("weighted").cast("decimal(18,9)")
            ),
        },
    )
    replayed = (
        accepted(counterexamples(spark, sf, lines), ["record_key"])
        .withColumn(RUN, each_run)
        .withColumn(
            "rule_id",
            F.when(active("F5"), rule_of(LINE_RULES_SWAPPED)).otherwise(rule_of(LINE_RULES)),
        )
    )
    by_example = _long(
        replayed,
        {
            (arm, 4, "replay"): F.count_if(F.col("rule_id") != F.col("expected_rule_id"))
            for arm in ("stage", "composed")
        },
    )
    whole = by_group.unionByName(by_example).unionByName(_ideal(spark, run, expected, faults))
    # A run that a check has nothing to say about differs by zero.
    out = differences.unionByName(whole)
    every = out.select("arm", "stage", "check").distinct().withColumn(RUN, each_run)
    counted = every.join(out, [RUN, "arm", "stage", "check"], "left").join(level, ["arm", "stage", "check"], "left")
    base_count = F.when(F.col(RUN) != CONTROL, F.coalesce("_base", F.lit(0))).otherwise(0)
    return counted.withColumn("violations", F.coalesce("violations", F.lit(0)) + base_count).drop("_base")


def _ideal(spark: SparkSession, run: DataFrame, expected: DataFrame, faults: list[str]) -> DataFrame:
    """First divergences from the control run, read off the signed rows: what does not cancel
    differs. ``expected`` are the control run's sums under the name of every run."""
    # The control side of a line follows from its faulty row, but for lines under another key.
    rows = run.where((F.col(RUN) != CONTROL) & ((F.col(SIGN) > 0) | (F.col(RUN) == MOVING)))
    changes = line_changes(rows, [RUN, "record_key", "copy", "lone"], F.col(SIGN) < 0)
    lone = F.col("lone") & (F.col(RUN) != MOVING)
    first = (
        surplus_divergence(changes.where(~lone), [RUN, "record_key"])
        .groupBy(RUN, "record_key").agg(F.min("stage_ord").alias("first_stage")).drop("record_key")
    )
    # Where a line has its key for itself nothing else can cancel what it hands on, and of its copies the
    # second tells that there are any.
    own_first = changes.where(lone & (F.col("nth") == 0) & (F.col("copy") <= 2)).select(RUN, F.col("stage_ord").alias("first_stage"))
    groups = metric_digests(metrics_of(expected))
    own = run_divergence(groups, ["record_key"], faults).select(RUN, F.col("stage_ord").alias("first_stage"))
    wrong = (
        first.unionByName(own_first).unionByName(own).groupBy(RUN, "first_stage").agg(F.count(F.lit(1)).alias("n"))
    )
    every = relation(
        spark, "run string, first_stage int", [(r, s) for r in [CONTROL, *faults] for s in range(1, 8)]
    )
    return every.join(wrong, [RUN, "first_stage"], "left").select(
        RUN,
        F.lit("ideal").alias("arm"),
        F.col("first_stage").alias("stage"),
        F.lit("first_divergence").alias("check"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("violations"),
    )
