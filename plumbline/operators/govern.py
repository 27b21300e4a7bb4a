"""Governance as data work (GV-01 to GV-13)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import join_null_safe, row_fingerprint
from plumbline.operators.classify import Rule, rule_of
from plumbline.operators.verify import edge_equal
from plumbline.sources.shared import checked_keys

TRAIL = "trail"
# Relations are compared by so many sums first.
BUCKETS = 1024
RUN = "run"
CONTROL, ALL_FAULTS = "NONE", "ALL"


def with_provenance(df: DataFrame, stage: str) -> DataFrame:
    """GV-01. Append ``(stage, rule_id, disposition)`` to the row's trail."""
    step = F.struct(
        F.lit(stage).alias("stage"), F.col("rule_id"), F.col("disposition")
    )
    if TRAIL in df.columns:
        return df.withColumn(TRAIL, F.array_append(TRAIL, step))
    return df.withColumn(TRAIL, F.array(step))


def replay(cex: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """GV-02. Classify each counterexample by a policy and compare with its expected rule."""
    return cex.withColumn("rule_id", rule_of(rules)).withColumn(
        "passed", F.col("rule_id").eqNullSafe(F.col("expected_rule_id"))
    )


def _one_per(df: DataFrame, by: Sequence[str], pick: Callable, order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return (
        df.groupBy(*by)
        .agg(pick(F.struct(*rest), order).alias("_row"))
        .select(*by, "_row.*")
        .select(*df.columns)
    )


def accepted(cex: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """GV-03. Accepted counterexamples; on the same input the latest review stands."""
    kept = cex.where(F.col("status") == "ACCEPTED")
    return _one_per(kept, inputs, F.max_by, F.struct("reviewed_at", "cex_id"))


def curate(cex: DataFrame) -> DataFrame:
    """GV-04. One regression per semantic boundary: the first reviewed."""
    return _one_per(cex, ["boundary_id"], F.min_by, F.struct("reviewed_at", "cex_id"))


def row_digests(
    df: DataFrame,
    key: Sequence[str],
    stages: Mapping[int, Sequence[str]],
    present: Mapping[int, Column] | None = None,
) -> DataFrame:
    """``key`` and ``digests``: for each stage the digest of the outputs the row carries for
    it. ``present`` tells for a stage whether this row is one of its rows."""
    present = present or {}
    entries = [
        F.when(
            present.get(stage, F.lit(True)),
            F.struct(F.lit(stage).alias("stage_ord"), row_fingerprint(columns).alias("digest")),
        )
        for stage, columns in stages.items()
    ]
    return df.select(*key, F.array(*entries).alias("digests"))


def stage_digests(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The long form ``key, stage_ord, digest`` of ``row_digests``."""
    return (
        rows.select(*key, F.explode("digests").alias("_e"))
        .where(F.col("_e").isNotNull())
        .select(*key, "_e.stage_ord", "_e.digest")
    )


def divergence(actual: DataFrame, expected: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every ``key, stage_ord`` at which the rows of the two runs differ as bags.

    Actual rows count +1 and expected rows -1; a row digest whose counts do not cancel is a
    difference. So repeated rows, lost rows and changed rows all show, the counts combine
    before the shuffle, and no group's digests are gathered in one place.
    """
    signed = actual.withColumn("_sign", F.lit(1)).unionByName(expected.withColumn("_sign", F.lit(-1)))
    return (
        signed.groupBy(*key, "stage_ord", "digest")
        .agg(F.sum("_sign").alias("_left"))
        .where(F.col("_left") != 0)
        .select(*key, "stage_ord")
        .distinct()
    )


def first_divergence(actual: DataFrame, expected: DataFrame, key: Sequence[str]) -> DataFrame:
    """GV-05. The first wrong stage per record; records without one are absent."""
    return (
        divergence(actual, expected, key).groupBy(*key).agg(F.min("stage_ord").alias("first_stage"))
    )


def run_divergence(
    rows: DataFrame, key: Sequence[str], runs: Sequence[str], control: str = CONTROL
) -> DataFrame:
    """``divergence`` of several runs held in one relation, each against the control run.

    ``rows`` are ``row_digests``. Rows equal in all stages are counted together first, for all
    runs at once; where a run has as many of them as the control run they cancel and are
    dropped. Only what is left, the rows a run changed, is opened into stages and compared.
    """
    counts = rows.groupBy(*key, "digests").agg(
        F.count_if(F.col(RUN) == control).alias("_control"),
        *[F.count_if(F.col(RUN) == r).alias(r) for r in runs],
    )
    surplus = F.array(
        *[
            F.when(
                F.col(r) != F.col("_control"),
                F.struct(F.lit(r).alias(RUN), (F.col(r) - F.col("_control")).alias("_surplus")),
            )
            for r in runs
        ]
    )
    changed = (
        counts.select(*key, "digests", F.explode(surplus).alias("_s"))
        .where(F.col("_s").isNotNull())
        .select(*key, "digests", "_s.*")
    )
    return (
        stage_digests(changed, [RUN, *key, "_surplus"])
        .groupBy(RUN, *key, "stage_ord", "digest")
        .agg(F.sum("_surplus").alias("_left"))
        .where(F.col("_left") != 0)
        .select(RUN, *key, "stage_ord")
        .distinct()
    )


def surplus_divergence(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """``divergence`` of rows that carry a ``surplus``, what the actual run has of them more than the
    expected one."""
    return (
        changes.groupBy(*key, "stage_ord", "digest")
        .agg(F.sum("surplus").alias("_left"))
        .where(F.col("_left") != 0)
        .select(*key, "stage_ord")
        .distinct()
    )


def first_run_divergence(rows: DataFrame, key: Sequence[str], runs: Sequence[str]) -> DataFrame:
    """GV-05 for several runs at once."""
    return (
        run_divergence(rows, key, runs).groupBy(RUN, *key).agg(F.min("stage_ord").alias("first_stage"))
    )


def blame(
    div: DataFrame, by: Sequence[str] = ("first_stage", "rule_id"), weight: Column | None = None
) -> DataFrame:
    """GV-06. First-wrong counts per stage and rule. A row counts once, or ``weight`` times."""
    return div.groupBy(*by).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))


def rule_moves(old: Sequence[Rule], new: Sequence[Rule]) -> Column:
    """Whether two policies give a row different rules."""
    return ~rule_of(old).eqNullSafe(rule_of(new))


def policy_diff(df: DataFrame, old: Sequence[Rule], new: Sequence[Rule]) -> DataFrame:
    """GV-07. Rows whose rule changes between two policies; both are evaluated in one scan."""
    return df.withColumns({"old_rule": rule_of(old), "new_rule": rule_of(new)}).where(
        ~F.col("old_rule").eqNullSafe(F.col("new_rule"))
    )


def collateral(diff: DataFrame, scope: Column) -> DataFrame:
    """GV-08. Changed rows outside the scope the change was authorized for. A scope that is
    NULL on a row does not cover it."""
    return diff.where(~F.coalesce(scope, F.lit(False)))


@dataclass(frozen=True)
class Edge:
    """Lineage between two stages: rows pairing an upstream key with a downstream key."""

    name: str
    lineage: DataFrame
    from_key: str
    to_key: str


def affected(changed: DataFrame, key: str, edges: Sequence[Edge]) -> dict[str, DataFrame]:
    """GV-09. Downstream keys reached from changed rows, per stage along a lineage chain."""
    out, keys = {}, changed.select(F.col(key).alias("_key")).distinct()
    for edge in edges:
        keys = (
            edge.lineage.join(keys, F.col(edge.from_key) == F.col("_key"), "left_semi")
            .select(F.col(edge.to_key).alias("_key"))
            .distinct()
        )
        out[edge.name] = keys.select(F.col("_key").alias(edge.to_key))
    return out


def revalidate(
    stage: Callable[[DataFrame], DataFrame],
    source: DataFrame,
    stored: DataFrame,
    keys: DataFrame,
    key: Sequence[str],
) -> DataFrame:
    """GV-10. Recompute a stage for the affected keys only and keep the stored rest. Every key
    the change can add, alter or remove must be among ``keys``."""
    key, keys = list(key), checked_keys(keys.distinct())
    redone = stage(join_null_safe(source, keys, key, "left_semi"))
    return join_null_safe(stored, keys, key, "left_anti").unionByName(redone)


def same_as_full(sel: DataFrame, full: DataFrame) -> DataFrame:
    """GV-11. Rows by which a selective recompute differs from a full one; empty if equal."""
    return edge_equal(sel, full)


def count_differences(full: DataFrame, others: Mapping[str, DataFrame]) -> DataFrame:
    """GV-11 in numbers. One row: the ``rows`` of ``full``, and under each name how many distinct rows
    there are of which that relation has more or fewer copies. Rows travel as fingerprints, and only those
    of buckets whose sums differ (``differing_buckets``), so relations that agree are not shuffled."""
    rows, buckets = differing_buckets(full, others)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    fingerprint = row_fingerprint(full.columns)

    def side(df: DataFrame, own: Sequence[int], counts: Mapping[str, Column]) -> DataFrame:
        named = [counts.get(n, none).alias(n) for n in buckets]
        part = df.select(fingerprint["a"].alias("_a"), fingerprint["b"].alias("_b"))
        part = part.where(F.pmod("_a", F.lit(BUCKETS)).isin(list(own))) if len(own) < BUCKETS else part
        return part.select("_a", "_b", *named)

    total = F.lit(rows).cast("bigint").alias("rows")
    if not buckets:
        return full.sparkSession.range(1).select(total, *[none.alias(n) for n in others])
    opened = {bucket for own in buckets.values() for bucket in own}
    sides = side(full, sorted(opened), {n: -one for n in buckets})
    for name in buckets:
        sides = sides.unionByName(side(others[name].select(*full.columns), sorted(opened), {name: one}))
    counted = sides.groupBy("_a", "_b").agg(*[F.sum(n).alias(n) for n in buckets])
    return counted.agg(*[F.count_if(F.col(n) != 0).alias(n) for n in buckets]).select(
        total, *[F.col(n) if n in buckets else none.alias(n) for n in others]
    )


def differing_buckets(full: DataFrame, others: Mapping[str, DataFrame]) -> tuple[int, dict[str, list[int]]]:
    """The rows of ``full``, and for each relation that differs from it as a bag the buckets that do. A bucket
    is known by the number of its rows and the sum of their fingerprints, in four parts of 32 bits that
    cannot overflow. One pass over each relation and one job, of which each task sends its sums alone."""
    frames = [full, *[df.select(*full.columns) for df in others.values()]]
    fingerprint, out = row_fingerprint(full.columns), None
    low = lambda half: F.col(half).bitwiseAND(F.lit(0xFFFFFFFF))
    parts = [F.lit(1), *[part for half in ("_a", "_b") for part in (low(half), F.shiftrightunsigned(half, 32))]]
    for which, df in enumerate(frames):
        part = df.select(F.lit(which).alias("_which"), fingerprint["a"].alias("_a"), fingerprint["b"].alias("_b"))
        out = part if out is None else out.unionByName(part)

    def differs(which: int) -> Column:
        sign = F.when(F.col("_which") == which, 1).when(F.col("_which") == 0, -1).otherwise(0).cast("bigint")
        return reduce(or_, [F.sum(sign * part) != 0 for part in parts])

    summed = out.groupBy(F.pmod("_a", F.lit(BUCKETS)).alias("bucket")).agg(
        F.count_if(F.col("_which") == 0).alias("rows"), *[differs(n).alias(name) for n, name in enumerate(others, 1)]
    ).collect()
    found = {name: sorted(r["bucket"] for r in summed if r[name]) for name in others}
    return sum(r["rows"] for r in summed), {name: own for name, own in found.items() if own}


@dataclass(frozen=True)
class Fault:
    """A named change to one stage. A value fault sets ``column`` to ``value`` on the rows of
    ``condition``; a logic fault has no column and is a switch inside its stage."""

    fault_id: str
    stage: int
    column: str | None = None
    value: str | None = None
    condition: str | None = None


def active(fault_id: str) -> Column:
    """Whether the row's run carries the fault."""
    return F.col(RUN).isin(fault_id, ALL_FAULTS)


def inject(df: DataFrame, fault: Fault) -> DataFrame:
    """GV-13. Inject a value fault on the rows whose run carries it. No row is added or
    removed, and the same rows are hit on every execution."""
    hit = active(fault.fault_id) & F.coalesce(F.expr(fault.condition), F.lit(False))
    kind = df.schema[fault.column].dataType
    return df.withColumn(
        fault.column, F.when(hit, F.expr(fault.value).cast(kind)).otherwise(F.col(fault.column))
    )


def compare_arms(findings: DataFrame, faults: DataFrame) -> DataFrame:
    """GV-12. Compare ways of checking over injected faults. ``findings`` holds ``run, arm,
    stage, check, violations`` with the control run; ``faults`` holds ``run, fault_stage``.

    A check fires when its count differs from the control run's. ``located``: the first stage
    that fires is the faulty one. ``false_alarms``: violations the arm reports on the control
    run. ``collateral``: changed counts at other stages than the faulty one.
    """
    control = findings.where(F.col(RUN) == CONTROL).select(
        "arm", "stage", "check", F.col("violations").alias("_base")
    )
    change = F.abs(F.col("violations") - F.col("_base"))
    fired = F.when(change > 0, F.col("stage"))
    return (
        findings.where(F.col(RUN) != CONTROL)
        .join(control, ["arm", "stage", "check"])
        .join(faults, RUN)
        .groupBy(RUN, "fault_stage", "arm")
        .agg(
            F.min(fired).alias("first_stage"),
            F.sum("_base").alias("false_alarms"),
            F.sum(F.when(F.col("stage") != F.col("fault_stage"), change).otherwise(0)).alias(
                "collateral"
            ),
        )
        .select(
            F.col(RUN).alias("fault"),
            "fault_stage",
            "arm",
            F.col("first_stage").isNotNull().alias("detected"),
            F.coalesce(F.col("first_stage") == F.col("fault_stage"), F.lit(False)).alias("located"),
            F.coalesce("first_stage", F.lit(-1)).alias("first_stage"),
            "false_alarms",
            "collateral",
        )
    )
