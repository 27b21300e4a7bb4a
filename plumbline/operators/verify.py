"""Stage and edge contracts (VF-01 to VF-13).

A check returns its violations as a relation; an empty one means the contract holds. ``gate``
turns any number of checks into one small relation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators.history import interval_faults
from plumbline.sources.relations import relation
from plumbline.sources.shared import checked_keys


def check_schema(df: DataFrame, target: StructType) -> DataFrame:
    """VF-01. Missing, extra and retyped columns. Compares schemas only; runs no job."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in target.fields}
    rows = [(c, "MISSING", t, None) for c, t in want.items() if c not in have]
    rows += [(c, "EXTRA", None, t) for c, t in have.items() if c not in want]
    rows += [(c, "RETYPED", t, have[c]) for c, t in want.items() if have.get(c, t) != t]
    return relation(
        df.sparkSession, "column string, problem string, expected string, found string", rows
    )


def check_grain(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """VF-02. Keys that repeat, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that more than one row has. Rows are shuffled as hashes of 8 bytes; only keys
    whose hash repeats, which are stored or looked at once more, are compared in full."""
    hashed = df.select(F.xxhash64(key).alias("_hash"), key)
    again = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    same = hashed.join(checked_keys(again), "_hash", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return same.where("_n > 1").select(key)


def check_domain(df: DataFrame, col: str, allowed: DataFrame, allowed_col: str) -> DataFrame:
    """VF-03. Values that are NULL or outside the domain, with their count. Rows are counted
    per value first, so only distinct values meet the domain table."""
    values = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    legal = allowed.select(F.col(allowed_col).alias("_legal"))
    return values.join(legal, F.col(col) == F.col("_legal"), "left_anti")


def check_fk(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """VF-04. Foreign keys with no member, with their count; NULL is VF-03's matter."""
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    members = dim.select(F.col(dim_key).alias("_member"))
    return keys.join(members, F.col(key) == F.col("_member"), "left_anti")


def check_unit(
    df: DataFrame, measure: str, unit: str, expected: str, reference: Column, lo: float, hi: float
) -> DataFrame:
    """VF-05. Rows in another unit than the contract's, or whose ratio to the reference value
    is implausible for it (a value in cents under a tag that says dollars)."""
    implied = F.try_divide(F.col(measure).cast("double"), reference.cast("double"))
    plausible = (implied >= lo) & (implied <= hi)
    legal = F.col(unit).eqNullSafe(expected) & F.coalesce(plausible, F.lit(False))
    return df.withColumn("ratio", implied).where(~legal)


def check_time(hist: DataFrame, key: Sequence[str]) -> DataFrame:
    """VF-06 on a history: empty, overlapping and gapped versions, and keys that do not have
    exactly one current version."""
    current = (
        hist.groupBy(*key)
        .agg(F.count_if("is_current").alias("_current"), F.max("valid_from").alias("valid_from"))
        .where(F.col("_current") != 1)
        .select(*key, "valid_from", F.lit("CURRENT").alias("fault"))
    )
    return interval_faults(hist, key).select(*key, "valid_from", "fault").unionByName(current)


def check_cause(df: DataFrame, cause: str, effect: str) -> DataFrame:
    """VF-06 on events: an effect before its cause."""
    return df.where(F.col(effect) < F.col(cause))


def check_provenance(df: DataFrame, rules: DataFrame) -> DataFrame:
    """VF-07. Rows whose rule id, disposition or evidence is absent or not of the policy. An
    empty evidence map is legal only where the rule reads nothing."""
    legal = rules.select(
        F.col("rule_id").alias("_rule"), F.col("disposition").alias("_said"), F.size("reads").alias("_reads")
    )
    known = df.join(
        legal,
        (F.col("rule_id") == F.col("_rule")) & (F.col("disposition") == F.col("_said")),
        "left",
    )
    problem = F.when(F.col("rule_id").isNull() | F.col("disposition").isNull(), "ABSENT").when(
        F.col("_rule").isNull(), "ILLEGAL"
    ).when(F.coalesce(F.size("evidence"), F.lit(0)) < F.col("_reads"), "NO_EVIDENCE")
    return known.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop(
        "_rule", "_said", "_reads"
    )


def edge_rows(a: DataFrame, b: DataFrame, q: DataFrame) -> DataFrame:
    """VF-08. Rows in = accepted + quarantined; one row of counts, ``lost`` is the rest."""
    def counted(df: DataFrame, side: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))

    sides = counted(a, "in").unionByName(counted(b, "accepted")).unionByName(counted(q, "quarantined"))
    n = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")))
    return sides.agg(
        n("in").alias("rows_in"),
        n("accepted").alias("rows_accepted"),
        n("quarantined").alias("rows_quarantined"),
        (n("in") - n("accepted") - n("quarantined")).alias("lost"),
    )


def edge_measure(a: DataFrame, b: DataFrame, by: Sequence[str], m: str) -> DataFrame:
    """VF-09. Groups in which the measure is not conserved. Both sides meet in one aggregate, in
    which NULL is a group; a group on one side only counts as not conserved."""
    before, after = F.col("_side") == 0, F.col("_side") == 1
    return (
        _sides(a.select(*by, m), b.select(*by, m))
        .groupBy(*by)
        .agg(
            F.sum(F.when(before, F.col(m))).alias("before"), F.sum(F.when(after, F.col(m))).alias("after"),
            F.count_if(before).alias("_a"), F.count_if(after).alias("_b"),
        )
        .where(~F.col("before").eqNullSafe(F.col("after")) | (F.col("_a") == 0) | (F.col("_b") == 0))
        .drop("_a", "_b")
    )


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both relations as one, ``_side`` 0 and 1."""
    return a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))


def _counted(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group on either side, in one pass over each; NULL is a group."""
    return _sides(a.select(*by), b.select(*by)).groupBy(*by).agg(
        F.count_if(F.col("_side") == 0).alias("_a"), F.count_if(F.col("_side") == 1).alias("_b")
    )


def edge_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """VF-10. Keys lost or invented between two stages."""
    change = F.when(F.col("_b") == 0, F.lit("LOST")).when(F.col("_a") == 0, F.lit("INVENTED"))
    return (
        _counted(a, b, list(key)).select(*key, change.alias("change")).where(F.col("change").isNotNull())
    )


def edge_fanout(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """VF-11. Keys with more rows after than before."""
    return (
        _counted(a, b, list(key))
        .where((F.col("_a") > 0) & (F.col("_b") > F.col("_a")))
        .select(*key, F.col("_a").alias("n_before"), F.col("_b").alias("n_after"))
    )


def edge_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """VF-12. Rows by which two relations differ as bags, each once with the number of its
    surplus ``copies``; empty when they are equal. One pass over each."""
    more = F.col("_a") > F.col("_b")
    return (
        _counted(a, b, a.columns)
        .where(F.col("_a") != F.col("_b"))
        .select(
            *a.columns, F.when(more, F.lit("LEFT")).otherwise(F.lit("RIGHT")).alias("side"),
            F.abs(F.col("_a") - F.col("_b")).alias("copies"),
        )
    )


@dataclass(frozen=True)
class Check:
    """One check of the gate. ``key`` names the columns that identify a violation."""

    stage: int
    scope: str
    check: str
    violations: DataFrame
    key: tuple[str, ...]


def gate(checks: Sequence[Check]) -> DataFrame:
    """VF-13. One row per check. Each check becomes a single aggregate row before the union,
    so the gate stays small whatever fails."""
    out = None
    for c in checks:
        named = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in c.key])
        row = c.violations.agg(
            F.count(F.lit(1)).alias("violations"), F.min(named).alias("sample_key")
        ).select(
            F.lit(c.stage).alias("stage"),
            F.lit(c.scope).alias("scope"),
            F.lit(c.check).alias("check"),
            "violations",
            "sample_key",
            (F.col("violations") == 0).alias("passed"),
        )
        out = row if out is None else out.unionByName(row)
    return out
