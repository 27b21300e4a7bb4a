"""Event classification by ordered rules with explicit holes (EC-01 to EC-09).

Policy is data: a rule is a row of a relation, its predicate an expression over the input
columns. A predicate that is NULL does not match, the first true rule wins, and a row that no
rule covers gets the literal rule id ``HOLE``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.timeline import HOT_ROWS, Timeline
from plumbline.functions.values import compact
from plumbline.sources.relations import relation

HOLE = "HOLE"
UNDECIDED = "UNDECIDED"
START = "START"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    ord: int
    authority: int
    predicate: str
    reads: tuple[str, ...]
    disposition: str


RULE_SCHEMA = (
    "rule_id string, ord int, authority int, predicate string, reads array<string>, "
    "disposition string"
)
# A policy is read on the driver to become one expression; more rules than this belong in
# an equality table (EC-07).
MAX_RULES = 2_000


def rules_relation(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return relation(spark, RULE_SCHEMA, [(*astuple(r)[:4], list(r.reads), r.disposition) for r in rules])


def read_rules(table: DataFrame) -> list[Rule]:
    """A rules relation as a policy, in its order; refuses a table beyond ``MAX_RULES``."""
    rows = (
        table.select("rule_id", "ord", "authority", "predicate", "reads", "disposition")
        .orderBy("ord", "rule_id").take(MAX_RULES + 1)
    )
    if len(rows) > MAX_RULES:
        raise ValueError("too many rules for one expression; use classify_join")
    return [Rule(r[0], r[1], r[2], r[3], tuple(r[4]), r[5]) for r in rows]


def _evidence(rule: Rule) -> Column:
    pairs = []
    for name in rule.reads:
        pairs += [F.lit(name), F.col(name).cast("string")]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def _first_match(rules: Sequence[Rule], value, otherwise: Column) -> Column:
    """One flat CASE; nested conditions overflow the planner's stack at a few hundred rules."""
    chain = None
    for rule in rules:
        test = F.expr(rule.predicate)
        chain = F.when(test, value(rule)) if chain is None else chain.when(test, value(rule))
    return otherwise if chain is None else chain.otherwise(otherwise)


def _ordered(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: r.ord)


def rule_of(rules: Sequence[Rule]) -> Column:
    """Only the winning rule id, as one expression."""
    return _first_match(_ordered(rules), lambda r: F.lit(r.rule_id), F.lit(HOLE))


def classify(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """EC-01. Add ``rule_id``, ``disposition`` and ``evidence`` (the values the winning
    predicate read). Row-local: no shuffle, and it runs unchanged on a stream."""
    return _apply(df, _ordered(rules))


def _apply(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    def verdict(rule_id: str, disposition: str, evidence: Column) -> Column:
        return F.struct(
            F.lit(rule_id).alias("rule_id"),
            F.lit(disposition).alias("disposition"),
            evidence.alias("evidence"),
        )

    hole = verdict(HOLE, UNDECIDED, F.create_map().cast("map<string,string>"))
    won = _first_match(rules, lambda r: verdict(r.rule_id, r.disposition, _evidence(r)), hole)
    return df.withColumn("_won", won).select(*df.columns, "_won.*")


def holes(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """EC-02. The rows no rule covers."""
    return df.withColumn("rule_id", rule_of(rules)).where(F.col("rule_id") == HOLE)


def _matches(rules: Sequence[Rule], field: str) -> Column:
    return compact(
        [F.when(F.expr(r.predicate), F.lit(getattr(r, field))) for r in _ordered(rules)]
    )


def matches(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """EC-03. All rules a row matches, in rule order."""
    return df.withColumn("matched", _matches(rules, "rule_id"))


def conflicts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """EC-04. Rows on which two matching rules differ in disposition. Order still decides."""
    return (
        matches(df, rules)
        .withColumn("_said", _matches(rules, "disposition"))
        .where(F.size("_said") > 1)
        .drop("_said")
    )


def coverage(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """EC-05. Per rule: rows matched, won, and shadowed by an earlier rule. A rule that never
    matches is listed with zeros. Counts combine before the shuffle."""
    seen = (
        df.select(_matches(rules, "rule_id").alias("matched"))
        .select(F.posexplode("matched").alias("place", "rule_id"))
        .groupBy("rule_id")
        .agg(
            F.count(F.lit(1)).alias("matched"),
            F.count_if(F.col("place") == 0).alias("won"),
        )
    )
    every = relation(df.sparkSession, "rule_id string", [(r.rule_id,) for r in rules])
    zero = F.lit(0).cast("bigint")
    return every.join(seen, "rule_id", "left").select(
        "rule_id",
        F.coalesce("matched", zero).alias("matched"),
        F.coalesce("won", zero).alias("won"),
        F.coalesce(F.col("matched") - F.col("won"), zero).alias("shadowed"),
    )


def classify_by_authority(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """EC-06. The highest authority decides, rule order only within it."""
    return _apply(df, sorted(rules, key=lambda r: (-r.authority, r.ord)))


def classify_join(df: DataFrame, rules_tbl: DataFrame, on: Sequence[str]) -> DataFrame:
    """EC-07. Many equality rules as a join. ``rules_tbl`` holds the columns of ``on`` plus
    ``rule_id, ord, disposition``. Each value's first rule is chosen before the join, so the
    join adds no rows and the facts need no aggregate."""
    first = (
        rules_tbl.groupBy(*on)
        .agg(F.min_by(F.struct("rule_id", "disposition"), "ord").alias("_first"))
        .select(*on, "_first.*")
    )
    return df.join(first, list(on), "left").withColumns(
        {
            "rule_id": F.coalesce("rule_id", F.lit(HOLE)),
            "disposition": F.coalesce("disposition", F.lit(UNDECIDED)),
        }
    )


def classify_transition(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    state: str,
    legal: DataFrame,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """EC-08. Classify an event by the one before it of the same entity. ``legal`` holds
    ``prior, current, rule_id, disposition``; the first event has prior ``START``."""
    timeline = Timeline(df, key, order, hot_rows).previous([state], "_before")
    chained = timeline.rows().withColumn("prior", F.coalesce(f"_before.{state}", F.lit(START)))
    table = legal.withColumnRenamed("current", state)
    return (
        chained.drop("_before")
        .join(table, ["prior", state], "left")
        .withColumns(
            {
                "rule_id": F.coalesce("rule_id", F.lit(HOLE)),
                "disposition": F.coalesce("disposition", F.lit(UNDECIDED)),
            }
        )
    )


def hole_profile(
    df: DataFrame, rules: Sequence[Rule], dims: Sequence[str], k: int | None = None
) -> DataFrame:
    """EC-09. Which value combinations fall into the hole; the ``k`` most frequent, or all."""
    profile = holes(df, rules).groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    if k is None:
        return profile
    return profile.orderBy(F.col("n").desc(), *[F.col(d).asc_nulls_first() for d in dims]).limit(k)
