"""Policies of any number of rules (EC-01 as an index).

A rule here is terms, not text: columns that must equal values, one column that must lie in a half-open
range, and names of tests that must hold. The rules with the same columns form a *shape*; the
relation of rules is indexed by shape, equality values and cells of the range. A row looks itself up
once per shape, ranges and tests are checked on what it finds, and the lowest rule in order wins, by a
minimum that combines before the shuffle. The index is joined like any other relation: broadcast where
Spark finds it small, shuffled where it is not. Only the shapes, a handful whatever the number of
rules, reach the driver.

Named tests are the expressions that fit no term; each is evaluated once per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.classify import HOLE, UNDECIDED
from plumbline.operators.history import number_rows
from plumbline.sources.shared import store

# The rules relation. ``ranged`` is NULL where the rule has no range; ``lo`` and ``hi`` may be NULL for
# no bound on that side.
TERMS_SCHEMA = (
    "rule_id string, ord bigint, disposition string, equals map<string,string>, ranged string, lo double, hi double, "
    "tests array<string>"
)
MAX_SHAPES = 64
# Cells of a range that one rule may be listed in, before cells are made wider.
CELLS = 8
NULL_VALUE = "\\N"


def _text(values: Column) -> Column:
    """Equality values as one text."""
    parts = F.transform(values, lambda v: F.replace(F.coalesce(v, F.lit(NULL_VALUE)), F.lit("|"), F.lit("\\|")))
    return F.array_join(parts, "|")


def _sorted_values(equals: Column) -> Column:
    return F.transform(F.array_sort(F.map_entries(equals)), lambda e: e["value"])


def indexed(rules: DataFrame) -> tuple[DataFrame, list[tuple[str, tuple[str, ...], str | None, float, int, int]]]:
    """The rules with ``_rank`` (their order), ``_shape``, ``_value`` and ``_cell``, one row per cell;
    and the shapes: name, equality columns, range column, cell width, first and last cell."""
    named = F.concat_ws("|", F.array_join(F.array_sort(F.map_keys("equals")), ","), F.coalesce("ranged", F.lit("")))
    ranked = store(
        number_rows(rules, ["ord", "rule_id"], "_rank").withColumns(
            {"_shape": named, "_value": _text(_sorted_values(F.col("equals")))}
        ),
        "rules",
    )
    width = F.percentile_approx(F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")), 0.5)
    shapes = ranked.groupBy("_shape").agg(
        F.first(F.array_sort(F.map_keys("equals"))).alias("columns"), F.first("ranged").alias("ranged"),
        F.coalesce(width, F.lit(1.0)).alias("width"),
        F.min(F.least("lo", "hi")).alias("least"), F.max(F.greatest("lo", "hi")).alias("most"),
    ).take(MAX_SHAPES + 1)
    if len(shapes) > MAX_SHAPES:
        raise ValueError("too many shapes of rules for one index")
    out, cells = [], F.array(F.lit(0).cast("bigint"))
    for s in shapes:
        ends = [s["least"] or 0.0, s["most"] or 0.0]
        first, last = (int(e // s["width"]) for e in ends)
        out.append((s["_shape"], tuple(s["columns"]), s["ranged"], s["width"], first - 1, last + 1))
        if s["ranged"] is not None:
            low = F.coalesce(_cell(F.col("lo"), s["width"]), F.lit(first - 1).cast("bigint"))
            high = F.coalesce(_cell(F.col("hi"), s["width"]), F.lit(last + 1).cast("bigint"))
            cells = F.when(F.col("_shape") == s["_shape"], F.when(low <= high, F.sequence(low, high))).otherwise(cells)
    # A rule over more cells than CELLS is listed once, in a cell that every row looks into as well.
    wide = F.size(cells) > CELLS
    listed = ranked.withColumn("_cell", F.explode(F.when(wide, F.array(F.lit(None).cast("bigint"))).otherwise(cells)))
    return store(listed.withColumn("_cell", F.coalesce("_cell", F.lit(WIDE))), "index"), out


WIDE = -(1 << 62)


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)).cast("bigint")


def classify_indexed(
    df: DataFrame, key: Sequence[str], rules: DataFrame, tests: Mapping[str, str] | None = None
) -> DataFrame:
    """``df`` with ``rule_id, disposition, evidence`` of the first rule in order that matches; a row
    that none matches gets ``HOLE``. ``key`` names the columns that identify a row; ``rules`` has
    TERMS_SCHEMA; ``tests`` maps the names that rules use to expressions. NULL equals nothing, lies in
    no range and passes no test."""
    key, tests = list(key), dict(tests or {})
    index, shapes = indexed(rules)
    nothing = F.create_map().cast("map<string,string>")
    if not shapes:
        return df.select("*", F.lit(HOLE).alias("rule_id"), F.lit(UNDECIDED).alias("disposition"), nothing.alias("evidence"))
    columns = sorted({c for s in shapes for c in [*s[1], *([s[2]] if s[2] else [])]})
    probes = []
    for name, equal, ranged, width, first, last in shapes:
        known = F.lit(True)
        for c in equal:
            known = known & F.col(c).isNotNull()
        value = _text(F.array(*[F.col(c).cast("string") for c in equal])) if equal else F.lit("")
        number = F.col(ranged).cast("double") if ranged else F.lit(None).cast("double")
        cells = [F.lit(0).cast("bigint")]
        if ranged:
            known = known & number.isNotNull() & ~F.isnan(number)
            clamped = F.greatest(F.lit(first), F.least(F.lit(last), F.floor(number / F.lit(width)))).cast("bigint")
            cells = [clamped, F.lit(WIDE).cast("bigint")]
        for cell in cells:
            probe = F.struct(F.lit(name).alias("_shape"), value.alias("_value"), cell.alias("_cell"), number.alias("_number"))
            probes.append(F.when(known, probe))
    passed = F.array_compact(F.array(*[F.when(F.expr(e), F.lit(n)) for n, e in tests.items()])) if tests else F.array().cast("array<string>")
    asked = df.select(*key, passed.alias("_passed"), F.explode(F.array_compact(F.array(*probes))).alias("_p")).select(
        *key, "_passed", "_p.*"
    )
    terms = index.select("_shape", "_value", "_cell", "_rank", "lo", "hi", F.coalesce("tests", F.array()).alias("_tests"))
    inside = (F.col("lo").isNull() | (F.col("lo") <= F.col("_number"))) & (
        F.col("hi").isNull() | (F.col("_number") < F.col("hi"))
    )
    met = asked.join(terms, ["_shape", "_value", "_cell"]).where(
        inside & (F.size(F.array_except("_tests", "_passed")) == 0)
    )
    won = met.groupBy(*key).agg(F.min("_rank").alias("_rank"))
    reads = F.concat(F.array_sort(F.map_keys("equals")), F.array_compact(F.array("ranged")))
    verdict = index.dropDuplicates(["_rank"]).select("_rank", "rule_id", "disposition", reads.alias("_reads"))
    own = F.create_map(*[part for c in columns for part in (F.lit(c), F.col(c).cast("string"))]) if columns else F.create_map()
    evidence = F.map_filter(own.cast("map<string,string>"), lambda name, _: F.array_contains("_reads", name))
    found = won.join(verdict, "_rank").drop("_rank")
    return df.join(found, key, "left").select(
        *df.columns, F.coalesce("rule_id", F.lit(HOLE)).alias("rule_id"),
        F.coalesce("disposition", F.lit(UNDECIDED)).alias("disposition"),
        F.coalesce(evidence, nothing).alias("evidence"),
    )
