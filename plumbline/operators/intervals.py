"""As-of joins by interval (IH-10): facts with the versions valid at their time.

A fact meets the versions of its key by an equi-join with the range as a residual test. That is fine
while a key has few versions. A *dense* key, one with more than ``dense`` of them, has its time cut
into cells, so that a fact is compared with a bounded number of versions that it does not match,
whatever the length of the history and however its versions overlap:

- *Cuts.* The instants at which versions begin or end are numbered in order of key and time (range
  partitions, no window over all). Every ``depth``-th is a cut, and so is every instant at which
  ``heavy`` or more versions begin or end. Strictly inside a cell lie fewer than ``depth * heavy``
  ends of versions, in dense and in sparse stretches alike.
- *Placing.* Cuts are put on a timeline with the distinct instants asked about (IH-11), which gives
  each its cell; the work is linear in rows and a hot key is split.
- *Versions.* A version is listed in the cells that its two ends lie in. The cells between, which it
  covers whole, are listed each where the versions of a key cover few (a history without overlaps
  does); otherwise as the nodes of a binary tree over cells, two per level at most, so a version
  over any number of cells takes few rows.
- *Facts.* The distinct times of facts look up their cell and, where the tree is in use, the nodes
  above it. All they find in a node above covers them.

Distinct ``(key, time)`` pairs are answered and facts join the answers by equality, so many facts of
one instant are looked up once. Adaptive execution splits a hot key's facts.

Facts that get their key from another relation (lines from their order) need not be shuffled a second
time for their version: ``asof_through`` lists the versions of a key that has few, and the list comes with
the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.timeline import HOT_ROWS
from plumbline.operators.history import asof_last, number_rows
from plumbline.sources.shared import checked_keys, cut_lineage, store

# A key with more versions than this is cut into cells.
DENSE = 256
# Instants from cut to cut, and how many ends at one instant make it a cut.
DEPTH, HEAVY = 32, 4
# A key whose versions cover, on average, up to so many whole cells has them listed cell by cell.
FLAT_CELLS = 4
NODES = "array<struct<_level:int,_node:bigint>>"
# Up to so many versions of a key are listed.
LISTED = 32


def asof(
    fact: DataFrame,
    hist: DataFrame,
    key: Sequence[str],
    ts: str,
    dense: int | None = DENSE,
    counted: DataFrame | None = None,
    depth: int = DEPTH,
    heavy: int = HEAVY,
    flat_cells: int = FLAT_CELLS,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """IH-10. Each fact with the version valid at its time; version columns are NULL where
    there is none. Where versions of a key overlap (IH-13 reports it), a fact is repeated with
    each version valid at its time.

    Dense keys are counted first, in ``counted`` where a cheaper relation has at least as many rows
    per key, such as the change log; ``dense=None`` says that there are none. The list of dense
    keys is broadcast only where it is small.
    """
    key = list(key)
    if dense is None:
        return _compared(fact, hist, key, ts)
    source = hist if counted is None else counted
    sizes = source.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    found = cut_lineage(sizes.where(F.col("_n") > dense).select(*key))
    if found.isEmpty():
        return _compared(fact, hist, key, ts)
    found = checked_keys(found)
    rest = _compared(fact.join(found, key, "left_anti"), hist.join(found, key, "left_anti"), key, ts)
    probes, nodes = cells(
        fact.join(found, key, "left_semi"), hist.join(found, key, "left_semi"), key, ts, depth, heavy, flat_cells, hot_rows
    )
    own = [c for c in hist.columns if c not in key]
    answers = (
        probes.join(nodes, [*key, "_level", "_node"])
        .where((F.col("valid_from") <= F.col("_at")) & (F.col("_at") < F.col("valid_to")))
        .select(*key, "_at", *own)
    )
    at = F.col(ts).cast(hist.schema["valid_from"].dataType)
    answered = fact.join(found, key, "left_semi").withColumn("_at", at).join(answers, [*key, "_at"], "left").drop("_at")
    return rest.unionByName(answered.select(*rest.columns))


def asof_through(
    fact: DataFrame,
    carrier: DataFrame,
    on: Column,
    hist: DataFrame,
    key: Sequence[str],
    ts: str,
    how: str = "inner",
    listed: int = LISTED,
    counted: DataFrame | None = None,
    **dense,
) -> DataFrame:
    """IH-10 for facts that are joined with ``carrier`` (by ``on`` and ``how``, inner or left) to get their
    ``key``. Each row of ``carrier`` brings the versions of its key as a list, so the facts are shuffled
    for that join alone. Keys with more than ``listed`` versions go the way of ``asof``, which gets ``dense``;
    they are counted first, in ``counted`` where a cheaper relation has at least as many rows per key."""
    key, own = list(key), [c for c in hist.columns if c not in key]
    source = hist if counted is None else counted
    sizes = source.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    found = cut_lineage(sizes.where(F.col("_n") > listed).select(*key))
    many = None if found.isEmpty() else checked_keys(found)
    few = hist if many is None else hist.join(many, key, "left_anti")
    lists = few.groupBy(*key).agg(F.collect_list(F.struct(*own)).alias("_v"))
    # One list a column takes less room in a shuffle than a list of rows.
    lists = lists.select(*key, *[F.col(f"_v.{c}").alias(f"_v_{c}") for c in own])
    carried = carrier.join(lists, key, "left")
    if many is not None:
        carried = carried.join(many.withColumn("_many", F.lit(True)), key, "left")
    joined = fact.join(carried, on, how)
    versions = F.arrays_zip(*[F.col(f"_v_{c}").alias(c) for c in own])
    valid = F.filter(versions, lambda v: (v["valid_from"] <= F.col(ts)) & (F.col(ts) < v["valid_to"]))
    kept = [*fact.columns, *carrier.columns]
    short = joined if many is None else joined.where(F.col("_many").isNull())
    out = short.withColumn("_v", F.explode_outer(valid)).select(*kept, "_v.*")
    if many is None:
        return out
    rest = joined.where("_many").select(*kept)
    return out.unionByName(asof(rest, hist.join(many, key, "left_semi"), key, ts, **dense).select(*out.columns))


def _compared(fact: DataFrame, hist: DataFrame, key: list[str], ts: str) -> DataFrame:
    versions = hist.withColumnsRenamed({k: f"_h_{k}" for k in key})
    condition = (F.col("valid_from") <= F.col(ts)) & (F.col(ts) < F.col("valid_to"))
    for k in key:
        condition = condition & (F.col(k) == F.col(f"_h_{k}"))
    return fact.join(versions, condition, "left").drop(*[f"_h_{k}" for k in key])


def cuts_of(versions: DataFrame, key: list[str], depth: int, heavy: int) -> DataFrame:
    """``key, _at, _cell``: where each cell begins, numbered in the order of key and time."""
    ends = versions.select(*key, F.explode(F.array("valid_from", "valid_to")).alias("_at"))
    instants = ends.groupBy(*key, "_at").agg(F.count(F.lit(1)).alias("_ends"))
    numbered = number_rows(instants, [*key, "_at"], "_nth")
    # A key's first instant need not be a cut: before its first cut is the last cell of the key
    # before, so it is made one.
    first = numbered.groupBy(*key).agg(F.min("_nth").alias("_first"))
    cut = (F.col("_nth") % depth == 0) | (F.col("_ends") >= heavy) | (F.col("_nth") == F.col("_first"))
    return number_rows(numbered.join(first, key).where(cut).select(*key, "_at"), [*key, "_at"], "_cell")


def cells(
    fact: DataFrame, hist: DataFrame, key: list[str], ts: str, depth: int, heavy: int, flat_cells: int,
    hot_rows: int | None = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The distinct times of facts and the versions, each by the nodes ``_level, _node`` in which
    they meet."""
    kind = hist.schema["valid_from"].dataType
    versions = hist.where(F.col("valid_from") < F.col("valid_to"))
    cuts = store(cuts_of(versions, key, depth, heavy).withColumn("_start", F.col("_at")), "cuts")
    times = fact.select(*key, F.col(ts).cast(kind).alias("_at")).dropna().distinct()
    ends = versions.select(*key, F.explode(F.array("valid_from", "valid_to")).alias("_at"))
    asked = times.withColumn("_fact", F.lit(True)).unionByName(ends.withColumn("_fact", F.lit(False)))
    asked = asked.groupBy(*key, "_at").agg(F.max("_fact").alias("_fact"))
    placed = store(
        asof_last(asked, cuts.withColumnRenamed("_at", "_begins"), key, "_at", "_begins", "_cell", ["_cell", "_start"], hot_rows),
        "placed",
    )

    def end(column: str, name: str) -> DataFrame:
        inside = (F.col("_at") > F.col("_start")).alias(f"{name}_inside")
        return placed.select(*key, F.col("_at").alias(column), F.col("_cell").alias(name), inside)

    known = versions.join(end("valid_from", "_f"), [*key, "valid_from"]).join(end("valid_to", "_t"), [*key, "valid_to"])
    # Cells that hold an end, and the whole cells between.
    low = F.col("_f") + F.col("_f_inside").cast("int")
    partly = F.array_distinct(
        F.array_compact(F.array(F.when(F.col("_f_inside"), F.col("_f")), F.when(F.col("_t_inside"), F.col("_t"))))
    )
    known = known.withColumns({"_low": low, "_high": F.col("_t") - 1, "_partly": partly})
    known = store(known.drop("_f", "_t", "_f_inside", "_t_inside"), "ends")
    whole = F.greatest(F.col("_high") - F.col("_low") + 1, F.lit(0))
    flat = known.groupBy(*key).agg((F.sum(whole) <= flat_cells * F.count(F.lit(1))).alias("_flat"))
    flat = store(flat, "flat")
    node = lambda level, at: F.struct(level.cast("int").alias("_level"), at.alias("_node"))
    each = F.when(
        F.col("_low") <= F.col("_high"), F.transform(F.sequence("_low", "_high"), lambda c: node(F.lit(0), c))
    )
    here = F.transform("_partly", lambda c: node(F.lit(0), c))
    listed = F.when(F.col("_flat"), each).otherwise(tree_nodes(F.col("_low"), F.col("_high"), node))
    entries = F.concat(here, F.coalesce(listed, F.array().cast(NODES)))
    nodes = store(
        known.join(flat, key).withColumn("_e", F.explode(entries)).select(*hist.columns, "_e.*"), "nodes"
    )
    levels = nodes.groupBy(*key).agg(F.collect_set("_level").alias("_levels"))
    probes = (
        placed.where("_fact AND _cell IS NOT NULL").join(levels, key)
        .withColumn("_level", F.explode("_levels"))
        .select(*key, "_at", "_level", F.call_function("shiftright", F.col("_cell"), F.col("_level")).alias("_node"))
    )
    return probes, nodes


def tree_nodes(low: Column, high: Column, node) -> Column:
    """The nodes of a binary tree over cells that make up ``low`` to ``high``: at each level what
    is left of both ends once pairs are joined upwards."""
    levels = F.when(low <= high, F.sequence(F.lit(0), F.floor(F.log2(high - low + 2)).cast("int")))
    step = lambda level: F.call_function("shiftleft", F.lit(1).cast("bigint"), level)

    def at(level: Column) -> Column:
        left = F.call_function("shiftright", low + step(level) - 1, level)
        right = F.call_function("shiftright", high + 1, level)
        open_ = left < right
        return F.array_compact(
            F.array(
                F.when(open_ & (left % 2 == 1), node(level, left)),
                F.when(open_ & (right % 2 == 1), node(level, right - 1)),
            )
        )

    return F.flatten(F.transform(levels, at))
