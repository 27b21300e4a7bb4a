"""Ordered computation per key that does not pile a hot key onto one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here a key with
more than ``hot_rows`` rows is cut into consecutive time slices; the window then runs per
``(key, slice)`` and one carried value per slice stitches the slices together. All other
keys stay in one slice.

Rows per key are counted first, in a job of its own (one narrow scan, combined before the
shuffle). Where no key is hot the plan is the plain window and nothing more.

Slices are ranges of the whole order: the rows of hot keys are range-partitioned by key and order
columns, so a burst, or any number of rows at one instant, is cut as finely as it is dense. Those
rows are placed and stored once, as a second sampling of the ranges could place them differently.

The list of hot keys is broadcast where it is small. Each of its rows stands for more than
``hot_rows`` input rows.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from plumbline.sources.shared import checked_keys, cut_lineage, store

HOT_ROWS = 10_000_000
SLICE = "_slice"
# A hot key gets this many slices per hot_rows rows.
SLICES_PER_QUOTA = 4


def hot_keys(df: DataFrame, key: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and their rows."""
    return (
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    )


def join_on(left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: bool) -> DataFrame:
    """Left join by equal columns; with ``null_safe`` NULL equals NULL."""
    if not null_safe:
        return left.join(right, list(on), "left")
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, match, "left").drop(*[f"_r_{c}" for c in on])


class Timeline:
    """Rows of each key in the order of ``order``.

    ``order`` must be a total order within a key. ``counted`` is a cheaper relation with at
    least as many rows per key to find the hot keys in, such as the input that ``df``
    aggregates. ``hot_rows=None`` says the groups are known to be small, and leaves the
    windows unsplit.
    """

    def __init__(
        self,
        df: DataFrame,
        key: Sequence[str],
        order: Sequence[str],
        hot_rows: int | None = HOT_ROWS,
        counted: DataFrame | None = None,
    ):
        self.key, self.order, self.frame = list(key), list(order), df
        self.split = self.null_safe = False
        if hot_rows is None:
            return
        source = df if counted is None else counted
        hot = cut_lineage(hot_keys(source, self.key, hot_rows))
        total = hot.agg(F.sum("_rows")).first()[0]
        if total is None:
            return
        # NULL is one key, as in any window; the null-safe join is used only where it is hot.
        missing = F.lit(False)
        for k in self.key:
            missing = missing | F.col(k).isNull()
        self.null_safe = not hot.where(missing).isEmpty()
        self.split = True
        marked = join_on(df, checked_keys(hot), self.key, self.null_safe)
        slices = math.ceil(total * SLICES_PER_QUOTA / hot_rows)
        placed = store(
            marked.where(F.col("_rows").isNotNull())
            .repartitionByRange(slices, *self.key, *self.order)
            .withColumn(SLICE, F.spark_partition_id() + 1)
            .drop("_rows"),
            "slices",
        )
        rest = marked.where(F.col("_rows").isNull()).withColumn(SLICE, F.lit(0)).drop("_rows")
        self.frame = placed.unionByName(rest)

    def _with(self, frame: DataFrame) -> Timeline:
        other = copy.copy(self)
        other.frame = frame
        return other

    def where(self, condition: Column) -> Timeline:
        return self._with(self.frame.where(condition))

    def rows(self) -> DataFrame:
        return self.frame.drop(SLICE)

    def _window(self) -> Window:
        part = [*self.key, SLICE] if self.split else self.key
        return Window.partitionBy(*part).orderBy(*self.order)

    def _stitch(
        self, name: str, local: Column, end: Column, carry: Column, combine: Column
    ) -> Timeline:
        """Add ``name``: the value inside the slice combined with what earlier (or later)
        slices hand over. ``end`` is the one value a slice hands on."""
        frame = self.frame.withColumn(name, local)
        if not self.split:
            return self._with(frame)
        ends = (
            self.frame.where(F.col(SLICE) > 0)
            .groupBy(*self.key, SLICE)
            .agg(end.alias("_end"))
        )
        handed = ends.select(*self.key, SLICE, carry.alias("_carry"))
        return self._with(
            join_on(frame, handed, [*self.key, SLICE], self.null_safe)
            .withColumn(name, combine)
            .drop("_carry")
        )

    def previous(self, values: Sequence[str], name: str) -> Timeline:
        """Struct of ``values`` on the row before; NULL on a key's first row."""
        value = F.struct(*values)
        slices = Window.partitionBy(*self.key).orderBy(SLICE)
        return self._stitch(
            name,
            F.lag(value).over(self._window()),
            F.max_by(value, F.struct(*self.order)),
            F.lag("_end").over(slices),
            F.coalesce(F.col(name), F.col("_carry")),
        )

    def next(self, values: Sequence[str], name: str) -> Timeline:
        """Struct of ``values`` on the row after; NULL on a key's last row."""
        value = F.struct(*values)
        slices = Window.partitionBy(*self.key).orderBy(SLICE)
        return self._stitch(
            name,
            F.lead(value).over(self._window()),
            F.min_by(value, F.struct(*self.order)),
            F.lead("_end").over(slices),
            F.coalesce(F.col(name), F.col("_carry")),
        )

    def last_known(self, value: Column, name: str) -> Timeline:
        """The latest non-NULL ``value`` up to and including this row."""
        upto = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = (
            Window.partitionBy(*self.key)
            .orderBy(SLICE)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return self._stitch(
            name,
            F.last(value, ignorenulls=True).over(upto),
            F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order))),
            F.last("_end", ignorenulls=True).over(before),
            F.coalesce(F.col(name), F.col("_carry")),
        )

    def running_sum(self, value: Column, name: str) -> Timeline:
        """Sum of ``value`` up to and including this row."""
        upto = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = (
            Window.partitionBy(*self.key)
            .orderBy(SLICE)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return self._stitch(
            name,
            F.sum(value).over(upto),
            F.sum(value),
            F.sum("_end").over(before),
            F.when(F.col("_carry").isNull(), F.col(name)).otherwise(
                F.coalesce(F.col(name), F.lit(0)) + F.col("_carry")
            ),
        )

    def max_before(self, value: Column, name: str) -> Timeline:
        """Greatest ``value`` on the rows before this one; NULL on a key's first row."""
        before_row = self._window().rowsBetween(Window.unboundedPreceding, -1)
        before = (
            Window.partitionBy(*self.key)
            .orderBy(SLICE)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return self._stitch(
            name,
            F.max(value).over(before_row),
            F.max(value),
            F.max("_end").over(before),
            F.greatest(F.col(name), F.col("_carry")),
        )
