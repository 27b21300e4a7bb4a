"""What the operators share: stored tables, row keys, ordered totals, connected components.

Columns made inside an operator start with ``_pl_``, so extra columns of the caller, whatever
their names, pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.shared import fresh_path

# An ordered total is cut into slices of about this many rows, and into 256 at least.
SLICE_ROWS = 100_000
LEAST_SLICE_DIGITS = 2


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back. It outlives executors,
    is computed once, and later steps read only the columns they need."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def order_key(salt: str, column: str) -> Column:
    """A hash-random order of ids as 32 hexadecimal digits; a null id takes part as text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{salt}:"), text))


def slice_digits(rows: int, least: int = LEAST_SLICE_DIGITS) -> int:
    """Leading digits of an order key that cut ``rows`` rows into slices of SLICE_ROWS."""
    slices = max(1, rows / SLICE_ROWS)
    return max(least, math.ceil(math.log(slices, 16)))


def total_before(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    ties: Sequence[str],
    value: Column,
    name: str,
    rows: int,
    measured: DataFrame | None = None,
    least_digits: int = LEAST_SLICE_DIGITS,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group that come before this
    one in the order of ``key`` (an ``order_key``), then ``ties``.

    The key is uniform, so its leading digits are ranges of equal share: each range of a group
    is summed in a window of its own, and the ranges before it are added from one small table.
    A group of any size is spread over all tasks; ``rows`` are those of the largest. ``group`` columns
    must not be null.
    ``measured`` is a cheaper relation with the same groups, keys and values, where there is one.
    """
    digits = slice_digits(rows, least_digits)
    cut = F.substring(F.col(key), 1, digits)
    source = df if measured is None else measured
    sums = (
        source.groupBy(*group, cut.alias("_pl_slice")).agg(F.sum(value).alias("_pl_sum"))
    )
    earlier = (
        Window.partitionBy(*group).orderBy("_pl_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sums.select(
        *group, "_pl_slice", F.coalesce(F.sum("_pl_sum").over(earlier), F.lit(0)).alias("_pl_off")
    )
    inside = (
        Window.partitionBy(*group, "_pl_slice")
        .orderBy(key, *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.withColumn("_pl_slice", cut)
        .join(offsets, [*group, "_pl_slice"])
        .withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_pl_off"))
        .drop("_pl_slice", "_pl_off")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges (a, b)`` as rows ``(node, component)``, the
    component being its smallest node. Nodes without an edge are not listed.

    Rounds of two steps on stored edges until every node has one edge, to a root: every node's
    larger neighbours are linked to its smallest neighbour, then its smaller ones. Each step is
    one aggregation (a minimum, combined before the shuffle) and one join, so a node with very
    many edges is neither gathered nor expanded, and only a yes or no reaches the driver. Rounds
    grow with the logarithm of the longest chain; stars need one.
    """
    at = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct(),
        "edges",
    )
    while True:
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        large = (
            both.join(least, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("_m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = (
            large.join(least, "a")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("a").alias("a"), F.col("_m").alias("b")),
                        F.struct(F.col("b").alias("a"), F.col("_m").alias("b")),
                    )
                ).alias("e")
            )
            .select("e.a", "e.b")
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        at = stored(small, "edges")
        ends = at.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(
            at.select("b", F.lit(0), F.lit(1))
        )
        unsettled = (
            ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
            .where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("root") == 1)))
        )
        if unsettled.isEmpty():
            break
    roots = at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
