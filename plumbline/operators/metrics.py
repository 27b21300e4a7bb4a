"""Metrics (MT-01 to MT-04). Money is summed as decimals, so a sum does not depend on the
order of rows or partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_rows() -> Column:
    return F.count(F.lit(1))


def total(value: Column) -> Column:
    return F.sum(value).cast("double")


def ratio(over: Column, under: Column) -> Column:
    """A ratio of sums, not a mean of ratios."""
    return F.try_divide(F.sum(over).cast("double"), F.sum(under).cast("double"))


def metric(df: DataFrame, by: Sequence[str], defs: Mapping[str, Column]) -> DataFrame:
    """MT-01. Metrics at one grain; combined before the shuffle."""
    return df.groupBy(*by).agg(*[c.alias(name) for name, c in defs.items()])


def metric_cube(
    df: DataFrame, sets: Sequence[Sequence[str]], by: Sequence[str], defs: Mapping[str, Column]
) -> DataFrame:
    """MT-02. Metrics at many grains; ``level`` is the grouping id. The rows are first
    aggregated to the finest grain when every metric is a plain count or sum: pass the
    result of ``metric`` as ``df`` for that, as the grouping sets repeat each input row."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]).agg(
        F.grouping_id().cast("int").alias("level"), *[c.alias(n) for n, c in defs.items()]
    )


def metric_change(
    df: DataFrame, by: Sequence[str], period: str, value: str, preceding: Column
) -> DataFrame:
    """MT-03. A metric against its previous period, which ``preceding`` computes from a row's
    own; NULL where that period has no row. ``df`` is a metric already at the grain ``(by,
    period)``, so a group is as long as there are periods."""
    w = Window.partitionBy(*by).orderBy(period)
    before = F.when(F.lag(period).over(w) == preceding, F.lag(value).over(w))
    return df.withColumn("previous", before).withColumn("change", F.col(value) - F.col("previous"))


def metric_topk(df: DataFrame, by: Sequence[str], k: int, order: Sequence[Column]) -> DataFrame:
    """MT-04. Top ``k`` within a group. Spark keeps ``k`` rows per group in every map task
    before the shuffle, so a hot group arrives already cut."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
