"""Logical warehouse model (WM-01 to WM-06)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UNKNOWN_SK = -1


def conform(
    df: DataFrame, target: StructType, sources: Mapping[str, str | Column] | None = None
) -> DataFrame:
    """WM-01. Project to the target schema: its names, types and order. ``sources`` maps a
    target name to the source column or expression where they differ."""
    sources = sources or {}

    def source(name: str) -> Column:
        found = sources.get(name, name)
        return F.col(found) if isinstance(found, str) else found

    return df.select(*[source(f.name).cast(f.dataType).alias(f.name) for f in target.fields])


def unify(dfs: Mapping[str, DataFrame], source_tag: str) -> DataFrame:
    """WM-02. Several sources as one relation, tagged; a column a source lacks is NULL."""
    out = None
    for tag, df in dfs.items():
        tagged = df.withColumn(source_tag, F.lit(tag))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def to_grain(df: DataFrame, grain: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """WM-03. Aggregate to the declared grain."""
    return df.groupBy(*grain).agg(*[c.alias(name) for name, c in aggs.items()])


def resolve_fk(df: DataFrame, dim: DataFrame, key: str, dim_key: str, sk: str) -> DataFrame:
    """WM-04. Natural key to surrogate key; an unknown member is -1 and the row is kept."""
    d = dim.select(F.col(dim_key).alias("_member"), F.col("sk").alias(sk))
    return (
        df.join(d, F.col(key) == F.col("_member"), "left")
        .withColumn(sk, F.coalesce(sk, F.lit(UNKNOWN_SK)))
        .drop("_member")
    )


def calendar(spark: SparkSession, lo: str | Column, hi: str | Column) -> DataFrame:
    """WM-05. One row per day from ``lo`` to ``hi``, both included."""
    bound = [(F.lit(b) if isinstance(b, str) else b).cast("date") for b in (lo, hi)]
    day = F.col("day")
    return spark.range(1).select(F.explode(F.sequence(*bound)).alias("day")).select(
        day,
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day_of_month"),
        (F.weekday(day) + 1).alias("iso_weekday"),
        F.weekofyear(day).alias("iso_week"),
        (day == F.last_day(day)).alias("is_month_end"),
    )


def infer_members(fact: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """WM-06. The dimension plus a placeholder for each key seen only in facts. Fact keys are
    made distinct (combined before the shuffle) before they meet the dimension."""
    seen = fact.select(F.col(key).alias(dim_key)).where(F.col(dim_key).isNotNull()).distinct()
    missing = seen.join(dim, dim_key, "left_anti").withColumn("is_inferred", F.lit(True))
    return dim.withColumn("is_inferred", F.lit(False)).unionByName(
        missing, allowMissingColumns=True
    )
