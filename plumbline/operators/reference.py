"""Reference interpretation (RF-01 to RF-07).

Reference tables are joined without a hint: Spark broadcasts one whose size is below
``spark.sql.autoBroadcastJoinThreshold`` (planned or measured at run time) and otherwise
shuffles both sides, where adaptive execution splits a hot code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.intervals import asof

UNKNOWN = "UNKNOWN"


def decode(
    df: DataFrame, ref: DataFrame, key: str, meaning: str, default: str = UNKNOWN
) -> DataFrame:
    """RF-01. Add ``meaning`` of the code in ``key``; a code with none gets ``default``.
    ``ref`` must hold one row per code (RF-03 reports where it does not)."""
    return df.join(ref.select(key, meaning), key, "left").withColumn(
        meaning, F.coalesce(meaning, F.lit(default))
    )


def unresolved(df: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """RF-02. Codes with no meaning and how often they occur. Rows are counted per code
    first, so only distinct codes meet the reference table."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(ref, key, "left_anti")


def ambiguous(ref: DataFrame, key: str, meaning: str) -> DataFrame:
    """RF-03. Codes with more than one meaning; decoding by them would repeat rows."""
    return (
        ref.groupBy(key)
        .agg(F.count_distinct(meaning).alias("meanings"), F.count(F.lit(1)).alias("entries"))
        .where((F.col("meanings") > 1) | (F.col("entries") > 1))
    )


def decode_at(
    df: DataFrame, ref: DataFrame, key: str, ts: str, meaning: str, default: str = UNKNOWN
) -> DataFrame:
    """RF-04. The meaning that was valid at the row's own time. ``ref`` holds half-open
    ``[valid_from, valid_to)`` meanings per code: an as-of join (IH-10)."""
    dated = ref.select(key, "valid_from", "valid_to", meaning)
    return (
        asof(df, dated, [key], ts)
        .withColumn(meaning, F.coalesce(meaning, F.lit(default)))
        .drop("valid_from", "valid_to")
    )


# Up to this many bands a flat CASE beats a join: no shuffle and no broadcast.
CASE_BANDS = 200


def decode_band(
    df: DataFrame, bands: Sequence[tuple[str, float, float | None]], col: str, name: str = "band"
) -> DataFrame:
    """RF-05. Number to half-open band ``[lo, hi)``; ``hi=None`` is unbounded. ``bands`` is a
    policy literal; a band table of any size goes to ``decode_band_table``."""
    if len(bands) > CASE_BANDS:
        raise ValueError("too many bands for a CASE expression; use decode_band_table")
    chain = None
    for label, lo, hi in bands:
        test = F.col(col) >= lo if hi is None else (F.col(col) >= lo) & (F.col(col) < hi)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return df.withColumn(name, F.lit(UNKNOWN) if chain is None else chain.otherwise(UNKNOWN))


def decode_band_table(
    df: DataFrame, bands: DataFrame, col: str, width: float, name: str = "band"
) -> DataFrame:
    """RF-05 for a band table of any size: an equi-join on ``floor(value / width)`` instead of
    a range join. A band is repeated once per cell it touches, an unbounded one up to the
    greatest value present. ``width`` near the usual band width keeps both sides small."""
    cell = F.floor(F.col(col) / width)
    top = df.agg(F.max(cell).alias("top")).scalar()
    cells = (
        bands.withColumn("_top", top)
        .withColumn("_first", F.floor(F.col("lo") / width))
        .withColumn(
            "_last",
            F.least(F.coalesce(F.floor(F.col("hi") / width), F.col("_top")), F.col("_top")),
        )
        .where(F.col("_first") <= F.col("_last"))
        .select(
            F.col("lo").alias("_lo"),
            F.col("hi").alias("_hi"),
            F.col("label").alias(name),
            F.explode(F.sequence("_first", "_last")).alias("_cell"),
        )
    )
    keyed = df.withColumn("_own", cell)
    return (
        keyed.join(
            cells,
            (F.col("_own") == F.col("_cell"))
            & (F.col(col) >= F.col("_lo"))
            & (F.col("_hi").isNull() | (F.col(col) < F.col("_hi"))),
            "left",
        )
        .withColumn(name, F.coalesce(name, F.lit(UNKNOWN)))
        .drop("_own", "_cell", "_lo", "_hi")
    )


def decode_hierarchy(
    df: DataFrame, levels: Sequence[tuple[DataFrame, str, str]], labels: Sequence[str]
) -> DataFrame:
    """RF-06. Walk a hierarchy upward. ``levels`` are ``(table, child column, table key)`` from
    the bottom. The tables are joined to each other first, so ``df`` is joined once."""
    folded, first, first_key = None, None, None
    for table, child, table_key in reversed(levels):
        above = folded
        folded = table if above is None else table.join(
            above, table[first] == above[first_key], "left"
        )
        first, first_key = child, table_key
    path = folded.select(F.col(first_key).alias("_level"), *labels)
    out = df.join(path, F.col(first) == F.col("_level"), "left").drop("_level")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in labels})


def decode_nullsafe(
    df: DataFrame, ref: DataFrame, key: str, meaning: str, default: str = UNKNOWN
) -> DataFrame:
    """RF-07. As RF-01, but NULL is a code of its own."""
    r = ref.select(F.col(key).alias("_code"), F.col(meaning))
    return (
        df.join(r, F.col(key).eqNullSafe(F.col("_code")), "left")
        .withColumn(meaning, F.coalesce(meaning, F.lit(default)))
        .drop("_code")
    )


def lookup(pairs: Sequence[tuple[str, str]], col: str, default: str = UNKNOWN) -> Column:
    """A handful of fixed codes as one flat CASE."""
    chain = F.when(F.col(col) == pairs[0][0], pairs[0][1])
    for code, label in pairs[1:]:
        chain = chain.when(F.col(col) == code, label)
    return chain.otherwise(default)
