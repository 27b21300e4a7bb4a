"""Dimensions and facts (DF-01 to DF-07)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.timeline import HOT_ROWS, Timeline
from plumbline.functions.values import join_null_safe
from plumbline.operators.history import build_history, latest, number_rows
from plumbline.operators.intervals import asof
from plumbline.operators.warehouse import UNKNOWN_SK, resolve_fk
from plumbline.sources.shared import store


def dim_type1(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """DF-01. Current state per key with its surrogate key."""
    return number_rows(latest(df, key, order), key)


def dim_type2(
    log: DataFrame,
    key: Sequence[str],
    ts: str,
    tie: str,
    attrs: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """DF-02. Every version with a surrogate key in the order of ``(key, valid_from)``."""
    hist = build_history(log, key, ts, tie, attrs, hot_rows)
    return number_rows(hist, [*key, "valid_from"])


def fact_line(
    lines: DataFrame,
    version_dim: DataFrame,
    key: Sequence[str],
    ts: str,
    dims: Mapping[str, tuple[DataFrame, str, str]],
    counted: DataFrame | None = None,
) -> DataFrame:
    """DF-03. Transaction fact: the dimension version valid at ``ts`` and the surrogate key of
    every other dimension (``key column -> (dim, dim key, sk name)``); no row is lost."""
    versions = version_dim.withColumnRenamed("sk", "version_sk")
    out = asof(lines, versions, key, ts, counted=counted)
    out = out.withColumn("version_sk", F.coalesce("version_sk", F.lit(UNKNOWN_SK)))
    for column, (dim, dim_key, sk) in dims.items():
        out = resolve_fk(out, dim, column, dim_key, sk)
    return out


def fact_lifecycle(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """DF-04. Accumulating fact: one row per order with its milestones and lag in days; an order
    without lines has no milestones yet. Lines are aggregated before the join, to one row per
    order."""
    shipped = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    return orders.join(shipped, "o_orderkey", "left").select(
        "o_orderkey",
        F.col("o_orderdate").alias("ordered"),
        "first_ship",
        "last_ship",
        F.coalesce("n_lines", F.lit(0).cast("bigint")).alias("n_lines"),
        F.datediff("first_ship", "o_orderdate").alias("lag_days"),
        F.datediff("last_ship", "first_ship").alias("spread_days"),
    )


def fact_snapshot(
    hist: DataFrame, members: DataFrame, key: str, attr: str, lo: Column | str, hi: Column | str,
    unknown: str,
) -> DataFrame:
    """DF-05. State per key at each month end from ``lo`` to ``hi`` (dates, or scalars taken
    from the data). Every version lists the
    month ends it covers and every member all month ends; the two meet by equality. ``unknown``
    stands for a member with no version yet."""
    bound = lambda at: F.last_day((at if isinstance(at, Column) else F.lit(at)).cast("date"))
    first, last = bound(lo), bound(hi)

    def months(start: Column, stop: Column) -> Column:
        return F.explode(
            F.sequence(F.trunc(start, "month"), F.trunc(stop, "month"), F.expr("interval 1 month"))
        )

    # A version counts at a month end e when valid_from <= e < valid_to, e at midnight.
    covered = (
        hist.withColumn("_start", F.greatest(F.col("valid_from").cast("date"), first))
        .withColumn("_stop", F.least(F.col("valid_to").cast("date"), last))
        .where(F.col("_start") <= F.col("_stop"))
        .select(
            key, attr, "valid_from", "valid_to",
            months(F.col("_start"), F.col("_stop")).alias("_month"),
        )
        .withColumn("period_end", F.last_day("_month"))
        .where(
            (F.col("valid_from") <= F.col("period_end").cast("timestamp_ntz"))
            & (F.col("period_end").cast("timestamp_ntz") < F.col("valid_to"))
        )
        .select(key, "period_end", attr)
    )
    grid = members.select(key, months(first, last).alias("_month")).select(
        key, F.last_day("_month").alias("period_end")
    )
    return grid.join(covered, [key, "period_end"], "left").withColumn(
        attr, F.coalesce(attr, F.lit(unknown))
    )


def fact_holding(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    qty: str,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """DF-06. Running holding per key in the order of ``order``."""
    return (
        Timeline(df, key, order, hot_rows).running_sum(F.col(qty), "holding").rows()
    )


# A cell of DF-07 with more instants than this is a burst, and slices follow the density instead.
BURST = 1_000_000
# Instants to a slice.
SLICE = 512


def fact_trailing(
    df: DataFrame, key: str, ts: str, value: str, span_seconds: int, parts: int, burst: int = BURST
) -> DataFrame:
    """DF-07. Highest and lowest ``value`` of the key over ``[t - span, t]`` for every row.

    A range window would put a key on one task, and there may be few keys. So time is cut
    into cells of ``span / parts``, and the span behind ``t`` is the sum of three pieces: the
    end of the cell that holds ``t - span``, the whole cells between, and the start of the own
    cell. No task holds more than one cell of one key; only one row per cell crosses cells.

    Where a cell holds more than ``burst`` instants (they are counted first), slices of equally many
    instants take the place of cells, so a burst of any size is spread; results are the same.
    """
    if span_seconds % parts:
        raise ValueError("parts must divide the span")
    width = span_seconds // parts * 1_000_000
    span = span_seconds * 1_000_000
    # Rows of one key and instant count as one, combined before the shuffle.
    points = (
        df.select(key, micros(ts).alias("_t"), value)
        .groupBy(key, "_t")
        .agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"))
        .withColumn("_cell", F.floor(F.col("_t") / width))
    )
    rows = df.select(key, F.floor(micros(ts) / width).alias("_cell")).groupBy(key, "_cell").count()
    if not rows.where(F.col("count") > burst).isEmpty():
        extremes = trailing_by_density(points.drop("_cell"), key, span)
    else:
        extremes = _trailing_by_cells(points, key, span, parts)
    return join_null_safe(df.withColumn("_t", micros(ts)), extremes, [key, "_t"], "left").drop("_t")


def trailing_by_density(
    points: DataFrame, key: str, span: int, size: int = SLICE, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Trailing extremes of ``points (key, _t, _hi, _lo)``, one per key and instant.

    Points are numbered by key and instant, and ``size`` of them make a slice. A point's span begins
    at the first number at or after ``_t - span``, found on a timeline. Its extremes are those of three
    pieces: the end of the slice it begins in, the whole slices between, and its own slice up to the
    point, a range window over ``size`` rows at most. Whole slices are looked up in a table of
    extremes over 1, 2, 4, … slices, of which two cover any number of them; pairs of first and last
    slice are few, about two per slice.
    """
    numbered = store(
        number_rows(points, [key, "_t"], "_n").withColumn("_slice", F.floor(F.col("_n") / size)), "points"
    )
    asks = numbered.select(key, (F.col("_t") - span).alias("_t"), F.lit(0).alias("_kind"), F.col("_n").alias("_for"))
    marks = numbered.select(key, "_t", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_for"), "_n")
    line = Timeline(
        asks.withColumn("_n", F.lit(None).cast("bigint")).unionByName(marks), [key], ["_t", "_kind"], hot_rows
    ).last_known(F.col("_n"), "_before")
    # Before its first point a key has none: its span begins with that.
    first = numbered.groupBy(key).agg(F.min("_n").alias("_least"))
    begins = join_null_safe(line.rows().where("_kind = 0").select(key, "_for", "_before"), first, [key], "left").select(
        F.col("_for").alias("_n"), F.coalesce(F.col("_before") + 1, F.col("_least")).alias("_from")
    )
    near = Window.partitionBy(key, "_slice").orderBy("_t").rangeBetween(-span, 0)
    to_end = Window.partitionBy("_slice").orderBy(F.desc("_n"))
    placed = store(
        numbered.withColumns(
            {
                "_own_hi": F.max("_hi").over(near), "_own_lo": F.min("_lo").over(near),
                "_end_hi": F.max("_hi").over(to_end), "_end_lo": F.min("_lo").over(to_end),
            }
        ).join(begins, "_n").withColumn("_from_slice", F.floor(F.col("_from") / size)),
        "placed",
    )
    across = placed.where(F.col("_from_slice") < F.col("_slice"))
    tails = placed.select(F.col("_n").alias("_from"), F.col("_end_hi").alias("_tail_hi"), F.col("_end_lo").alias("_tail_lo"))
    pairs = across.where(F.col("_slice") - F.col("_from_slice") > 1).select("_from_slice", "_slice").distinct()
    whole = between_slices(numbered, store(pairs, "pairs"))
    pieces = (
        across.select("_n", "_from", "_from_slice", "_slice").join(tails, "_from")
        .join(whole, ["_from_slice", "_slice"], "left")
        .select("_n", "_tail_hi", "_tail_lo", "_mid_hi", "_mid_lo")
    )
    return placed.join(pieces, "_n", "left").select(
        key, "_t",
        F.greatest("_own_hi", "_tail_hi", "_mid_hi").alias("trailing_high"),
        F.least("_own_lo", "_tail_lo", "_mid_lo").alias("trailing_low"),
    )


def between_slices(numbered: DataFrame, pairs: DataFrame) -> DataFrame:
    """``_mid_hi, _mid_lo`` of the slices strictly between those of each pair."""
    length = F.col("_slice") - F.col("_from_slice") - 1
    most = pairs.agg(F.max(length)).first()[0] or 0
    level = store(
        numbered.groupBy(F.col("_slice").alias("_s")).agg(F.max("_hi").alias("_mid_hi"), F.min("_lo").alias("_mid_lo")), "level"
    )
    table, reach = level.withColumn("_reach", F.lit(1).cast("bigint")), 1
    while 2 * reach <= most:
        onward = level.select((F.col("_s") - reach).alias("_s"), F.col("_mid_hi").alias("_h"), F.col("_mid_lo").alias("_l"))
        level = store(
            level.join(onward, "_s").select(
                "_s", F.greatest("_mid_hi", "_h").alias("_mid_hi"), F.least("_mid_lo", "_l").alias("_mid_lo")
            ),
            "level",
        )
        reach *= 2
        table = table.unionByName(level.withColumn("_reach", F.lit(reach).cast("bigint")))
    # The largest power of two within the length, from both ends.
    half = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.floor(F.log2(length)).cast("int"))
    ends = F.explode(F.array(F.col("_from_slice") + 1, F.col("_slice") - F.col("_reach"))).alias("_s")
    return (
        pairs.withColumn("_reach", half).select("_from_slice", "_slice", "_reach", ends).join(table, ["_reach", "_s"])
        .groupBy("_from_slice", "_slice").agg(F.max("_mid_hi").alias("_mid_hi"), F.min("_mid_lo").alias("_mid_lo"))
    )


def _trailing_by_cells(points: DataFrame, key: str, span: int, parts: int) -> DataFrame:
    begin = Window.partitionBy(key, "_cell").orderBy("_t")
    own = points.select(
        key,
        "_t",
        "_cell",
        F.max("_hi").over(begin).alias("_own_hi"),
        F.min("_lo").over(begin).alias("_own_lo"),
    )
    cells = points.groupBy(key, "_cell").agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    between = Window.partitionBy(key).orderBy("_cell").rangeBetween(-(parts - 1), -1)
    whole = cells.select(
        key, "_cell", F.max("_hi").over(between).alias("_mid_hi"), F.min("_lo").over(between).alias("_mid_lo")
    )
    # The tail: each t asks, at t - span, for the extremes from there to the end of that cell.
    asks = points.select(
        key,
        (F.col("_t") - span).alias("_t"),
        F.lit(None).cast(points.schema["_hi"].dataType).alias("_hi"),
        F.lit(None).cast(points.schema["_lo"].dataType).alias("_lo"),
        (F.col("_cell") - parts).alias("_cell"),
        F.lit(True).alias("_ask"),
    )
    to_end = Window.partitionBy(key, "_cell").orderBy(F.col("_t").desc())
    tails = (
        points.withColumn("_ask", F.lit(False))
        .unionByName(asks)
        .withColumn("_tail_hi", F.max("_hi").over(to_end))
        .withColumn("_tail_lo", F.min("_lo").over(to_end))
        .where("_ask")
        .select(key, (F.col("_t") + span).alias("_t"), "_tail_hi", "_tail_lo")
    )
    return (
        join_null_safe(join_null_safe(own, whole, [key, "_cell"], "left"), tails, [key, "_t"], "left")
        .select(
            key,
            "_t",
            F.greatest("_own_hi", "_mid_hi", "_tail_hi").alias("trailing_high"),
            F.least("_own_lo", "_mid_lo", "_tail_lo").alias("trailing_low"),
        )
    )


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp."""
    at = F.col(ts).cast("timestamp_ntz")
    minutes = F.unix_date(at.cast("date")).cast("bigint") * 1440 + F.hour(at) * 60 + F.minute(at)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint")
