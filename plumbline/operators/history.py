"""Identity and history (IH-01 to IH-14).

A change log is rows ``key, ts, tie, attrs``. A history is rows ``key, valid_from, valid_to,
attrs, is_current`` with half-open ``[valid_from, valid_to)``; the open end is 9999-12-31.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.timeline import HOT_ROWS, Timeline
from plumbline.functions.values import SHAPES, join_null_safe, open_end, same
from plumbline.sources.shared import checked_keys, cut_lineage


def resolve_key(df: DataFrame, text: str, pattern: str, name: str = "resolved_key") -> DataFrame:
    """IH-01. A candidate key from a natural name: the first group of ``pattern`` as a number,
    NULL where the name carries none. The caller joins it to the dimension by equality."""
    digits = F.regexp_extract(F.col(text), pattern, 1)
    return df.withColumn(name, F.when(digits.rlike(SHAPES["bigint"]), digits.try_cast("bigint")))


def number_rows(
    df: DataFrame, order: Sequence[str], sk: str = "sk", after: Column | None = None
) -> DataFrame:
    """Number the rows 1, 2, … (or from ``after`` + 1) in the order of ``order``, which must be
    unique.

    Rows are range-partitioned and sorted, numbered inside each partition, and shifted by the
    rows of the partitions before it. No window spans all rows; the only unpartitioned one is
    over one count per partition. The placed rows are checkpointed, as a second sampling of
    the ranges could place them differently.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns(
            {"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}
        )
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    start = F.lit(0) if after is None else after
    # One row per partition: as small as the shuffle partition count.
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_id") - F.col("_first") + F.col("_offset") + 1 + start).alias(sk)
    )


def assign_sk(
    df: DataFrame, key: Sequence[str], sk: str = "sk", after: Column | None = None
) -> DataFrame:
    """IH-02. Surrogate keys in the order of the natural key, one per distinct key."""
    return number_rows(df.select(*key).distinct(), key, sk, after)


def extend_sk(dim: DataFrame, incoming: DataFrame, key: Sequence[str], sk: str = "sk") -> DataFrame:
    """IH-03. Keep every key already given; number unseen members after the highest one. NULL
    is a member like any other, and keeps its number too."""
    unseen = join_null_safe(incoming.select(*key), dim.select(*key), key, "left_anti")
    top = dim.agg(F.coalesce(F.max(sk), F.lit(0)).alias("top")).scalar()
    return dim.select(*key, sk).unionByName(assign_sk(unseen, key, sk, after=top))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """IH-04. The last row per key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
        .select(*key, "_last.*")
        .select(*df.columns)
    )


def collapse_ties(
    log: DataFrame, key: Sequence[str], ts: str, tie: str, attrs: Sequence[str]
) -> DataFrame:
    """One state per key and instant: the one with the highest ``tie``, a NULL tie being lowest."""
    return (
        log.groupBy(*key, ts)
        .agg(F.max_by(F.struct(*attrs), F.struct(tie)).alias("_state"))
        .select(*key, ts, "_state.*")
    )


def build_history(
    log: DataFrame,
    key: Sequence[str],
    ts: str,
    tie: str,
    attrs: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """IH-05. Type-2 history from a change log in any order. Ties collapse first (combined
    before the shuffle), states equal to the one before are dropped, and each version ends
    where the next begins."""
    states = collapse_ties(log, key, ts, tie, attrs)
    timeline = Timeline(states, key, [ts], hot_rows, counted=log).previous(attrs, "_before")
    unchanged = F.col("_before").isNotNull() & same(
        [F.col(a) for a in attrs], [F.col(f"_before.{a}") for a in attrs]
    )
    versions = timeline.where(~unchanged).next([ts], "_after").rows()
    return versions.select(
        *key,
        F.col(ts).cast("timestamp_ntz").alias("valid_from"),
        F.coalesce(F.col(f"_after.{ts}").cast("timestamp_ntz"), open_end()).alias("valid_to"),
        *attrs,
        F.col("_after").isNull().alias("is_current"),
    )


def apply_history(
    hist: DataFrame,
    log: DataFrame,
    batch: DataFrame,
    key: Sequence[str],
    ts: str,
    tie: str,
    attrs: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """IH-06. Apply a batch of changes: rebuild the history of the keys it touches from the
    whole log and keep all others as they are. As the log decides, batch order does not. NULL
    is a key like any other."""
    key = list(key)
    touched = checked_keys(batch.select(*key).distinct())
    full = log.unionByName(batch)
    changed = join_null_safe(full, touched, key, "left_semi")
    rebuilt = build_history(changed, key, ts, tie, attrs, hot_rows)
    return join_null_safe(hist, touched, key, "left_anti").unionByName(rebuilt)


def upsert(dim: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """IH-07. Type-1 upsert: a row of the batch replaces the row of its key, others stay.
    ``batch`` holds one row per key (IH-04); NULL is a key like any other."""
    key = list(key)
    attrs = [c for c in dim.columns if c not in key]
    old = dim.select(*key, F.struct(*attrs).alias("_old"))
    new = batch.select(*key, F.struct(*attrs).alias("_new"))
    return (
        join_null_safe(old, new, key, "full")
        .select(*key, F.coalesce("_new", "_old").alias("_row"))
        .select(*key, "_row.*")
    )


def close_history(hist: DataFrame, ends: DataFrame, key: Sequence[str]) -> DataFrame:
    """IH-08. End the validity of a key at its ``end_ts``. A version that would begin at or
    after the end is dropped; a closed key has no current version."""
    joined = hist.join(ends.select(*key, "end_ts"), list(key), "left")
    closed = joined.withColumn("valid_to", F.least("valid_to", "end_ts")).withColumn(
        "is_current", F.col("is_current") & F.col("end_ts").isNull()
    )
    return closed.where(F.col("valid_from") < F.col("valid_to")).drop("end_ts")


def backdate(
    hist: DataFrame,
    log: DataFrame,
    late: DataFrame,
    key: Sequence[str],
    ts: str,
    tie: str,
    attrs: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """IH-09. Late changes: versions are inserted in the past. The same rebuild as IH-06."""
    return apply_history(hist, log, late, key, ts, tie, attrs, hot_rows)


def asof_last(
    fact: DataFrame,
    log: DataFrame,
    key: Sequence[str],
    ts: str,
    log_ts: str,
    tie: str,
    attrs: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """IH-11. As-of join to a change log without validity columns. Changes and the distinct
    ``(key, time)`` pairs of the facts are put on one timeline, changes first at equal times;
    each pair takes the last change before it, and facts join back by equality. The work is
    linear in rows however long a key's history is."""
    key = list(key)
    # A NULL key has no history, and facts without a key, however many, need no probe.
    log = log.dropna(subset=key)
    keyed = fact.select(*key, ts).dropna(subset=key)
    changes = collapse_ties(log, key, log_ts, tie, attrs).select(
        *key,
        F.col(log_ts).alias(ts),
        F.lit(0).alias("_kind"),
        F.struct(*attrs).alias("_state"),
    )
    probes = (
        keyed.distinct()
        .withColumn("_kind", F.lit(1))
        .withColumn("_state", F.lit(None).cast(changes.schema["_state"].dataType))
    )
    rows = log.select(*key, F.col(log_ts).alias(ts)).unionByName(keyed)
    timeline = Timeline(
        changes.unionByName(probes), key, [ts, "_kind"], hot_rows, counted=rows
    )
    known = timeline.last_known(F.col("_state"), "_known").rows()
    answers = known.where(F.col("_kind") == 1).select(*key, ts, "_known.*")
    return fact.join(answers, [*key, ts], "left")


def snapshot(hist: DataFrame, at: Column) -> DataFrame:
    """IH-12. The version of every key at one time: a pushed-down range filter."""
    return hist.where((F.col("valid_from") <= at) & (at < F.col("valid_to")))


def interval_faults(
    hist: DataFrame, key: Sequence[str], hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """IH-13. Overlaps, gaps and empty versions. A version is compared with the furthest end
    of all versions before it, so one long version over several later ones is seen."""
    timeline = Timeline(hist, key, ["valid_from", "valid_to"], hot_rows).max_before(
        F.col("valid_to"), "_reached"
    )
    fault = (
        F.when(F.col("valid_from") >= F.col("valid_to"), "EMPTY")
        .when(F.col("valid_from") < F.col("_reached"), "OVERLAP")
        .when(F.col("valid_from") > F.col("_reached"), "GAP")
    )
    return (
        timeline.rows()
        .select(*key, "valid_from", "valid_to", fault.alias("fault"))
        .where(F.col("fault").isNotNull())
    )


def coalesce_history(
    hist: DataFrame, key: Sequence[str], attrs: Sequence[str], hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """IH-14. Merge touching versions with equal attributes (gaps and islands)."""
    timeline = Timeline(hist, key, ["valid_from"], hot_rows).previous(
        ["valid_to", *attrs], "_before"
    )
    joins_up = same(
        [F.col("valid_from"), *[F.col(a) for a in attrs]],
        [F.col("_before.valid_to"), *[F.col(f"_before.{a}") for a in attrs]],
    )
    starts = F.when(F.col("_before").isNotNull() & joins_up, 0).otherwise(1)
    islands = timeline.running_sum(starts, "_island").rows()
    return (
        islands.groupBy(*key, "_island", *attrs)
        .agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"))
        .select(
            *key,
            "valid_from",
            "valid_to",
            *attrs,
            (F.col("valid_to") == open_end()).alias("is_current"),
        )
    )
