"""Stored history in hash buckets of the key (IH-06, IH-09 at rest).

A store is two Parquet tables: ``log``, partitioned by bucket and batch, and ``history``,
partitioned by bucket. A batch belongs to the buckets of its keys; only those partitions are read,
and only those of the history are written again. Files of other buckets stay as they are.

Inside its buckets a batch has two kinds of keys. A key whose changes are all later than anything
known of it continues from its current version: the log is not read for it. A key with a late change
is rebuilt from the log, of which only buckets with such keys are read. Each current version
carries ``seen``, the latest change time of its key, which tells the two apart.

A batch is named, and its name is its log partition, so a batch that is applied again, after a
failure at any point or by mistake, replaces itself: the log first, then the history, which for keys
already ahead comes from the log. Only the numbers of touched buckets reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.timeline import HOT_ROWS
from plumbline.functions.values import join_null_safe
from plumbline.operators.history import build_history
from plumbline.sources.scan import write_stage
from plumbline.sources.shared import checked_keys, store

# A bucket should come to a few files: about the bytes of the history over 256 MB.
BUCKETS = 64
BUCKET, BATCH, SEEN = "bucket", "batch", "seen"


@dataclass(frozen=True)
class HistoryStore:
    """History below ``path``. ``key``, ``ts``, ``tie`` and ``attrs`` are columns of every batch;
    ``buckets`` is fixed when the store is built."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    ts: str
    tie: str
    attrs: tuple[str, ...]
    schema: str
    buckets: int = BUCKETS
    hot_rows: int | None = HOT_ROWS

    @property
    def columns(self) -> list[str]:
        return [*self.key, self.ts, self.tie, *self.attrs]

    def bucket(self) -> Column:
        """NULL is a key like any other and has a bucket of its own choice."""
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _staged(self, batch: DataFrame) -> DataFrame:
        return store(batch.select(*self.columns).withColumn(BUCKET, self.bucket()), "batch")

    def _write_log(self, staged: DataFrame, name: str) -> None:
        write_stage(staged.withColumn(BATCH, F.lit(name)), f"{self.path}/log", [BUCKET, BATCH])

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def log(self) -> DataFrame:
        """Every change of every batch, with ``bucket`` and ``batch``."""
        return self._read("log", f"{self.schema}, {BUCKET} int, {BATCH} string")

    def stored(self) -> DataFrame:
        """The history with ``seen`` and ``bucket``."""
        kinds = {f.name: f.dataType.simpleString() for f in self.spark.createDataFrame([], self.schema).schema}
        fields = [f"{c} {kinds[c]}" for c in self.key] + ["valid_from timestamp_ntz", "valid_to timestamp_ntz"]
        fields += [f"{c} {kinds[c]}" for c in self.attrs]
        return self._read("history", ", ".join([*fields, f"is_current boolean, {SEEN} {kinds[self.ts]}, {BUCKET} int"]))

    def history(self) -> DataFrame:
        """Key, validity, attributes and ``is_current``, as IH-05 gives them."""
        return self.stored().drop(SEEN, BUCKET)

    def _versions(self, log: DataFrame) -> DataFrame:
        """History of a log, the current version of each key with what was ``seen`` of it."""
        hist = build_history(log.select(*self.columns), list(self.key), self.ts, self.tie, list(self.attrs), self.hot_rows)
        seen = log.groupBy(*self.key).agg(F.max(self.ts).alias(SEEN))
        known = join_null_safe(hist, seen, self.key, "left")
        return known.withColumn(SEEN, F.when(F.col("is_current"), F.col(SEEN))).withColumn(BUCKET, self.bucket())

    def build(self, log: DataFrame, name: str) -> HistoryStore:
        """A new store from its first batch."""
        staged = self._staged(log)
        self._write_log(staged, name)
        write_stage(self._versions(staged), f"{self.path}/history", [BUCKET])
        return self

    def apply(self, batch: DataFrame, name: str) -> HistoryStore:
        """Take in a batch, on time or late; the outcome does not depend on the order of batches."""
        staged = self._staged(batch)
        self._write_log(staged, name)
        changed = self.changed(staged)
        if changed is not None:
            # Stored before it is written, as it reads the partitions that it replaces.
            write_stage(store(changed, "changed"), f"{self.path}/history", [BUCKET])
        return self

    def changed(self, staged: DataFrame) -> DataFrame | None:
        """The new content of the buckets that a staged batch touches; None where it is empty."""
        key = list(self.key)
        buckets = self._numbers(staged)
        if not buckets:
            return None
        old = self.stored().where(F.col(BUCKET).isin(buckets))
        first = staged.groupBy(*key, BUCKET).agg(F.min(self.ts).alias("_first"))
        current = old.where("is_current").select(*key, SEEN)
        touched = join_null_safe(first, current, key, "left").select(
            *key, BUCKET, F.coalesce(F.col("_first") <= F.col(SEEN), F.lit(False)).alias("_late")
        )
        touched = checked_keys(touched)
        late = touched.where("_late").select(*key, BUCKET)
        behind = self._numbers(late)
        # What a key continues from counts as a change at the time its current version began.
        go_on = join_null_safe(old.where("is_current"), touched.where("NOT _late").select(*key), key, "left_semi")
        kinds = {f.name: f.dataType for f in staged.schema.fields}
        seeds = go_on.select(
            *key, F.col("valid_from").cast(kinds[self.ts]).alias(self.ts),
            F.lit(None).cast(kinds[self.tie]).alias(self.tie), *self.attrs, BUCKET,
        )
        source = seeds.unionByName(join_null_safe(staged, late.select(*key), key, "left_anti") if behind else staged)
        if behind:
            whole = self.log().where(F.col(BUCKET).isin(behind)).drop(BATCH)
            source = source.unionByName(join_null_safe(whole, late.select(*key), key, "left_semi"))
        marks = touched.select(*key, "_late")
        kept = join_null_safe(old, marks, key, "left").where(
            F.col("_late").isNull() | (~F.col("_late") & ~F.col("is_current"))
        )
        return kept.select(*old.columns).unionByName(self._versions(source))

    def _numbers(self, rows: DataFrame) -> list[int]:
        """Bucket numbers, at most ``buckets`` of them."""
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
