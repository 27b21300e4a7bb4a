"""Stored history: equal to a rebuild, and only touched buckets are read and written."""

import io
import random
import re
from contextlib import redirect_stdout
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.operators.history import build_history
from plumbline.operators.history_store import HistoryStore

SCHEMA = "k long, at timestamp_ntz, tie long, tier string"
ATTRS = dict(key=("k",), ts="at", tie="tie", attrs=("tier",))


def changes(spark, rows):
    text = "k long, day int, tie long, tier string"
    at = F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, day)")
    return spark.createDataFrame(rows, text).select("k", at.alias("at"), "tie", "tier")


def bag(df):
    return sorted(map(tuple, df.select("k", "valid_from", "valid_to", "tier", "is_current").collect()), key=repr)


def rebuilt(log):
    return bag(build_history(log, ["k"], "at", "tie", ["tier"]))


def files(path, table):
    return {str(p): p.stat().st_mtime_ns for p in Path(path, table).rglob("*.parquet")}


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def made(spark, path, log, buckets=8):
    return HistoryStore(spark, str(path), **ATTRS, schema=SCHEMA, buckets=buckets).build(log, "b0")


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_batches_in_any_order_equal_a_rebuild(spark, tmp_path, order):
    rng = random.Random(4)
    # NULL is a key; ties, repeated rows and unchanged states occur.
    rows = [(rng.choice([None, *range(12)]), rng.randint(0, 40), i, rng.choice("AB") if i % 9 else None) for i in range(300)]
    rows += rows[:20]
    parts = [changes(spark, [r for r in rows if r[1] // 14 == p]) for p in range(3)]
    first, second, third = (parts[i] for i in order)
    store = made(spark, tmp_path / "h", first)
    store.apply(second, "b1").apply(third, "b2")
    want = rebuilt(first.unionByName(second).unionByName(third))
    assert bag(store.history()) == want
    # A batch that is applied again replaces itself.
    store.apply(second, "b1")
    assert bag(store.history()) == want and store.log().count() == len(rows)
    store.apply(second.limit(0), "b3")
    assert bag(store.history()) == want


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    log = changes(spark, [(k, d, d, f"{k % 3}{d}") for k in range(100) for d in range(3)])
    store = made(spark, tmp_path / "h", log, buckets=16)
    before = files(tmp_path / "h", "history")
    buckets = {p.split("bucket=")[1].split("/")[0] for p in before}
    assert len(buckets) == 16
    store.apply(changes(spark, [(7, 30, 30, "X")]), "b1")
    after = files(tmp_path / "h", "history")
    same = {p for p in before if after.get(p) == before[p]}
    assert {p.split("bucket=")[1].split("/")[0] for p in set(before) - same} == {str(bucket_of(spark, 7))}
    assert bag(store.history()) == rebuilt(log.unionByName(changes(spark, [(7, 30, 30, "X")])))


def bucket_of(spark, key):
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(key).cast("long")), F.lit(16))).first()[0]


def pruned(text, table):
    """Buckets that the partition filters of every scan of a table let through."""
    found = set()
    for scan in (part for part in text.split("\n\n") if table in part and "Scan parquet" in part):
        (line,) = re.findall("PartitionFilters: (.*)", scan)
        found.add(tuple(sorted(map(int, re.findall(r"(?:= |IN \(|,)(\d+)(?=[,)])", line)))))
    (buckets,) = found
    return set(buckets)


def test_plans_prune_and_only_late_keys_read_the_log(spark, tmp_path):
    log = changes(spark, [(k, d, d, f"{d}") for k in range(50) for d in (0, 10)])
    store = made(spark, tmp_path / "h", log, buckets=16)
    on_time = plan(store.changed(store._staged(changes(spark, [(7, 30, 30, "X")]))))
    assert "h/history" in on_time and "h/log" not in on_time
    assert pruned(on_time, "h/history") == {bucket_of(spark, 7)}
    late = plan(store.changed(store._staged(changes(spark, [(7, 30, 30, "X"), (8, 5, 5, "Y")]))))
    assert pruned(late, "h/history") == {bucket_of(spark, 7), bucket_of(spark, 8)}
    assert pruned(late, "h/log") == {bucket_of(spark, 8)}


def test_a_failure_between_log_and_history_is_made_good(spark, tmp_path):
    log = changes(spark, [(k, d, d, f"{d}") for k in range(9) for d in (0, 10)])
    store = made(spark, tmp_path / "h", log, buckets=4)
    batch = changes(spark, [(1, 20, 1, "X"), (2, 5, 1, "Y"), (99, 3, 1, "Z")])
    store._write_log(store._staged(batch), "b1")
    store.apply(batch, "b1")
    assert bag(store.history()) == rebuilt(log.unionByName(batch))


def test_hot_key_continues(spark, tmp_path):
    log = changes(spark, [(1, d, d, f"{d // 2}") for d in range(200)] + [(2, 0, 0, "A")])
    batch = changes(spark, [(1, 150 + d, 900 + d, f"n{d // 3}") for d in range(120)])
    store = HistoryStore(spark, str(tmp_path / "h"), **ATTRS, schema=SCHEMA, buckets=4, hot_rows=30).build(log, "b0")
    store.apply(batch, "b1")
    assert bag(store.history()) == rebuilt(log.unionByName(batch))
