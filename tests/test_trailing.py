"""Trailing extremes by density: equal to the range window, and a burst is spread."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import facts

SPAN = 100


def events(spark, kind, n=1500):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    if kind == "burst":
        # All within one second, a tenth of them at one instant.
        times = [timedelta(microseconds=rng.choice([7, *range(10)]) if i % 10 == 0 else rng.randint(0, 999_999)) for i in range(n)]
    elif kind == "even":
        times = [timedelta(seconds=rng.randint(0, 2000)) for _ in range(n)]
    else:
        times = [timedelta(seconds=rng.choice([rng.randint(0, 5000), 3000, rng.randint(3000, 3010)])) for _ in range(n)]
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "a", start + t, rng.choice([None, rng.random()])) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")


def windowed(df):
    w = Window.partitionBy("k").orderBy("_m").rangeBetween(-SPAN * 1_000_000, 0)
    return df.withColumn("_m", facts.micros("ts")).select(
        "k", "ts", "v", F.max("v").over(w).alias("trailing_high"), F.min("v").over(w).alias("trailing_low")
    )


def bag(df):
    return sorted(map(tuple, df.select("k", "ts", "v", "trailing_high", "trailing_low").collect()), key=repr)


@pytest.mark.parametrize("kind", ["burst", "even", "mixed"])
@pytest.mark.parametrize("size", [3, 64])
def test_density_equals_the_window(spark, monkeypatch, kind, size):
    monkeypatch.setattr(facts.trailing_by_density, "__defaults__", (size, facts.HOT_ROWS))
    df = events(spark, kind)
    assert bag(facts.fact_trailing(df, "k", "ts", "v", SPAN, 10, burst=5)) == bag(windowed(df))


def test_a_burst_is_many_small_slices(spark):
    df = events(spark, "burst")
    assert facts.fact_trailing(df, "k", "ts", "v", SPAN, 10).count() == df.count()
    points = df.groupBy("k", facts.micros("ts").alias("_t")).agg(F.max("v").alias("_hi"), F.min("v").alias("_lo"))
    numbered = facts.number_rows(points, ["k", "_t"], "_n").withColumn("_slice", F.floor(F.col("_n") / 16))
    sizes = [r["count"] for r in numbered.groupBy("_slice").count().collect()]
    assert max(sizes) <= 16 and len(sizes) > 50
    assert bag(facts.fact_trailing(df.limit(0), "k", "ts", "v", SPAN, 10, burst=0)) == []
