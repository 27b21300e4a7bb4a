"""Line dedup: lines that stand on many sites are boilerplate and stay once.

Every line (blanks around it cut off) is keyed by 128 hash bits. One aggregation merges a
HyperLogLog sketch of the sites each key stands on; its estimate settles all keys far from the
threshold. Keys within ``MARGIN`` standard errors of it get an exact distinct count over their
own (key, site) pairs. A line on at least ``min_sites`` sites is kept where it stands first (the
smallest document id, then the highest place in the text) and removed everywhere else, so no
content disappears from the corpus.

Only DataFrame functions are used. Sketches and first places combine before the shuffle, so a
line that a third of all documents hold costs each task one row. Removals join on the key, where
adaptive execution splits a hot key; no list of lines is ever broadcast by request.

Defined results: a null text stays null and an empty one empty; blank lines are never removed; a
null site counts as no site; a null id sorts before all others; rows equal in id and text are
treated alike (where they hold the first place, all of them keep it). Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

MIN_SITES = 10
# 2**12 registers: a standard error of 1.04 / 64, and exact in practice for small counts.
SKETCH_BITS = 12
ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
MARGIN = 5


def row_key(doc_id: str, text: str) -> Column:
    """128 bits that name a row by its id and text."""
    return F.struct(
        F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"),
        F.xxhash64(F.lit(1), F.col(text), F.col(doc_id)).alias("k2"),
    )


def line_places(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """One row per line that is not blank: its key, row, place and site."""
    lines = docs.select(
        F.col(doc_id).alias("_pl_id"), F.col(site).alias("_pl_site"),
        row_key(doc_id, text).alias("_pl_row"),
        F.posexplode(F.split(F.col(text), "\n")).alias("_pl_at", "_pl_line"),
    ).withColumn("_pl_line", F.trim("_pl_line"))
    return lines.where(F.col("_pl_line") != "").select(
        F.xxhash64("_pl_line").alias("_pl_h1"),
        F.xxhash64(F.lit(1), "_pl_line").alias("_pl_h2"),
        F.struct("_pl_id", "_pl_row", "_pl_at").alias("_pl_place"), "_pl_site",
    )


def boilerplate(places: DataFrame, min_sites: int) -> DataFrame:
    """Keys on at least ``min_sites`` sites, with their first place."""
    key = ["_pl_h1", "_pl_h2"]
    sketched = (
        places.groupBy(*key)
        .agg(
            F.hll_sketch_agg("_pl_site", F.lit(SKETCH_BITS)).alias("_pl_sketch"),
            F.min("_pl_place").alias("_pl_first"),
        )
        .select(*key, "_pl_first", F.hll_sketch_estimate("_pl_sketch").alias("_pl_sites"))
    )
    slack = max(1.0, MARGIN * ERROR * min_sites)
    seen = stored(sketched.where(F.col("_pl_sites") >= min_sites - slack), "lines")
    near = seen.where(F.col("_pl_sites") <= min_sites + slack).select(*key)
    exact = (
        places.join(near, key, "left_semi")
        .groupBy(*key)
        .agg(F.count_distinct("_pl_site").alias("_pl_exact"))
    )
    return (
        seen.join(exact, key, "left")
        .where(F.coalesce(F.col("_pl_exact"), F.col("_pl_sites")) >= min_sites)
        .select(*key, "_pl_first")
    )


def dedup_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text",
    site: str = "source",
) -> DataFrame:
    """``docs`` with cleaned ``text`` and two further columns: ``_pl_lines`` (lines before; null
    for a null text) and ``_pl_removed`` (lines removed)."""
    places = line_places(docs, doc_id, text, site)
    known = stored(boilerplate(places, min_sites), "boilerplate")
    removed = (
        places.join(known, ["_pl_h1", "_pl_h2"])
        .where(F.col("_pl_place") != F.col("_pl_first"))
        .groupBy(F.col("_pl_place._pl_row").alias("_pl_key"))
        .agg(F.collect_set("_pl_place._pl_at").alias("_pl_gone"))
    )
    gone = F.coalesce(F.col("_pl_gone"), F.array().cast("array<int>"))
    lines = F.split(F.col(text), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    cleaned = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return (
        docs.withColumn("_pl_key", row_key(doc_id, text))
        .join(removed, "_pl_key", "left")
        .withColumn("_pl_lines", F.when(F.col(text).isNotNull(), F.size(lines)))
        .withColumn("_pl_removed", F.size(gone))
        .withColumn(text, F.when(F.size(gone) > 0, cleaned).otherwise(F.col(text)))
        .select(*docs.columns, "_pl_lines", "_pl_removed")
    )
