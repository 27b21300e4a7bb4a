"""Mixing sources to target weights, by hash-random keys and distributed prefix sums.

Sources are numbered by name and weighted 1, 2, 3, 1, 2, 3 and so on. Together they share the
words of the whole corpus by weight; a source never gives more than ``MOST_REPEATS`` times its
own words, and what it cannot give is shared again by weight among the others until none is
above its limit. Within a source, documents are ordered by a hash-random key, and the prefix
sum of their words says where the source's exact budget cuts. A budget above the source's words
repeats the source whole, then cuts once more.

Only DataFrame functions are used. A source with a third of all rows is spread over all tasks
(``total_before``); the driver sees one pair of sums per round of re-sharing.

Defined results: a null text has size 0; a null source is one source, numbered last; rows that
repeat a ``doc_id`` are documents of their own, ordered by their texts' hashes; documents without words are
never taken; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import order_key, stored, total_before
from plumbline.operators.history import number_rows

MOST_REPEATS = 3
WEIGHTS = 3
# Fixed value: a word is a run of anything but these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, source: str, size: str) -> DataFrame:
    """One row per source: ``_pl_source`` (its number), ``_pl_source_size``, ``_pl_target``."""
    per = sized.groupBy(source).agg(F.sum(size).cast("bigint").alias("_pl_source_size"))
    per = per.withColumn("_pl_null", F.col(source).isNull())
    weight = (F.pmod(F.col("_pl_source") - 1, F.lit(WEIGHTS)) + 1).cast("bigint")
    per = stored(
        number_rows(per, ["_pl_null", source], "_pl_source").withColumn("_pl_weight", weight),
        "sources",
    )
    limit = F.col("_pl_source_size") * MOST_REPEATS
    total, weights = per.agg(F.sum("_pl_source_size"), F.sum("_pl_weight")).first()
    rate, full = (total / weights if total else 0.0), -1
    while total:
        above = limit <= F.lit(rate) * F.col("_pl_weight")
        given, open_weight, now_full = per.agg(
            F.sum(F.when(above, limit).otherwise(0)),
            F.sum(F.when(above, 0).otherwise(F.col("_pl_weight"))),
            F.sum(above.cast("int")),
        ).first()
        if now_full == full or not open_weight:
            break
        rate, full = (total - given) / open_weight, now_full
    target = F.least(limit.cast("double"), F.lit(float(rate)) * F.col("_pl_weight"))
    return per.withColumn("_pl_target", target).drop("_pl_null", "_pl_weight")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with ``_pl_size``, ``_pl_source_size``, ``_pl_target``,
    ``_pl_taken`` (words taken, repeats counted) and ``_pl_copies`` (times the document is
    begun)."""
    # The text takes part, so that one id on very many texts is no hot slice, and reruns agree.
    named = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    keyed = docs.withColumn("_pl_size", words(text)).withColumn("_pl_name", named)
    keyed = keyed.withColumn("_pl_key", order_key("mix", "_pl_name")).drop("_pl_name")
    small = stored(keyed.select(source, "_pl_size", "_pl_key"), "sizes")
    targets = source_targets(small, source, "_pl_size").withColumnRenamed(source, "_pl_name")

    def with_target(df: DataFrame) -> DataFrame:
        return df.join(targets, F.col(source).eqNullSafe(F.col("_pl_name"))).drop("_pl_name")

    placed = total_before(
        with_target(keyed), ["_pl_source"], "_pl_key", [doc_id, "_pl_size"], F.col("_pl_size"),
        "_pl_before", small.count(), with_target(small),
    )
    size, source_size = F.col("_pl_size"), F.col("_pl_source_size")
    budget = F.floor(F.col("_pl_target") + 0.5).cast("bigint")
    rounds = F.when(source_size > 0, F.floor(budget / source_size)).otherwise(0).cast("bigint")
    rest = budget - rounds * source_size
    cut = F.greatest(F.lit(0).cast("bigint"), F.least(rest - F.col("_pl_before"), size))
    return placed.select(
        *docs.columns, "_pl_size", "_pl_source_size", "_pl_target",
        (rounds * size + cut).cast("bigint").alias("_pl_taken"),
        F.when(size > 0, rounds + F.when(cut > 0, 1).otherwise(0)).otherwise(0)
        .cast("int").alias("_pl_copies"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is begun, whole (so a source is at most one
    document above its budget), with the columns of ``docs``."""
    return (
        mix(docs)
        .where(F.col("_pl_copies") > 0)
        .withColumn("_pl_copy", F.explode(F.sequence(F.lit(1), F.col("_pl_copies"))))
        .select(*docs.columns)
    )
