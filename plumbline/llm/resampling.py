"""Importance resampling of documents towards a target distribution.

Texts become features: all runs of ``shortest`` to ``longest`` consecutive words, joined by one
space, hashed to buckets by CRC-32 (``span_crc``: contributions by byte and distance from the
span's end, joined over feature spans, all spans of a batch at once). One pass counts the buckets
of the documents, one those of the target texts: a task adds its rows up and hands on one row per
bucket. The gains of the buckets, a table bounded by ``buckets``, are broadcast, and a second pass
over the documents takes the mean gain of each. Gumbel noise from a hash of the id makes the highest
scores a weighted draw without replacement, the same on every run.

The draw is one global order cut at an exact count. Scores are whole numbers in a small range, so
the score at the cut is found from counts per score (at most some 100,000, whatever the corpus); only
rows from there on are put in order and numbered, range-partitioned by score, id and row, so no score,
id or text, however frequent, is one task's.

Words are runs of letters and digits of ASCII and of all other characters, lower-cased in ASCII only.

Defined results: a null text has no words; a document without features weighs 0; equal scores go to
the smaller id, null ids first; rows that repeat an id and text are ranked each, in any order among
themselves; a null id is hashed as ``null``; an empty table gives an empty result, and empty target
texts count nothing. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bpe import chunks, widened, with_columns
from plumbline.llm.common import stored
from plumbline.llm.span_crc import span_crcs
from plumbline.operators.history import number_rows

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, "2024"
# Bytes of text worked on at once, at least one text.
CHUNK = 1 << 21

WORD_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

WORDS, FEATURES, WEIGHT, SCORE, RANK, ROW = "_pl_words", "_pl_features", "_pl_weight", "_pl_score", "_pl_rank", "_pl_row"


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts in one buffer, and where each begins; null texts are empty."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.empty(0, np.uint8)
    return data, places


def features(
    data: np.ndarray, places: np.ndarray, shortest: int, longest: int, buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts at ``places`` of ``data``: the text of each feature, its bucket, words per text."""
    texts = len(places) - 1
    own = LOWER[data[places[0] : places[-1]]]
    starts, ends = places[:-1] - places[0], places[1:] - places[0]
    word = WORD_BYTE[own]
    before = np.r_[False, word[:-1]] if len(own) else word
    before[starts[starts < len(own)]] = False
    begin = np.flatnonzero(word & ~before)
    # The bytes of all words, each word followed by one blank.
    count = np.diff(np.append(np.cumsum(word)[begin] - 1, word.sum())).astype(np.int64) if len(begin) else np.empty(0, np.int64)
    line = np.full(int(count.sum()) + len(begin), 32, np.uint8)
    line[np.arange(int(count.sum())) + np.repeat(np.arange(len(begin)), count)] = own[word]
    stop = np.cumsum(count + 1) - 1
    start = stop - count
    owner = np.searchsorted(ends, begin, "right")
    found, bucket = [], []
    for run in range(shortest, longest + 1):
        last = np.arange(run - 1, len(begin))
        if not len(last):
            continue
        first = last - (run - 1)
        same = owner[first] == owner[last]
        crc = span_crcs(line, start[first[same]], stop[last[same]])
        found.append(owner[first[same]])
        bucket.append((crc % np.uint32(buckets)).astype(np.int64))
    empty = np.empty(0, np.int64)
    return (
        np.concatenate(found) if found else empty, np.concatenate(bucket) if bucket else empty,
        np.bincount(owner, minlength=texts) if len(owner) else np.zeros(texts, np.int64),
    )


def worked(batches: Iterator[pa.RecordBatch], text: str, *how: int) -> Iterator[tuple]:
    for batch in batches:
        data, places = text_bytes(batch.column(text))
        for a, b in chunks(np.diff(places), CHUNK):
            yield batch.slice(a, b - a), *features(data, places[a : b + 1], *how)


def bucket_counts(texts: DataFrame, text: str, shortest: int, longest: int, buckets: int) -> DataFrame:
    """``bucket, n`` over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, bucket, _ in worked(batches, text, shortest, longest, buckets):
            total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    own = texts.select(F.col(text).cast("string").alias(text))
    return own.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket from ``bucket, n`` of documents and target, in thousandths of a
    natural logarithm, rounded down."""
    counts = np.zeros((2, buckets))
    for side, table in enumerate((documents, target)):
        own = table.toPandas()
        counts[side, own["bucket"].to_numpy(np.int64)] = own["n"].to_numpy()
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text: str, shortest: int, longest: int) -> DataFrame:
    """``docs`` with ``_pl_words``, ``_pl_features`` and ``_pl_weight``."""
    table = docs.sparkSession.sparkContext.broadcast(gains)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for batch, owner, bucket, words in worked(batches, text, shortest, longest, len(gain)):
            n = np.bincount(owner, minlength=len(words)).astype(np.int64)
            total = np.zeros(len(words), np.int64)
            np.add.at(total, owner, gain[bucket])
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield with_columns(batch, {name: pa.array(c.astype(np.int64)) for name, c in ((WORDS, words), (FEATURES, n), (WEIGHT, weight))})

    long = T.LongType()
    return docs.mapInArrow(work, widened(docs, *[T.StructField(name, long) for name in (WORDS, FEATURES, WEIGHT)]))


def noise(doc_id: str, seed: str) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    head = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((head + 0.5) / F.lit(4294967296.0))))


def cut_score(drawable: DataFrame, percent: int) -> tuple[int, int | None]:
    """How many rows to draw, and the lowest score among them. Counts per score are added up on
    the driver; scores lie in a range that the logarithms of the counts bound."""
    counts = drawable.groupBy(SCORE).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(SCORE, ascending=False)
    draw = percent * int(counts["n"].sum()) // 100
    if not draw:
        return 0, None
    reached = counts["n"].cumsum().to_numpy()
    return draw, int(counts[SCORE].iloc[int(np.searchsorted(reached, draw))])


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text",
    shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """``docs`` with ``_pl_features``, ``_pl_weight``, ``_pl_score`` and ``_pl_rank`` (from 1; null
    where the row is not drawn). Rows with ``least_words`` words or more take part in the draw."""
    gains = bucket_gains(
        bucket_counts(docs, text, shortest, longest, buckets),
        bucket_counts(target, target_text, shortest, longest, buckets), buckets,
    )
    scored = weigh(docs, gains, text, shortest, longest).withColumn(SCORE, F.col(WEIGHT) + noise(doc_id, seed))
    # Stored once, so a row keeps its number.
    scored = stored(scored.withColumn(ROW, F.monotonically_increasing_id()), "scored")
    drawable = scored.where(F.col(WORDS) >= least_words)
    draw, least = cut_score(drawable, percent)
    if least is None:
        return scored.withColumn(RANK, F.lit(None).cast("bigint")).drop(ROW, WORDS)
    leading = drawable.where(F.col(SCORE) >= least).select((-F.col(SCORE)).alias("_pl_down"), F.col(doc_id).alias("_pl_id"), ROW)
    ranked = number_rows(leading, ["_pl_down", "_pl_id", ROW], RANK).where(F.col(RANK) <= draw).select(ROW, RANK)
    return scored.join(ranked, ROW, "left").drop(ROW, WORDS)
