"""Packing by cutting-stock column generation.

A document is its token ids and an end id. It is cut into full sequences and one remainder; a
full piece is a sequence of its own. Remainders are counted in length classes of ``GRAIN``
tokens (a class stands for its longest length). On this histogram, which has a fixed number of
classes whatever the corpus, a linear program chooses patterns (how many of each class share a
sequence): simplex steps price new patterns by a knapsack dynamic program over the duals, until
none improves the plan by more than ``GAP``. Pattern counts are rounded down and what is left
over is placed first-fit, longest first.

The driver sees only the histogram and the plan. Documents are ranked within their class by a
hash-random key with distributed prefix counts; rank ranges, broadcast as a table bounded by
classes and patterns, name the sequence of each. Offsets run over the pieces of one sequence.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; equal
lengths are ordered by key, then id; an empty table gives an empty result. Extra columns are
dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored, total_before
from plumbline.llm.pretokens import WordIds
from plumbline.sources.relations import relation

CAPACITY = 4096
GRAIN = 16
GAP = 1e-4
END_ID = 2

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cut(docs: DataFrame, vocabulary: str, capacity: int, doc_id: str, text: str, keep_ids: bool) -> DataFrame:
    """One row per piece, of ``capacity`` tokens but for a document's last; with ``keep_ids``
    also ``ids``, the piece's ids as little-endian 32-bit numbers."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordIds(vocabulary)
        for batch in batches:
            ids, start, length, crc, tokens, parts = [], [], [], [], [], []
            for at, value in zip(batch["doc_id"], batch["text"]):
                data = (encoder.encode(value) if value else b"") + end
                for first in range(0, len(data), 4 * capacity):
                    part = data[first : first + 4 * capacity]
                    ids.append(at)
                    start.append(first // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    tokens.append(len(data) // 4)
                    if keep_ids:
                        parts.append(part)
            out = {"doc_id": pd.array(ids, dtype="Int64"), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": tokens}
            yield pd.DataFrame(out | ({"ids": parts} if keep_ids else {}))

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(pieces, PIECES + (", ids binary" if keep_ids else ""))


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The most valuable multiset of ``sizes`` (ascending) within ``capacity``, by dynamic
    programming over the capacity."""
    worth, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        worth[room] = worth[room - 1]
        fits = np.searchsorted(sizes, room, side="right")
        if fits:
            with_item = worth[room - sizes[:fits]] + values[:fits]
            best = int(with_item.argmax())
            if with_item[best] > worth[room]:
                worth[room], took[room] = with_item[best], best
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= sizes[took[room]]
    return pattern, float(worth[capacity])


def generate_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in the linear program's optimum (to within ``gap``)."""
    n = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / columns.diagonal())
    used = demand / columns.diagonal()
    for _ in range(50 * n):
        duals = inverse.sum(axis=0)
        pattern, value = best_pattern(sizes, np.maximum(duals, 0), capacity)
        if value <= 1 + gap:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        inverse[out] /= step[out]
        others = step.copy()
        others[out] = 0
        inverse -= np.outer(others, inverse[out])
        columns[:, out] = pattern
    return [(columns[:, i].astype(int), float(used[i])) for i in range(n)]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(class, first, last, sequence, each)``: the documents of a class ranked ``first`` up to
    before ``last`` fill sequences from ``sequence`` on, ``each`` to a sequence."""
    sizes = np.array(sorted(histogram), dtype=int)
    demand = np.array([histogram[s] for s in sizes], dtype=float)
    left = {int(s): histogram[int(s)] for s in sizes}
    rank = dict.fromkeys(left, 0)
    out, sequence = [], 0

    def use(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        for size, each in pattern.items():
            out.append((size, rank[size], rank[size] + each * times, sequence, each))
            rank[size] += each * times
            left[size] -= each * times
        sequence += times

    for column, amount in generate_columns(sizes, demand, capacity) if len(sizes) else []:
        pattern = {int(s): int(k) for s, k in zip(sizes, column) if k}
        times = min([int(amount + 1e-9), *(left[s] // k for s, k in pattern.items())])
        if times:
            use(pattern, times)
    bins: list[tuple[int, dict[int, int]]] = []
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            at = next((i for i, (room, _) in enumerate(bins) if room >= size), None)
            if at is None:
                bins.append((capacity, {}))
                at = len(bins) - 1
            room, held = bins[at]
            held[size] = held.get(size, 0) + 1
            bins[at] = (room - size, held)
    for _, held in bins:
        use(held, 1)
    return out


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, grain: int = GRAIN,
    doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    (and ``ids`` where asked for). A sequence's pieces have ``capacity`` tokens at most."""
    key = F.md5(F.concat_ws(":", F.lit("pack"), "doc_id", "start", "ids_crc32"))
    size = F.ceil(F.col("length") / grain).cast("int")
    pieces = stored(
        cut(docs, vocabulary, capacity, doc_id, text, keep_ids)
        .withColumn("_pl_key", key)
        .withColumn("_pl_class", size),
        "pieces",
    )
    histogram = {r[0]: r[1] for r in pieces.groupBy("_pl_class").count().collect()}
    ranges = relation(
        docs.sparkSession,
        "_pl_class int, _pl_first bigint, _pl_last bigint, _pl_sequence bigint, _pl_each bigint",
        plan(histogram, capacity // grain),
    )
    ranked = total_before(
        pieces, ["_pl_class"], "_pl_key", ["doc_id", "start"], F.lit(1).cast("bigint"),
        "_pl_rank", sum(histogram.values()),
    )
    nth = F.col("_pl_rank") - F.col("_pl_first")
    inside = (nth >= 0) & (F.col("_pl_rank") < F.col("_pl_last"))
    placed = (
        ranked.join(F.broadcast(ranges.withColumnRenamed("_pl_class", "_pl_of")), (F.col("_pl_class") == F.col("_pl_of")) & inside)
        .withColumn("sequence_id", F.col("_pl_sequence") + F.floor(nth / F.col("_pl_each")).cast("bigint"))
    )
    before = (
        Window.partitionBy("sequence_id").orderBy("_pl_key", "doc_id", "start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
        *(["ids"] if keep_ids else []),
    )
