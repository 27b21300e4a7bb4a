"""Byte-level BPE encoding and decoding under a rank file.

Texts are cut into pre-tokens by ``pretoken_scan``; a pre-token that is no vocabulary entry has its
bytes merged pair by pair, lowest rank first and leftmost among equals, once per worker: results
are cached by pre-token. The cache keeps short pre-tokens and stops growing at ``CACHE`` entries;
what finds no place is merged again, so results never depend on it. Long pre-tokens are merged with
a heap, in time near linear in their length.

Encoding keeps for every token the offset of its first byte in the text's UTF-8. Decoding writes
each token's bytes at its offset, so any run of tokens decodes alone; without offsets they follow
from the lengths of the tokens before. Batches are worked off in chunks of about ``CHUNK``
characters, at least one text, so memory is bounded by the longest text.

Defined results: a null text encodes as an empty one, to no tokens; text that looks like a special
token is ordinary text; null ids decode to no bytes; an id that the vocabulary does not hold fails
the job; repeated rows are encoded each; an empty table gives an empty result. Other columns,
whatever their names, pass through.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.pretoken_scan import boundaries, class_table

CACHE = 700_000
LONGEST_CACHED = 48
CHUNK = 1 << 20
# Pieces up to this many bytes are merged by plain search.
PLAIN = 64

IDS, OFFSETS, DECODED = "_pl_ids", "_pl_offsets", "_pl_decoded"


def merge_plain(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    rank, none = ranks.get, 1 << 60
    parts = [piece[i : i + 1] for i in range(len(piece))]
    found = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while found:
        least = min(found)
        if least == none:
            break
        at = found.index(least)
        parts[at] += parts.pop(at + 1)
        del found[at]
        if at:
            found[at - 1] = rank(parts[at - 1] + parts[at], none)
        if at < len(found):
            found[at] = rank(parts[at] + parts[at + 1], none)
    return [ranks[p] for p in parts]


def merge_heap(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(a: int) -> None:
        """The pair that begins at ``a``, with both its ends, which tell whether it still stands."""
        middle = end[a]
        if middle < n and (rank := ranks.get(piece[a : end[middle]])) is not None:
            heapq.heappush(heap, (rank, a, middle, end[middle]))

    for a in range(n - 1):
        offer(a)
    gone = bytearray(n)
    while heap:
        _, a, middle, last = heapq.heappop(heap)
        if gone[a] or end[a] != middle or end[middle] != last:
            continue
        end[a], gone[middle] = last, 1
        if last < n:
            before[last] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [ranks[piece[a : end[a]]] for a in range(n) if not gone[a]]


class Vocabulary(dict):
    """Ids, as little-endian 32-bit numbers, of pre-tokens; missing ones are merged."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        entries = [b""] * size
        for entry, i in self.ranks.items():
            entries[i] = entry
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        return (merge_plain if len(piece) <= PLAIN else merge_heap)(self.ranks, piece)

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.merge(piece.encode()), "<i4").tobytes()
        if len(piece) <= LONGEST_CACHED and len(self) < CACHE:
            self[piece] = ids
        return ids

    def encode(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the byte offset of each in its own text, and tokens per text."""
        parts, counts = [], []
        for text, begin in zip(texts, boundaries(texts, table)):
            cuts = begin.tolist()
            pieces = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
            data = b"".join(map(self.__getitem__, pieces))
            parts.append(data)
            counts.append(len(data) // 4)
        ids = np.frombuffer(b"".join(parts), "<i4")
        counts = np.array(counts, np.int64)
        return ids, self.offsets(ids, counts), counts

    def offsets(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Where each token begins: the lengths of the tokens before it in its text."""
        length = self.length[ids]
        upto = np.cumsum(length) - length
        first = np.cumsum(counts) - counts
        return upto - np.repeat(np.append(upto, 0)[first], counts)

    def decode(self, ids: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, one after the other, and the number of bytes of each."""
        if len(ids) and not ((ids >= 0) & (ids < len(self.length))).all():
            raise ValueError("an id is not in the vocabulary")
        length, text = self.length[ids], np.repeat(np.arange(len(counts)), counts)
        size = np.zeros(len(counts), np.int64)
        np.maximum.at(size, text, offsets + length)
        base = np.cumsum(size) - size
        ramp = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out = np.zeros(int(size.sum()), np.uint8)
        out[np.repeat(base[text] + offsets, length) + ramp] = self.bytes[np.repeat(self.start[ids], length) + ramp]
        return out, size


@functools.lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    """One per worker, kept from task to task."""
    return Vocabulary(path)


def chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of ``most`` in all, at least one row each."""
    upto, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, done + most, "right")))
        yield start, end
        start = end


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32, copy=False)))


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: c for n, c in zip(batch.schema.names, batch.columns) if n not in new}
    return pa.RecordBatch.from_arrays([*kept.values(), *new.values()], names=[*kept, *new])


def widened(df: DataFrame, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([*[f for f in df.schema.fields if f.name not in names], *fields])


def encode(docs: DataFrame, vocabulary: str, text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with ``_pl_ids`` and ``_pl_offsets``. ``vocabulary`` is the path of a rank file that
    driver and executors have; ``pattern`` the one its merges were learnt under."""
    table = docs.sparkSession.sparkContext.broadcast(class_table(pattern))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes = vocabulary_of(vocabulary), table.value
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for a, b in chunks(np.array([len(t) for t in texts], np.int64), CHUNK):
                ids, offsets, counts = words.encode(texts[a:b], classes)
                yield with_columns(batch.slice(a, b - a), {IDS: lists(ids, counts), OFFSETS: lists(offsets, counts)})

    numbers = T.ArrayType(T.IntegerType())
    return docs.mapInArrow(work, widened(docs, T.StructField(IDS, numbers), T.StructField(OFFSETS, numbers)))


def decode(tokens: DataFrame, vocabulary: str, ids: str = IDS, offsets: str | None = OFFSETS) -> DataFrame:
    """``tokens`` with ``_pl_decoded``, the bytes of ``ids``, each token's at its offset."""

    def flat(batch: pa.RecordBatch, name: str, a: int, b: int) -> np.ndarray:
        return batch.column(name).slice(a, b - a).flatten().to_numpy(zero_copy_only=False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_of(vocabulary)
        for batch in batches:
            counts = batch.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in chunks(counts, CHUNK // 4):
                own = flat(batch, ids, a, b)
                at = words.offsets(own, counts[a:b]) if offsets is None else flat(batch, offsets, a, b).astype(np.int64)
                data, size = words.decode(own, at, counts[a:b])
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
                yield with_columns(batch.slice(a, b - a), {DECODED: column})

    return tokens.mapInArrow(work, widened(tokens, T.StructField(DECODED, T.BinaryType())))
