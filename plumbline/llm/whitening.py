"""Whitening of embeddings by their leading principal components.

Entries become whole numbers, so counts and sums are exact. Three passes over the vectors: sums per
dimension; the covariance, of entries centred before they are multiplied, added up per task and then
by a shuffle of one row per task and entry pair; and the projection. Only the covariance, a
matrix of dimension by dimension whatever the number of vectors, meets on the driver, where its
leading eigenpairs are found (``eigen``: tridiagonal form, Sturm counts, inverse iteration). The
components, at most ``components`` vectors, are broadcast. The projected rows are stored without their
vectors, and the covariance of what was stored is compared with the identity.

Defined results: vectors that are null or hold null or non-finite entries are dropped, as are those
of another length than the commonest (the shorter, if two are as common) and empty ones; entries of
2^30 and more in absolute value count as 2^30; components without variance have null
``whitened`` values and do not count in ``identity_error``; without any variance ``explained`` and
``identity_error`` are null; a ``deviation`` beyond 64 bits is null; repeated rows count each; an empty
table gives an empty result. Other columns, null ids included, pass through; the vector does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bpe import widened, with_columns
from plumbline.llm.common import stored
from plumbline.llm.eigen import EPSILON, leading_pairs

COMPONENTS = 8
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 30)
# Rows multiplied at once.
ROWS = 8192

COUNT, DEVIATION, WHITENED, EXPLAINED, ERROR = "_pl_n", "_pl_deviation", "_pl_whitened", "_pl_explained", "_pl_identity_error"


def whole(vector: str) -> Column:
    """Not null and without null or non-finite entries."""
    finite = F.forall(
        F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def matrices(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of equal length with their entries as whole numbers."""
    for batch in batches:
        lengths = batch.column(vector).value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(lengths):
            own = batch.filter(pa.array(lengths == d)) if (lengths != d).any() else batch
            for at in range(0, own.num_rows, ROWS):
                part = own.slice(at, ROWS)
                entries = part.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, int(d))
                yield part, np.floor(SCALE * np.clip(entries, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


class Fit:
    """What the fit list amounts to: ``n``, sums per dimension, components and their shares."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([s % n / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def solved(self, covariance: np.ndarray, components: int) -> None:
        trace = float(np.trace(covariance))
        values, vectors = leading_pairs(covariance, min(components, len(covariance)))
        varies = values > 8 * len(covariance) * EPSILON * trace
        self.explained = [float(v / trace) if trace > 0 else None for v in values]
        self.projection = np.full_like(vectors, np.nan)
        self.projection[varies] = vectors[varies] / np.sqrt(values[varies])[:, None]
        self.varies = varies

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact sums of squares of n*x - S, and which of them fit 64 bits. Arithmetic modulo 2^64
        is exact for those; rows near the limit are settled with Python's own numbers."""
        rough = ((self.centred(x) * self.n) ** 2).sum(axis=1)
        limit = 2.0**63
        fits, near = rough < limit, np.abs(rough - limit) < 1e-3 * limit
        sums = np.array([s % (1 << 64) for s in self.sums], np.uint64).view(np.int64)
        away = x * np.int64(self.n) - sums
        exact = (away * away).sum(axis=1)
        for i in np.flatnonzero(near):
            own = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums))
            fits[i] = own < 1 << 63
            exact[i] = own if fits[i] else 0
        return exact, fits


def fitted(part: DataFrame, vector: str) -> Fit | None:
    """Count and sums of the vectors of the commonest length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for _, x in matrices(batches, vector):
            own = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
            own[0] += len(x)
            own[1] += x.sum(axis=0)
        for d, (n, sums) in total.items():
            yield pa.RecordBatch.from_pydict({"d": [d], "n": [n], "sums": [[str(s) for s in sums]]})

    totals = part.select(vector).mapInArrow(add, "d long, n long, sums array<string>")
    each = totals.select("d", "n", F.posexplode("sums").alias("pos", "s")).groupBy("d", "pos").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    )
    each = stored(each, "sums")
    commonest = each.where("pos = 0").orderBy(F.desc("n"), "d").limit(1).first()
    if commonest is None:
        return None
    rows = each.where(F.col("d") == commonest["d"]).orderBy("pos").collect()
    return Fit(commonest["n"], [int(r["s"]) for r in rows])


def covariance(part: DataFrame, vector: str, fit: Fit) -> np.ndarray:
    d = len(fit.sums)
    known = part.sparkSession.sparkContext.broadcast(fit)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros((d, d)), known.value
        for _, x in matrices(batches, vector):
            if x.shape[1] == d:
                away = own.centred(x)
                total += away.T @ away
        yield pa.RecordBatch.from_pydict({"products": [total.ravel()]})

    products = part.select(vector).mapInArrow(add, "products array<double>")
    rows = products.select(F.posexplode("products").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(d * d)
    out[rows["pos"].to_numpy()] = rows["v"].to_numpy() / fit.n
    return out.reshape(d, d)


def projected(part: DataFrame, vector: str, fit: Fit) -> DataFrame:
    """Rows with ``_pl_deviation`` and ``_pl_whitened``, without their vectors."""
    known = part.sparkSession.sparkContext.broadcast(fit)
    fields = [T.StructField(DEVIATION, T.LongType()), T.StructField(WHITENED, T.ArrayType(T.DoubleType()))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for batch, x in matrices(batches, vector):
            if x.shape[1] != len(own.sums):
                continue
            exact, fits = own.deviations(x)
            values = own.centred(x) @ own.projection.T
            ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
            whitened = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), mask=np.isnan(values.ravel())))
            out = with_columns(batch, {DEVIATION: pa.array(exact, mask=~fits), WHITENED: whitened})
            yield out.select([n for n in out.schema.names if n != vector])

    kept = [f for f in widened(part, *fields).fields if f.name != vector]
    return part.mapInArrow(work, T.StructType(kept))


def identity_error(rows: DataFrame, fit: Fit) -> float | None:
    """The largest entry by which the covariance of whitened rows differs from the identity."""
    k = [int(i) for i in np.flatnonzero(fit.varies)]
    if not k:
        return None
    value = lambda i: F.col(WHITENED)[i]
    mean = rows.agg(*[F.avg(value(i)).alias(f"m{i}") for i in k]).first()
    pairs = [(i, j) for i in k for j in k if i <= j]
    found = rows.agg(
        *[F.avg((value(i) - mean[f"m{i}"]) * (value(j) - mean[f"m{j}"])).alias(f"c{i}_{j}") for i, j in pairs]
    ).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """Rows of ``vectors`` with ``_pl_n``, ``_pl_deviation``, ``_pl_whitened`` (one value per component),
    ``_pl_explained`` (their shares of the variance) and ``_pl_identity_error``."""
    part = vectors.where(whole(vector))
    fit = fitted(part, vector)
    lists = "array<double>"
    if fit is None:
        none = {COUNT: "long", DEVIATION: "long", WHITENED: lists, EXPLAINED: lists, ERROR: "double"}
        return part.drop(vector).withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    fit.solved(covariance(part, vector, fit), components)
    rows = stored(projected(part, vector, fit), "whitened")
    return rows.withColumns(
        {
            COUNT: F.lit(fit.n).cast("long"),
            EXPLAINED: F.array(*[F.lit(e) for e in fit.explained]).cast(lists),
            ERROR: F.lit(identity_error(rows, fit)).cast("double"),
        }
    )
