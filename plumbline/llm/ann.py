"""Approximate nearest neighbours with a vantage-point tree per shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash of their id. Each shard builds a
tree over its unit vectors: a node splits by the median distance to a vantage point. Queries go
to every shard in blocks of ``QUERY_BLOCK``; a subtree is skipped where the triangle inequality,
with its bound multiplied by ``factor``, rules out anything as near as the k-th found so far. A
factor of one skips only what cannot matter, so the search is exact; larger factors skip more.
Scores are recomputed from the original vectors in double precision before they are compared,
so equal vectors tie exactly. Each shard returns k rows per query, which are merged per query.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
null ids, take no part; queries only meet vectors of their own length; a query never meets its
own id, though it does meet equal vectors of other ids; fewer candidates than k give all of them;
repeated rows of an id are candidates each and one query; an id on several vectors asks with the
least of them, compared entry by entry; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.llm.vectors import scaled, unit, usable

SHARD_ROWS = 2048
QUERY_BLOCK = 8192
LEAF = 64
FACTOR = 1.0
# Rounding that a comparison of distances or of scores may carry.
SLACK = 1e-7

FOUND = "query_id bigint, vec_id bigint, score double"


class Tree:
    """Nodes are ``(vantage, radius, inner, outer)`` over unit vectors, leaves arrays of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        vectors = scaled(vectors) if len(vectors) else vectors
        self.ids, self.vectors, self.unit = ids, vectors, unit(vectors)
        self.length = np.sqrt((vectors * vectors).sum(axis=1))
        self.root = self._split(np.arange(len(ids)))

    def _split(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage = rows[len(rows) // 2]
        away = distance(self.unit[rows] @ self.unit[vantage])
        radius = float(np.median(away))
        inner = away <= radius
        if inner.all():
            return rows
        return vantage, radius, self._split(rows[inner]), self._split(rows[~inner])

    def nearest(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the ``k`` best per query (-1: none), and their scores, best first."""
        vectors = scaled(vectors)
        self.q_ids, self.q, self.q_unit = ids, vectors, unit(vectors)
        self.q_length = np.sqrt((vectors * vectors).sum(axis=1))
        self.best = np.full((len(ids), k), -1)
        self.score = np.full((len(ids), k), -np.inf)
        self._visit(self.root, np.arange(len(ids)), factor)
        return self.best, self.score

    def _visit(self, node, queries: np.ndarray, factor: float) -> None:
        if not len(queries):
            return
        if isinstance(node, np.ndarray):
            self._compare(node, queries)
            return
        vantage, radius, inner, outer = node
        away = distance(self.q_unit[queries] @ self.unit[vantage])
        near_inner = away <= radius
        self._visit(inner, queries[near_inner], factor)
        self._visit(outer, queries[~near_inner], factor)
        reach = distance(self.score[queries, -1])
        crossing = factor * np.abs(away - radius) <= reach + SLACK
        self._visit(outer, queries[near_inner & crossing], factor)
        self._visit(inner, queries[~near_inner & crossing], factor)

    def _compare(self, rows: np.ndarray, queries: np.ndarray) -> None:
        rough = self.q_unit[queries] @ self.unit[rows].T
        may = rough >= self.score[queries, -1][:, None] - SLACK
        may &= self.ids[rows][None, :] != self.q_ids[queries][:, None]
        some = may.any(axis=1)
        queries, may = queries[some], may[some]
        if not len(queries):
            return
        score = np.full(may.shape, -np.inf)
        q, v = np.nonzero(may)
        for at in range(0, len(q), 20_000):
            i, j = queries[q[at : at + 20_000]], rows[v[at : at + 20_000]]
            dot = (self.q[i] * self.vectors[j]).sum(axis=1)
            score[q[at : at + 20_000], v[at : at + 20_000]] = dot / (self.q_length[i] * self.length[j])
        k = self.best.shape[1]
        nodes = np.hstack([self.best[queries], np.broadcast_to(rows, may.shape)])
        score = np.hstack([self.score[queries], score])
        names = np.where(nodes < 0, np.iinfo(np.int64).max, self.ids[nodes])
        order = np.lexsort((names, -score), axis=-1)[:, :k]
        line = np.arange(len(queries))[:, None]
        self.best[queries] = np.where(np.isfinite(score[line, order]), nodes[line, order], -1)
        self.score[queries] = score[line, order]


def distance(cosine: np.ndarray) -> np.ndarray:
    """Between unit vectors; infinite where nothing was found (a score of minus infinity)."""
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for each row where ``is_query`` holds: ``query_id,
    rank`` (from 1), ``vec_id, score``."""
    part = vectors.where(usable(vector) & F.col(vec_id).isNotNull())
    rows = part.select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
        is_query.alias("is_query"),
    ).withColumn("dim", F.size("vector"))
    rows = stored(rows, "vectors")
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    shards = max(1, -(-total // shard_rows))
    blocks = max(1, -(-asked // query_block))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    data = rows.select(
        "dim", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"),
        every(blocks, "block"), "id", "vector",
    )
    asking = rows.where("is_query").groupBy("id").agg(F.min("vector").alias("vector"))
    queries = asking.select(
        F.size("vector").alias("q_dim"),
        F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int").alias("q_block"),
        every(shards, "q_shard"), F.col("id").alias("q_id"), F.col("vector").alias("q_vector"),
    )

    def meet(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        shard = shard.sort_values("id")
        tree = Tree(shard["id"].to_numpy(np.int64), np.array(shard["vector"].tolist(), dtype=float))
        ids = block["q_id"].to_numpy(np.int64)
        best, score = tree.nearest(ids, np.array(block["q_vector"].tolist(), dtype=float), k, factor)
        found = best >= 0
        return pd.DataFrame(
            {"query_id": np.repeat(ids, found.sum(axis=1)), "vec_id": tree.ids[best[found]], "score": score[found]}
        )

    key = ["dim", "shard", "block"]
    found = data.groupBy(*key).cogroup(queries.groupBy(*[f"q_{c}" for c in key])).applyInPandas(meet, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
