"""Embedding near-dedup with hierarchical navigable small-world graphs.

Vectors of one label are dealt by hash to shards of about ``SHARD_ROWS``; each shard builds one
graph, stored once. Every shard of a label is then searched by all vectors of that label, in
blocks of one shard's size, so a task holds one graph and one block whatever the label's share
of the rows. A task starts with a beam of ``BEAM``; for a hash-chosen sample of its queries it
compares what was found with an exact scan of the shard, and doubles the beam until for at least
``RECALL`` of these queries all links (where a query has none here, its ``NEAREST`` rows) are
found. Where the widest beam fails, every query scans the shard. Cosines are verified in double
precision. A task returns
link counts and a spanning forest of its links, so a group of near copies never becomes pairs;
the forests are united by distributed components.

Equal vectors of one label are one node with a weight; they are linked by definition and never
expanded.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
those with a null label, link with nothing, and are kept; vectors of different lengths are not
compared; repeated rows link with each other; a null id takes part in no link; an empty table
gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, stored
from plumbline.llm.hnsw import Graph
from plumbline.llm.vectors import unit, usable
from plumbline.operators.history import number_rows

THRESHOLD = 0.98
SHARD_ROWS = 8192
BEAM = 64
# Beyond this beam a search costs more than the exact scan of a shard.
WIDEST = 256
RECALL = 0.999
AUDITED = 64
NEAREST = 4
# What two ways to add up a cosine may differ by.
ROUNDING = 1e-9
QUERIES = 64

GROUP = ["label", "dim"]
SHARD = "label string, dim int, shard int, ids binary, weights binary, unit binary, graph binary"
FOUND = "a bigint, b bigint, n bigint"


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: its vectors and its graph as bytes."""
    rows = rows.sort_values("id")
    vectors = unit(np.array(rows["vector"].tolist(), dtype=float))
    ids = rows["id"].to_numpy(dtype=np.int64)
    first = rows.iloc[0]
    return pd.DataFrame(
        {
            "label": [first["label"]], "dim": [first["dim"]], "shard": [first["shard"]],
            "ids": [ids.tobytes()], "weights": [rows["weight"].to_numpy(dtype=np.int64).tobytes()],
            "unit": [vectors.tobytes()], "graph": [Graph(ids, vectors).to_bytes()],
        }
    )


class Forest:
    """Joins nodes and remembers one edge for each join."""

    def __init__(self, nodes: int):
        self.parent, self.edges = np.arange(nodes), []

    def join(self, nodes: np.ndarray) -> None:
        root = self.parent[nodes]
        while True:
            above = self.parent[root]
            if (above == root).all():
                break
            root = above
        self.parent[nodes] = root
        root = np.unique(root)
        if len(root) > 1:
            self.parent[root] = root[0]
            self.edges += [(root[0], r) for r in root[1:]]


def search(graph: Graph, ids: np.ndarray, weights: np.ndarray, queries: np.ndarray, vectors: np.ndarray, threshold: float, beam: int) -> pd.DataFrame:
    """Link counts of ``queries`` in this shard (``a``, ``n``) and forest edges (``a``, ``b``)."""
    own = np.searchsorted(ids, queries)
    own[own == len(ids)] = 0
    inside = ids[own] == queries

    def others(at: np.ndarray, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = ids[node] != queries[at][row]
        return at[row[other]], node[other]

    def find(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return others(at, *graph.within(vectors[at], threshold, beam))

    def scan(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return others(at, *np.nonzero(vectors[at] @ given.T >= threshold))

    order = np.argsort((queries.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), kind="stable")
    audit = np.sort(order[:AUDITED])
    given = graph.given()
    cosine = vectors[audit] @ given.T
    exact = (cosine >= threshold + ROUNDING) & (ids[None, :] != queries[audit][:, None])
    linked = exact.any(axis=1)
    few = min(NEAREST, len(ids))
    nearest = -np.sort(-cosine[~linked], axis=1)[:, :few]
    while True:
        rows, nodes = find(audit)
        missed = exact.copy()
        missed[np.searchsorted(audit, rows), nodes] = False
        right = ~missed.any(axis=1)
        if len(nearest):
            found = graph.best(vectors[audit[~linked]], beam, few)
            right[~linked] = (found >= nearest - ROUNDING).all(axis=1)
        if right.mean() >= RECALL:
            break
        if beam >= min(len(ids), WIDEST):
            find = scan
            break
        beam *= 2
    forest = Forest(len(ids) + len(queries))
    node_of = np.where(inside, own, len(ids) + np.arange(len(queries)))
    links = np.zeros(len(queries), dtype=np.int64)
    for first in range(0, len(queries), QUERIES):
        rows, nodes = find(np.arange(first, min(len(queries), first + QUERIES)))
        np.add.at(links, rows, weights[nodes])
        order = np.argsort(rows, kind="stable")
        rows, nodes = rows[order], nodes[order]
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1) if len(rows) else []:
            forest.join(np.append(nodes[part], node_of[rows[part[0]]]))
    names = np.append(ids, queries)
    edges = np.array([(names[a], names[b]) for a, b in forest.edges], dtype=np.int64).reshape(-1, 2)
    some = links > 0
    return pd.DataFrame(
        {
            "a": np.append(queries[some], edges[:, 0]),
            "b": pd.array([None] * int(some.sum()) + edges[:, 1].tolist(), dtype="Int64"),
            "n": np.append(links[some], np.zeros(len(edges), dtype=np.int64)),
        }
    )


def find_links(nodes: DataFrame, threshold: float, shard_rows: int, beam: int) -> DataFrame:
    """Counts and forest edges over ``nodes (id, label, dim, vector, weight)``."""
    sizes = nodes.groupBy(*GROUP).agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(sizes, GROUP).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    shards = stored(dealt.groupBy(*GROUP, "shard").applyInPandas(build, SHARD), "graphs")
    # Every shard meets every block of its label: the graph goes to each block's task, and the
    # block's vectors to each shard's.
    counts = shards.groupBy(*GROUP).agg(F.count(F.lit(1)).cast("int").alias("shards"))
    spread = shards.join(counts, GROUP).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    )
    graphs = spread.withColumnRenamed("other", "block")
    blocks = spread.select(
        F.col("label").alias("q_label"), F.col("dim").alias("q_dim"), F.col("other").alias("q_shard"),
        F.col("shard").alias("q_block"), F.col("ids").alias("q_ids"), F.col("unit").alias("q_unit"),
    )

    def meet(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        s, q = shard.iloc[0], block.iloc[0]
        ids = np.frombuffer(s["ids"], np.int64)
        vectors = np.frombuffer(s["unit"]).reshape(len(ids), -1)
        queries = np.frombuffer(q["q_ids"], np.int64)
        return search(
            Graph.from_bytes(s["graph"], vectors), ids, np.frombuffer(s["weights"], np.int64),
            queries, np.frombuffer(q["q_unit"]).reshape(len(queries), -1), threshold, beam,
        )

    key = [*GROUP, "shard", "block"]
    return stored(
        graphs.groupBy(*key).cogroup(blocks.groupBy(*[f"q_{c}" for c in key])).applyInPandas(meet, FOUND), "found"
    )


def dedup_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, beam: int = BEAM,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    given = vectors.select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    takes_part = usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull()
    marked = given.select(
        "id", "label", F.size("vector").alias("dim"), F.xxhash64("vector").alias("h1"),
        F.xxhash64(F.lit(1), "vector").alias("h2"), takes_part.alias("part"),
    )
    rows = stored(marked, "vectors")
    same = [*GROUP, "h1", "h2"]
    firsts = rows.where("part").groupBy(*same).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"))
    # A node is one vector, numbered in the order of its smallest id, as one id may stand on several.
    classes = stored(number_rows(firsts, ["first", *same], "node"), "classes")
    nodes = (
        given.where(takes_part)
        .select("id", "label", F.size("vector").alias("dim"), "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
        .join(classes, same).where(F.col("id") == F.col("first"))
        .dropDuplicates(["node"])
        .select(F.col("node").alias("id"), *GROUP, "vector", "weight")
    )
    found = find_links(nodes, threshold, shard_rows, beam)
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    names = classes.select(F.col("node").alias("component"), F.col("first").alias("name"))
    groups = components(found.where(F.col("b").isNotNull()).select("a", "b")).join(names, "component")
    judged = (
        classes.join(counts, "node", "left").join(groups, "node", "left")
        .select(
            *same, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("name", "first").alias("component_id"),
        )
    )
    linked = rows.where("part").join(judged, same).select("id", "n_links", "component_id")
    alone = rows.where(~F.col("part")).select("id", F.lit(0).cast("bigint"), F.col("id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return linked.union(alone).select(
        F.col("id").alias("vec_id"), F.col("n_links").cast("bigint").alias("n_links"), "component_id", kept.alias("kept")
    )
