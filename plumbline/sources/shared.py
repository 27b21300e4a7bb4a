"""Storage that outlives an executor: where lineage is cut and stages are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Key lists up to these bounds are broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20


# Spark otherwise keeps the files of a finished shuffle until the driver collects its garbage.
CLEARED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleared_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that wrote them ends: what it stored is read instead."""
    before = spark.conf.get(CLEARED, None)
    spark.conf.set(CLEARED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEARED)
        else:
            spark.conf.set(CLEARED, before)


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``. Only a session with a local
    master may name none: a temporary folder is then set in its place. On a cluster each
    executor would write such a folder to its own disk, so a missing setting is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root is None:
        root = context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(root)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for a written table below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so that a lost executor cannot force (or, where
    row placement matters, change) the work above this point."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back. Unlike a checkpoint
    it keeps columns apart, so each later step reads only those it needs. Zstandard codes the digests
    and amounts of a row, which do not repeat, where the default of Spark leaves them almost as they are."""
    path = fresh_path(df.sparkSession, name)
    with cleared_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_keys(
    keys: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """A list of keys to filter a large relation by. It is stored and measured; up to
    ``max_rows`` rows and ``max_bytes`` bytes it is broadcast, so the large relation is not
    shuffled for it, and beyond that the join shuffles both sides."""
    stored = cut_lineage(keys)
    width = F.lit(0)
    for c in stored.columns:
        width = width + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 8
    rows, size = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(stored) if rows <= max_rows and size <= max_bytes else stored
