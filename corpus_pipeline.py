"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all
but the last return the columns of ``docs``. The chain holds a learned classifier, so it has no
SQL form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read, stored
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.minhash import near_duplicates, text_key
from plumbline.llm.mixing import mixed
from plumbline.llm.packing import pack
from plumbline.llm.quality import classify_quality, train
from plumbline.llm.queries import PACK_VOCABULARY
from plumbline.sources.shared import checked_keys

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of these documents, accepts."""
    model = train(docs, read(spark, sf_dir, "labels"))
    return classify_quality(docs, model).where(F.col("_pl_predicted") == 1).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand elsewhere first on many sites. A document of nothing but
    such lines goes, as all of it stands elsewhere."""
    cleaned = dedup_lines(docs)
    emptied = (F.col("_pl_removed") > 0) & (F.trim(F.replace("text", F.lit("\n"), F.lit(""))) == "")
    out = cleaned.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and one row of each id and text. Texts that
    share an id are judged apart."""
    name = ["doc_id", "_pl_h1", "_pl_h2"]
    judged = stored(
        near_duplicates(docs.select("doc_id", "text")).select(
            "doc_id", F.col("text_h1").alias("_pl_h1"), F.col("text_h2").alias("_pl_h2"), "kept"
        ),
        "judged",
    )
    dropped = judged.where(~F.col("kept")).select(*name).distinct()
    keyed = docs.withColumns(dict(zip(name[1:], text_key("text"))))
    out = keyed.join(checked_keys(dropped), name, "left_anti")
    known = judged.where("kept AND doc_id IS NOT NULL")
    if not known.groupBy(*name).count().where("count > 1").isEmpty():
        named = out.where(F.col("doc_id").isNotNull()).dropDuplicates(name)
        out = named.unionByName(out.where(F.col("doc_id").isNull()))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source begins them."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; see the packing operator."""
    return pack(docs, PACK_VOCABULARY)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each stored before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
