"""Reading raw files under a fixed schema, and writing stage outputs (IN-01, IN-02, IN-13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

CORRUPT = "_corrupt"


def scan(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", **options
) -> DataFrame:
    """IN-01. Scan under an explicit schema; the schema is never inferred."""
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def scan_delimited(
    spark: SparkSession, path: str, schema: StructType, sep: str = "|", quote: str = ""
) -> DataFrame:
    """IN-02. Scan delimited text. A line that does not fit the schema keeps what did parse
    and carries the raw line in ``_corrupt``; no line is lost. Quoting is off by default, as a
    stray quote would swallow separators."""
    with_corrupt = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("sep", sep)
        .option("quote", quote)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def as_text(kind: DataType) -> DataType:
    """The same shape with text at every leaf."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, as_text(f.dataType)) for f in kind.fields])
    return ArrayType(as_text(kind.elementType)) if isinstance(kind, ArrayType) else StringType()


def scan_xml(spark: SparkSession, path: str, schema: StructType | str, row_tag: str) -> DataFrame:
    """IN-06. Scan nested XML records of the shape of ``schema``. Values are read as text, to be cast
    with error codes (IN-07): a value that is no number then spoils its own field alone, and the
    reader, which keeps the text of the whole file for a record that it cannot fit, need not. Records
    that are broken as XML carry that text in ``_corrupt``; no record is lost."""
    wanted = as_text(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    with_corrupt = StructType([*wanted.fields, StructField(CORRUPT, StringType())])
    return (
        spark.read.schema(with_corrupt).format("xml").option("rowTag", row_tag)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).load(path)
    )


def write_stage(df: DataFrame, path: str, parts: Sequence[str]) -> DataFrame:
    """IN-13. Write a stage output; only the partitions present in ``df`` are replaced, so
    repeating a write changes nothing. Returns the stored relation.

    ``df`` must not read ``path``: materialise it first (``sources.shared.cut_lineage``).
    Rows are rebalanced by partition before the write: adaptive execution merges small
    partitions into one task and splits a hot one over many, so files come out near the
    advisory size instead of one per task and partition.
    """
    (
        df.hint("rebalance", *parts)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )
    return df.sparkSession.read.schema(df.schema).parquet(path)
