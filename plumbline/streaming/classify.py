"""Classification of raw files as they arrive. EC-01 is row-local, so the batch operators are
used as they are; Structured Streaming keeps track of the files already taken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plumbline.operators.classify import Rule, classify
from plumbline.operators.ingest import cast_fields, mark_disposition, split_line


def classify_arrivals(
    spark: SparkSession,
    folder: str,
    sep: str,
    schema: StructType,
    rules: Sequence[Rule],
    target: str,
    progress: str,
) -> StreamingQuery:
    """Take every new text file of ``folder``, parse and classify its lines, append them to the
    Parquet folder ``target``, then stop. ``progress`` (a folder on shared storage) makes a
    restart continue where the last run ended, each file counted once. The raw line stays with
    its row, so a quarantined one can be mended and sent again."""
    lines = spark.readStream.text(folder).withColumnRenamed("value", "line")
    fields = split_line(lines, "line", sep, schema.fieldNames())
    judged = classify(mark_disposition(cast_fields(fields, schema)).withColumnRenamed(
        "disposition", "parse_disposition"), rules)
    return (
        judged.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
