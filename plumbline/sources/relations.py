"""Small relations given as Python literals: rules, contracts, codes, bands, units."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def relation(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A local relation with exact size statistics, so that Spark itself broadcasts it
    where it is below the broadcast threshold and shuffles it where it is not."""
    parsed = StructType.fromDDL(schema)
    table = pa.Table.from_pylist(
        [dict(zip(parsed.names, row, strict=True)) for row in rows],
        schema=to_arrow_schema(parsed),
    )
    return spark.createDataFrame(table, schema=parsed)
