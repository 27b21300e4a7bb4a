"""Column helpers: guarded casts, canonical text, digests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a text must look like before it is cast. Without the guard Spark
# also takes '2020' for a date and other engines take '1.5' for a whole number.
SHAPES = {
    "int": r"^[+-]?[0-9]{1,10}$",
    "bigint": r"^[+-]?[0-9]{1,19}$",
    "decimal": r"^[+-]?[0-9]+(\.[0-9]+)?$",
    "double": r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp_ntz": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2})?$",
}

OPEN_END = "9999-12-31 00:00:00"
NULL_MARK = "\\N"


def open_end() -> Column:
    return F.lit(OPEN_END).cast("timestamp_ntz")


def guarded_cast(text: Column, kind: T.DataType) -> Column:
    """``try_cast`` behind a shape check; NULL where the text is not of that shape."""
    name = kind.simpleString()
    shape = SHAPES.get(name.split("(")[0])
    if shape is None:
        return text.try_cast(kind)
    return F.when(text.rlike(shape), text.try_cast(kind))


def canonical(df: DataFrame, column: str, cast: str | None = None) -> Column:
    """One text per value, the same on every run. A double without a declared cast is written
    in full, so no two values share a text; other engines may write it otherwise, so a digest
    that they must repeat declares a cast for it."""
    value = F.col(column)
    kind = df.schema[column].dataType
    if cast is not None:
        value = value.cast(cast)
    elif isinstance(kind, T.TimestampType):
        value = F.to_utc_timestamp(value, F.current_timezone()).cast("timestamp_ntz")
    if isinstance(kind, T.StringType):
        value = F.replace(value, F.lit("|"), F.lit("\\|"))
    return F.coalesce(value.cast("string"), F.lit(NULL_MARK))


def row_digest(
    df: DataFrame, columns: Sequence[str], casts: Mapping[str, str] | None = None
) -> Column:
    casts = casts or {}
    return F.md5(F.concat_ws("|", *[canonical(df, c, casts.get(c)) for c in columns]))


def row_fingerprint(columns: Sequence[str]) -> Column:
    """128 bits that tell rows apart, from two seeded 64-bit hashes of the typed values. It
    never leaves the engine, so it needs no canonical text and costs a fraction of
    ``row_digest``. NULLs are hashed by position, as the hash itself passes over them."""
    parts = [part for c in columns for part in (F.col(c).isNull(), F.col(c))]
    return F.struct(
        F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b")
    )


def compact(texts: Sequence[Column]) -> Column:
    """The distinct non-NULL texts, in order. Unlike a higher-order filter, this stays inside
    generated code, and so do the expressions that make the texts."""
    return F.array_except(F.array(*texts), F.array(F.lit(None).cast("string")))


def join_null_safe(left: DataFrame, right: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """Join by ``key`` with NULL as a key like any other. The left key is kept; for a full join
    it is taken from the side that has the row."""
    key = list(key)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in key}).withColumn("_r_row", F.lit(True))
    match = same([F.col(k) for k in key], [F.col(f"_r_{k}") for k in key])
    if how in ("left_semi", "left_anti"):
        return left.join(renamed, match, how)
    joined = left.withColumn("_l_row", F.lit(True)).join(renamed, match, how)
    own = {k: F.when(F.col("_l_row"), F.col(k)).otherwise(F.col(f"_r_{k}")) for k in key}
    return joined.withColumns(own).drop("_l_row", "_r_row", *[f"_r_{k}" for k in key])


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """All pairs equal, NULL counting as a value."""
    test = F.lit(True)
    for a, b in zip(left, right, strict=True):
        test = test & a.eqNullSafe(b)
    return test
