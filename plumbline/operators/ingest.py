"""Parsing and normalization (IN-03 to IN-12). All row-local but IN-10."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, StringType, StructField, StructType

from plumbline.functions.values import compact, guarded_cast, row_digest
from plumbline.sources.scan import CORRUPT, write_stage

ERRORS = "errors"
DISPOSITION = "disposition"
ACCEPTED, QUARANTINED = "ACCEPTED", "QUARANTINED"
UNROUTED = "UNROUTED"
RECORD_TYPE = "record_type"
ARITY_OK = "arity_ok"
CORRUPT_RECORD = "_corrupt_record"


def split_line(df: DataFrame, col: str, sep: str, fields: Sequence[str]) -> DataFrame:
    """IN-03. Split a delimited line into text fields; ``arity_ok`` tells whether the line
    had exactly as many as declared. Missing fields are NULL."""
    parts = F.split(F.col(col), f"\\Q{sep}\\E", -1)
    return df.withColumn("_parts", parts).select(
        "*",
        *[F.get("_parts", F.lit(i)).alias(name) for i, name in enumerate(fields)],
        (F.size("_parts") == len(fields)).alias("arity_ok"),
    ).drop("_parts")


@dataclass(frozen=True)
class Slot:
    """A fixed-width field: 1-based start, width and target type."""

    name: str
    start: int
    width: int
    kind: DataType


def cut_fixed(df: DataFrame, col: str, layout: Sequence[Slot]) -> DataFrame:
    """IN-04. Cut fixed-width records. A blank field is NULL; a value that does not parse is NULL
    and leaves an error code in ``errors``."""
    fields = [slot_value(col, slot).alias(slot.name) for slot in layout]
    return df.select("*", *fields, slot_errors(col, layout).alias(ERRORS))


def slot_text(col: str, slot: Slot) -> Column:
    return F.nullif(F.trim(F.substring(F.col(col), slot.start, slot.width)), F.lit(""))


def slot_value(col: str, slot: Slot) -> Column:
    text = slot_text(col, slot)
    return text if slot.kind.simpleString() == "string" else guarded_cast(text, slot.kind)


def slot_errors(col: str, layout: Sequence[Slot]) -> Column:
    """Error codes of fields that are there but do not parse."""
    return compact(
        [
            F.when(slot_text(col, s).isNotNull() & slot_value(col, s).isNull(), F.lit(f"BAD:{s.name}"))
            for s in layout
        ]
    )


def route_records(
    df: DataFrame, col: str, tag: Column, layouts: Mapping[str, Sequence[Slot]]
) -> dict[str, DataFrame]:
    """IN-05. One relation per record type of a mixed file. Each is a filter over the scan
    and parses only its own layout; nothing is cached, as the filter comes first. Records of no
    declared type come out as they are, under ``UNROUTED``, with an error code."""
    routed = {
        name: cut_fixed(df.where(tag == name), col, layout) for name, layout in layouts.items()
    }
    known = F.coalesce(tag.isin(*layouts), F.lit(False))
    return routed | {UNROUTED: df.where(~known).withColumn(ERRORS, F.array(F.lit("BAD:tag")))}


def tag_records(
    df: DataFrame, col: str, tag: Column, layouts: Mapping[str, Sequence[Slot]]
) -> DataFrame:
    """IN-05 in one pass. ``record_type`` (``UNROUTED`` where none is declared), ``errors``, and for
    each type a struct of its fields, NULL on records of other types. A record is parsed once, by its
    own layout."""
    known = {name: F.coalesce(tag == name, F.lit(False)) for name in layouts}
    kind, codes, fields = F.lit(UNROUTED), F.array(F.lit("BAD:tag")), []
    for name, layout in layouts.items():
        kind, codes = F.when(known[name], name).otherwise(kind), F.when(known[name], slot_errors(col, layout)).otherwise(codes)
        cut = F.struct(*[slot_value(col, slot).alias(slot.name) for slot in layout])
        fields.append(F.when(known[name], cut).alias(name))
    return df.select("*", kind.alias(RECORD_TYPE), codes.alias(ERRORS), *fields)


def route_once(
    df: DataFrame, col: str, tag: Column, layouts: Mapping[str, Sequence[Slot]], path: str
) -> dict[str, DataFrame]:
    """IN-05 at rest: the file is scanned and parsed once and written by record type below ``path``;
    each relation of the result reads its own partition only. The raw record stays with the
    records that no layout or not all of it fits."""
    tagged = tag_records(df, col, tag, layouts)
    kept = tagged.withColumn(col, F.when(F.size(ERRORS) > 0, F.col(col)))
    routed = write_stage(kept, path, [RECORD_TYPE])
    of = lambda name: routed.where(F.col(RECORD_TYPE) == name)
    out = {name: of(name).select(col, f"{name}.*", ERRORS) for name in layouts}
    return out | {UNROUTED: of(UNROUTED).select(col, ERRORS)}


def flatten_record(
    df: DataFrame, col: str, schema: StructType | str, each: str | None = None
) -> DataFrame:
    """IN-06. Parse a nested JSON record and flatten it: struct fields become columns and,
    with ``each``, that array field becomes one row per element (a row with an empty array
    is kept). Records read by ``format('xml')`` arrive as structs and skip the parse; what the scan put
    in ``_corrupt`` (IN-02) marks those that did not fit. A record that is absent or does not parse
    leaves an error code in ``errors``."""
    parsed = df.schema[col].dataType
    wrong = F.when(F.col(col).isNull(), F.lit(f"MISSING:{col}"))
    record = F.col(col)
    if not isinstance(parsed, StructType):
        wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        wanted = StructType([*wanted.fields, StructField(CORRUPT_RECORD, StringType())])
        record = F.from_json(record, wanted, {"columnNameOfCorruptRecord": CORRUPT_RECORD})
        wrong = wrong.when(F.col(f"_record.{CORRUPT_RECORD}").isNotNull(), F.lit(f"BAD:{col}"))
    elif CORRUPT in df.columns:
        wrong = F.when(F.col(CORRUPT).isNotNull(), F.lit(f"BAD:{col}")).otherwise(wrong)
    flat = (
        df.withColumn("_record", record)
        .withColumn(ERRORS, compact([wrong]))
        .select(*df.columns, ERRORS, "_record.*")
        .drop(CORRUPT_RECORD)
    )
    if each is not None:
        flat = flat.withColumn(each, F.explode_outer(each))
        if isinstance(flat.schema[each].dataType, StructType):
            flat = flat.select(*[c for c in flat.columns if c != each], f"{each}.*")
    return flat


def cast_fields(df: DataFrame, schema: StructType) -> DataFrame:
    """IN-07. Cast text fields to the target types. A field that is absent or does not parse
    becomes NULL and leaves an error code; a row never fails the job. Where ``split_line`` found
    more or fewer fields than declared, that is an error of the row too."""
    typed = df.withColumns({f"_v_{f.name}": guarded_cast(F.col(f.name), f.dataType) for f in schema.fields})
    codes = []
    for field in schema.fields:
        text, value = F.col(field.name), F.col(f"_v_{field.name}")
        missing = F.when(text.isNull(), F.lit(f"MISSING:{field.name}"))
        wrong = F.when(text.isNotNull() & value.isNull(), F.lit(f"BAD:{field.name}"))
        codes += [wrong] if field.nullable else [missing, wrong]
    if ARITY_OK in df.columns:
        codes.append(F.when(~F.col(ARITY_OK), F.lit("BAD:arity")))
    kept = [c for c in df.columns if c not in schema.names and c != ARITY_OK]
    # As the one entry of an array a row is parsed once: a condition on errors or values further up
    # does not get below it, where every mention of a field would parse it again.
    row = F.struct(*[F.col(f"_v_{name}").alias(name) for name in schema.names], compact(codes).alias(ERRORS))
    return typed.select(*kept, F.inline(F.array(row)))


@dataclass(frozen=True)
class TextRule:
    """How one text column is normalized."""

    column: str
    upper: bool = True
    null_tokens: tuple[str, ...] = ("", "N/A", "NULL", "NONE")


def normalize_text(df: DataFrame, rules: Sequence[TextRule]) -> DataFrame:
    """IN-08. Trim, collapse blanks, change case, and turn null tokens into NULL."""
    def clean(rule: TextRule) -> Column:
        text = F.trim(F.regexp_replace(F.col(rule.column), r"\s+", " "))
        text = F.upper(text) if rule.upper else text
        return F.when(~F.upper(text).isin(*rule.null_tokens), text)

    return df.withColumns({rule.column: clean(rule) for rule in rules})


def normalize_units(df: DataFrame, units: DataFrame, measure: str, unit: str = "unit") -> DataFrame:
    """IN-09. Bring ``measure`` to the contract's unit by an exact decimal factor. ``units``
    holds ``(unit, to_unit, factor)``. Decimals keep the scale they have, other types get eight
    decimals (the factor nine); the product is exact where the two precisions add up to 37 digits
    at most, and rounded once. An unknown unit gives NULL, not a guess, and so does a value that does
    not fit; both leave an error code in ``errors``, and no row fails the job."""
    def exact(column: Column, kind: DataType, otherwise: str) -> Column:
        return column if isinstance(kind, DecimalType) else column.try_cast(otherwise)

    factor = exact(F.col("factor"), units.schema["factor"].dataType, "decimal(15,9)")
    factors = units.select(F.col("unit").alias(unit), "to_unit", factor.alias("factor"))
    value = exact(F.col(measure), df.schema[measure].dataType, "decimal(22,8)")
    product = F.try_multiply(value, F.col("factor")).try_cast("decimal(18,2)")
    codes = [
        F.when(F.col("to_unit").isNull(), F.lit(f"BAD:{unit}")),
        F.when(
            F.col("to_unit").isNotNull() & F.col(measure).isNotNull() & F.col("_product").isNull(),
            F.lit(f"BAD:{measure}"),
        ),
    ]
    before = F.col(ERRORS) if ERRORS in df.columns else F.array().cast("array<string>")
    return (
        df.join(factors, unit, "left")
        .withColumn("_product", product)
        .withColumn(ERRORS, F.concat(before, compact(codes)))
        .withColumns({measure: F.col("_product"), unit: F.col("to_unit")})
        .drop("to_unit", "factor", "_product")
    )


def dedupe_raw(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """IN-10. Collapse exact repeats. Copies are combined before the shuffle, so a record
    repeated without end reaches the reducer once per map task."""
    return df.dropDuplicates(list(cols or df.columns))


def split_disposition(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IN-11. Accepted and quarantined rows, by whether a row carries error codes."""
    marked = mark_disposition(df)
    return (
        marked.where(F.col(DISPOSITION) == ACCEPTED),
        marked.where(F.col(DISPOSITION) == QUARANTINED),
    )


def mark_disposition(df: DataFrame) -> DataFrame:
    return df.withColumn(
        DISPOSITION, F.when(F.size(ERRORS) == 0, ACCEPTED).otherwise(QUARANTINED)
    )


def record_key(
    df: DataFrame,
    cols: Sequence[str],
    casts: Mapping[str, str] | None = None,
    name: str = "record_key",
) -> DataFrame:
    """IN-12. A key made of the record's own content: md5 over canonical texts."""
    return df.withColumn(name, row_digest(df, cols, casts))
