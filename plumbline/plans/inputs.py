"""Raw and dirty inputs, derived by Spark from the whole given tables.

Each derivation keeps every row of its table; a predicate on the row's own values says which
rows carry the defect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.timeline import Timeline
from plumbline.functions.values import open_end
from plumbline.operators.ingest import Slot
from plumbline.sources.tables import table

ORDER_FIELDS = ["order_key", "cust_key", "status", "price", "order_date"]
ORDER_SCHEMA = T.StructType(
    [
        T.StructField("order_key", T.LongType(), False),
        T.StructField("cust_key", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("price", T.DecimalType(18, 2), False),
        T.StructField("order_date", T.DateType(), False),
    ]
)


def order_raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as delimited lines. Pending low-priority orders carry a bad date; filled orders
    without a priority lose their last field."""
    bad_date = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    short = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "4-NOT SPECIFIED")
    date = F.when(bad_date, "31/12/1999").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    head = F.concat_ws(
        "|", "o_orderkey", "o_custkey", "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
    )
    return table(spark, sf, "orders").select(
        F.when(short, head).otherwise(F.concat_ws("|", head, date)).alias("line")
    )


# The fixed-width layouts by record type.
LAYOUTS = {
    "CUS": [
        Slot("key", 4, 12, T.LongType()),
        Slot("name", 16, 30, T.StringType()),
        Slot("amount", 46, 14, T.DecimalType(18, 2)),
    ],
    "SUP": [
        Slot("key", 4, 12, T.LongType()),
        Slot("name", 16, 30, T.StringType()),
        Slot("amount", 46, 14, T.DecimalType(18, 2)),
    ],
    "PRT": [Slot("key", 4, 12, T.LongType()), Slot("name", 16, 30, T.StringType())],
}


def mixed_records(spark: SparkSession, sf: str, faulty: bool = False) -> DataFrame:
    """Customers, suppliers and parts as fixed-width lines of one mixed file. With ``faulty``,
    overdrawn suppliers have a tag that nobody declared, large parts none, and overdrawn customers
    no number for an amount."""
    def line(df: DataFrame, tag: Column, key: str, name: str, amount: Column | None) -> DataFrame:
        parts = [tag, F.lpad(F.col(key).cast("string"), 12, " "), F.rpad(name, 30, " ")]
        if amount is not None:
            parts.append(F.lpad(amount, 14, " "))
        return df.select(F.concat(*parts).alias("line"))

    def named(tag: str, condition: Column, otherwise: str) -> Column:
        return F.when(condition & F.lit(faulty), otherwise).otherwise(tag)

    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    owed = F.when((F.col("c_acctbal") < 0) & F.lit(faulty), "n/a").otherwise(money("c_acctbal"))
    return (
        line(table(spark, sf, "customer"), F.lit("CUS"), "c_custkey", "c_name", owed)
        .unionByName(
            line(table(spark, sf, "supplier"), named("SUP", F.col("s_acctbal") < 0, "SPX"), "s_suppkey", "s_name", money("s_acctbal"))
        )
        .unionByName(line(table(spark, sf, "part"), named("PRT", F.col("p_size") > 45, "   "), "p_partkey", "p_name", None))
    )


def nested_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as nested JSON actions with two payload items each; those of signups are cut off."""
    record = F.concat(
        F.lit('{"action":"'), "event_type", F.lit('","items":['), "props",
        F.lit(',{"k":'), F.col("user_id").cast("string"), F.lit("}]}"),
    )
    cut = F.col("event_type") == "signup"
    return table(spark, sf, "events").select(
        "event_id", F.when(cut, F.substring(record, 1, 20)).otherwise(record).alias("record")
    )


ACTION_SCHEMA = "_id bigint, body struct<action: string, items: array<struct<k: bigint>>>"


def xml_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as nested XML actions, ready for an XML writer; one item of an error is no number."""
    bad = F.when(F.col("event_type") == "error", "none").otherwise(F.col("user_id").cast("string"))
    items = F.array(F.struct(F.get_json_object("props", "$.k").alias("k")), F.struct(bad.alias("k")))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("_id"), F.struct(F.col("event_type").alias("action"), items.alias("items")).alias("body")
    )


def dirty_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Market segments in lower case with stray blanks; ``n/a`` on overdrawn accounts."""
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, " n/a ")
        .otherwise(F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit("\t")))
        .alias("segment"),
    )


def faulty_history(spark: SparkSession, sf: str) -> DataFrame:
    """A history built carelessly: same-day orders are not collapsed, versions of pending
    orders end ten days late and those of open orders five days early."""
    log = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    after = F.col("_after.o_orderdate")
    shifted = (
        F.when(F.col("o_orderstatus") == "P", after + F.expr("interval 10 days"))
        .when(F.col("o_orderstatus") == "O", after - F.expr("interval 5 days"))
        .otherwise(after)
    )
    return (
        Timeline(log, ["o_custkey"], ["o_orderdate", "o_orderkey"])
        .next(["o_orderdate"], "_after")
        .rows()
        .select(
            "o_custkey",
            F.col("o_orderdate").alias("valid_from"),
            F.coalesce(shifted, open_end()).alias("valid_to"),
            F.col("_after").isNull().alias("is_current"),
        )
    )


def end_events(spark: SparkSession, sf: str) -> DataFrame:
    """Overdrawn customers end with their last order."""
    overdrawn = table(spark, sf, "customer").where(F.col("c_acctbal") < 0)
    return (
        table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(F.max("o_orderdate").alias("end_ts"))
        .join(overdrawn, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    )
