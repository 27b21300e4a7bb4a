"""The worked pipeline: raw lines to metrics in seven stages, with or without faults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.timeline import Timeline
from plumbline.functions.values import row_fingerprint
from plumbline.operators.classify import rule_of
from plumbline.operators.govern import CONTROL, RUN, active, inject, row_digests
from plumbline.operators.history import assign_sk, build_history
from plumbline.operators.ingest import record_key
from plumbline.operators.intervals import asof, asof_through
from plumbline.operators.reference import UNKNOWN, decode_hierarchy, lookup
from plumbline.operators.warehouse import resolve_fk
from plumbline.plans.policy import FAULT, LINE_RULES, LINE_RULES_SWAPPED, STATUS, line_policy
from plumbline.sources.tables import LINE_CASTS, LINE_COLUMNS, table


def keyed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their content key, as ``(l_orderkey, l_linenumber)`` repeats."""
    return record_key(table(spark, sf, "lineitem"), LINE_COLUMNS, LINE_CASTS)


def short_keys(df: DataFrame) -> DataFrame:
    """The content key as its 16 bytes instead of 32 letters, for rows that are shuffled on."""
    return df.withColumn("record_key", F.unhex("record_key"))


def long_keys(df: DataFrame) -> DataFrame:
    """``short_keys`` undone."""
    return df.withColumn("record_key", F.lower(F.hex("record_key")))


def order_lines(spark: SparkSession, sf: str, short: bool = False) -> DataFrame:
    """Keyed lines with their order; with ``short`` under ``short_keys``."""
    orders = table(spark, sf, "orders").drop("o_totalprice")
    lines = keyed_lines(spark, sf)
    lines = short_keys(lines) if short else lines
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def repeated_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """``o_orderkey, _repeats``: of an order the line numbers that are there more than once, and how often."""
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 AND l_linenumber IS NOT NULL")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "_n"))).alias("_repeats"))
    )


def customer_history(spark: SparkSession, sf: str) -> DataFrame:
    """Order priority per customer as type-2 history."""
    return build_history(
        table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", ["o_orderpriority"]
    )


def geography(spark: SparkSession, sf: str, df: DataFrame, nation: str, labels) -> DataFrame:
    return decode_hierarchy(
        df,
        [
            (table(spark, sf, "nation"), nation, "n_nationkey"),
            (table(spark, sf, "region"), "n_regionkey", "r_regionkey"),
        ],
        labels,
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The vertical slice: lines joined to orders, customer history as of the ship date,
    rules, geography, and the metric by region, rule and priority.

    Geography is resolved on orders, a quarter of the lines, before the lines join.
    """
    customers = geography(
        spark, sf, table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", ["r_name"]
    ).select(F.col("c_custkey").alias("o_custkey"), "r_name")
    orders = (
        table(spark, sf, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .join(customers, "o_custkey", "left")
    )
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_shipdate",
        "l_discount",
        "l_returnflag",
        "l_linestatus",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
    )
    judged = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("rule_id", rule_of(line_policy(spark)))
        .select("o_custkey", "l_shipdate", "price", "rule_id", "r_name")
    )
    placed = asof(
        judged, customer_history(spark, sf), ["o_custkey"], "l_shipdate",
        counted=table(spark, sf, "orders").select("o_custkey"),
    )
    return placed.groupBy(
        F.coalesce("r_name", F.lit(UNKNOWN)).alias("region"),
        "rule_id",
        F.coalesce("o_orderpriority", F.lit(UNKNOWN)).alias("priority"),
    ).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("price").cast("double").alias("amount"),
    )


# Stage outputs at line grain: the columns each stage answers for.
STAGE_COLUMNS = {
    1: ["price", "quantity", "discount", "l_shipdate"],
    2: ["status_meaning"],
    3: ["customer_key", "priority"],
    4: ["rule_id"],
    5: ["price", "quantity", "discount", "l_shipdate", "status_meaning", "customer_key", "priority", "rule_id"],
    6: ["customer_sk", "priority", "rule_id", "price"],
}


LABEL, SIGN = "label", "sign"


def governed_run(
    spark: SparkSession, sf: str, runs: Sequence[str] = (CONTROL,), signed: bool = False, paired: bool = False,
    short: bool = False,
) -> DataFrame:
    """Stages 1 to 6 for every named run in one plan. A run is a column, so all runs share
    each scan and shuffle, and a fault is a condition on that column. Rows are repeated per run
    after the as-of join, not before it. Lines are shuffled once, to their orders.

    A row is one row of stage 5 and carries the outputs of all stages. ``extra`` marks a
    second version of one line (rows from stage 3 on), ``copy`` numbers the repeats a fan-out
    makes at stage 5, and ``dropped`` marks rows stage 6 loses. ``present`` reads them. ``two_versions`` and
    ``copies`` tell on every row of a line how often its run has it.

    With ``signed`` (for runs of one fault each) the control run is there whole, and of a faulty run
    only the lines that its fault can reach: each once as the fault makes it, with ``sign`` 1, and
    once as the control run has it, with ``sign`` -1. ``label`` names the run that a row is for. What
    a run counts is what the control run counts plus its signed rows.

    With ``paired`` (for one run) a line is there once, as that run has it: what the control run has
    follows from the same row. Only a line that the identity fault looks up under another key is
    there twice, also under the control run. ``line_changes`` and ``line_sums`` read such rows.
    """
    has = set(runs)
    wants = lambda fault: bool(has & {fault, "ALL"})
    lines = short_keys(keyed_lines(spark, sf)) if short else keyed_lines(spark, sf)
    # What a line gets from its order comes with the order: versions and the member of its customer, and how
    # often its number is there. Only the identity fault changes the key of the first two, so only the
    # orders it hits are there twice.
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    if wants("F6"):
        orders = orders.join(repeated_numbers(spark, sf), "o_orderkey", "left")
    moved = FAULT["F3"]
    hit = F.coalesce(F.expr(moved.condition), F.lit(False))
    orders = orders.withColumns({"customer_key": F.col("o_custkey"), "_moved": F.lit(False)})
    if wants("F3"):
        orders = orders.unionByName(
            orders.where(hit).withColumns({"customer_key": F.expr(moved.value), "_moved": F.lit(True)})
        )
    members = assign_sk(table(spark, sf, "customer"), ["c_custkey"])
    orders = resolve_fk(orders, members, "customer_key", "c_custkey", "customer_sk")
    if signed:
        # A customer listed twice has two.
        regions = customer_regions(spark, sf).groupBy("customer_key").agg(F.collect_list("region").alias("regions"))
        orders = orders.join(regions, "customer_key", "left")
    hist = customer_history(spark, sf).select(
        F.col("o_custkey").alias("customer_key"),
        "valid_from",
        "valid_to",
        F.col("o_orderpriority").alias("version"),
    )
    changes = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer_key"), F.col("o_orderdate").alias("valid_from")
    )
    if wants("F4"):
        hist = (
            Timeline(hist, ["customer_key"], ["valid_from"], counted=changes)
            .previous(["version"], "_ended")
            .rows()
            .select("*", F.col("_ended").isNotNull().alias("_ends"), F.col("_ended.version").alias("_before"))
            .drop("_ended")
        )
    known = asof_through(
        lines, orders, F.col("l_orderkey") == F.col("o_orderkey"), hist, ["customer_key"], "l_shipdate", counted=changes
    )
    one_pair = F.lit(1).cast("bigint")
    times = F.coalesce(F.try_element_at("_repeats", F.col("l_linenumber")), one_pair) if wants("F6") else one_pair
    known = known.withColumn("_pairs", times)
    if wants("F4"):
        known = known.withColumn("_ended", F.when(F.col("_ends"), F.struct(F.col("_before").alias("version"))))
    moving = [r for r in runs if r in (moved.fault_id, "ALL")]
    named = lambda some: F.array(*[F.lit(r) for r in some]).cast("array<string>")
    original_hit = F.coalesce(F.expr(moved.condition.replace("customer_key", "o_custkey")), F.lit(False))
    left = named([CONTROL] if paired else [r for r in runs if r not in moving])
    own_runs = (
        F.when(F.col("_moved"), named(moving))
        .when(original_hit if moving else F.lit(False), left)
        .otherwise(named(runs))
    )
    # 1: parsing and normalization
    if signed:
        started = known.withColumn("_run", F.explode(signed_runs(runs, original_hit)))
        started = started.select("*", "_run.*")
    else:
        started = known.withColumn(RUN, F.explode(own_runs))
    one = started.select(
        RUN, *([LABEL, SIGN] if signed else []),
        *(["regions"] if signed else []),
        "customer_key", "customer_sk", "version", "valid_from", *(["_ended"] if wants("F4") else []),
        "record_key", "l_orderkey", "l_linenumber", "_pairs", "l_shipdate", "o_orderdate",
        "l_returnflag", "l_linestatus", "l_discount", "o_orderstatus", "o_custkey",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("raw_price"),
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
        F.col("l_discount").cast("decimal(4,2)").alias("discount"),
    )
    one = inject(one, FAULT["F1"])
    # 2: reference interpretation
    two = inject(one.withColumn("status_meaning", lookup(STATUS, "o_orderstatus")), FAULT["F2"])
    # 3: identity and history
    three = two.withColumns({"extra": F.lit(False), "two_versions": F.lit(False)})
    if wants("F4"):
        # Closed intervals: on the day a version begins, the one it ended matches as well.
        both = active("F4") & F.col("_ended").isNotNull() & (F.col("valid_from") == F.col("l_shipdate"))
        extra = F.when(both, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        three = three.withColumn("two_versions", both).withColumn("extra", F.explode(extra)).withColumn(
            "version", F.when(F.col("extra"), F.col("_ended.version")).otherwise(F.col("version"))
        )
    three = three.withColumn("priority", F.coalesce("version", F.lit(UNKNOWN)))
    # 4: event classification
    rules = rule_of(LINE_RULES)
    if wants("F5"):
        rules = F.when(active("F5"), rule_of(LINE_RULES_SWAPPED)).otherwise(rules)
    four = three.withColumn("rule_id", rules)
    # 5: logical warehouse model
    repeats = F.when(active("F6"), F.col("_pairs")).otherwise(F.lit(1).cast("bigint"))
    four = four.withColumn("copies", repeats)
    five = four.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), repeats))) if (
        wants("F6")
    ) else four.withColumn("copy", F.lit(1).cast("bigint"))
    # 6: dimensions and facts
    return five.withColumn("dropped", active("F7") & (F.col("priority") == UNKNOWN))


def signed_runs(runs: Sequence[str], moved: Column) -> Column:
    """The ``(label, run, sign)`` of a line: the control run, and both sides of every run whose fault
    can reach the line. A line looked up under another key is that fault's alone."""
    reach = {
        "F1": F.expr(FAULT["F1"].condition), "F2": F.expr(FAULT["F2"].condition), "F3": moved,
        "F4": F.col("_ended").isNotNull() & (F.col("valid_from") == F.col("l_shipdate")),
        "F5": rule_of(LINE_RULES) != rule_of(LINE_RULES_SWAPPED), "F6": F.col("_pairs") > 1,
        "F7": F.col("version").isNull(), "F8": F.lit(False),
    }

    def entry(label: str, run: str, sign: int) -> Column:
        return F.struct(F.lit(label).alias(LABEL), F.lit(run).alias(RUN), F.lit(sign).alias(SIGN))

    own = [entry(CONTROL, CONTROL, 1)]
    for fault in (r for r in runs if r != CONTROL):
        hit = F.coalesce(reach[fault], F.lit(False))
        own.append(F.when(hit, entry(fault, CONTROL, -1)))
        if fault != "F3":
            own.append(F.when(hit, entry(fault, fault, 1)))
    return F.when(F.col("_moved"), F.array(entry("F3", "F3", 1))).otherwise(F.array_compact(F.array(*own)))


def present() -> dict[int, Column]:
    """For each stage, whether a row of ``governed_run`` is one of that stage's rows."""
    first_copy = F.col("copy") == 1
    source = first_copy & ~F.col("extra")
    return {1: source, 2: source, 3: first_copy, 4: first_copy, 5: F.lit(True), 6: ~F.col("dropped")}


def line_digests(run: DataFrame) -> DataFrame:
    return row_digests(run, [RUN, "record_key"], STAGE_COLUMNS, present())


def both_sides(run: DataFrame, is_control: Column | None = None) -> tuple[DataFrame, Column, Column, Column]:
    """``run`` with the fingerprints of each stage's outputs as the row has them (``_d<stage>``) and as the
    control run has them (``_c<stage>``); and which rows are the control run's own, which are set against no
    control row, and which stand for a line of the source."""
    control = {
        "price": F.col("raw_price"), "status_meaning": lookup(STATUS, "o_orderstatus"),
        "customer_key": F.col("o_custkey"), "rule_id": rule_of(LINE_RULES),
    }
    wide = run.withColumns({f"_c_{name}": value for name, value in control.items()})
    for stage, columns in STAGE_COLUMNS.items():
        own = [f"_c_{c}" if c in control else c for c in columns]
        wide = wide.withColumns({f"_d{stage}": row_fingerprint(columns), f"_c{stage}": row_fingerprint(own)})
    is_control = F.col(RUN) == CONTROL if is_control is None else is_control
    # A row under another key has its control row apart, and so have repeats of a row.
    alone = is_control | ~F.col("customer_key").eqNullSafe(F.col("o_custkey"))
    return wide, is_control, alone, ~F.col("extra") & (F.col("copy") == 1)


def line_sums(run: DataFrame, rule: Column | None = None, rules: Sequence[str] = ()) -> DataFrame:
    """``record_key, first_stage``: the first stage at which the bags of a key's rows differ, NULL where none
    does; one aggregation of one row per row of a ``paired`` run. A bag is known by the sum of its rows'
    fingerprints, in four parts of 32 bits that cannot overflow: actual rows are added, control rows
    subtracted. ``lines_<n>`` counts the key's lines whose ``rule`` is the n-th of ``rules``."""
    wide, is_control, alone, source = both_sides(run)
    there, nothing, sums, differs = present(), F.lit(0).cast("bigint"), {}, {}

    def part(digest: str, n: int) -> Column:
        half = F.col(f"{digest}.{'ab'[n // 2]}")
        return F.shiftrightunsigned(half, 32) if n % 2 else half.bitwiseAND(F.lit(0xFFFFFFFF))

    for stage in STAGE_COLUMNS:
        for n in range(4):
            own = F.when(~is_control & there[stage], part(f"_d{stage}", n)).otherwise(nothing)
            given = F.when(is_control | (~alone & source), part(f"_c{stage}", n)).otherwise(nothing)
            sums[f"_s{stage}_{n}"] = own - given
        differs[stage] = F.greatest(*[F.col(f"_s{stage}_{n}") != 0 for n in range(4)])
    # Under another key a line is there a second time.
    line = source & (is_control | ~alone)
    counts = {f"lines_{n}": (line & (rule == r)).cast("bigint") for n, r in enumerate(rules)}
    summed = (
        wide.select("record_key", *[c.alias(name) for name, c in (sums | counts).items()])
        .groupBy("record_key").agg(*[F.sum(c).alias(c) for c in sums | counts])
    )
    first = F.coalesce(*[F.when(wrong, F.lit(stage)) for stage, wrong in differs.items()])
    return summed.select("record_key", first.alias("first_stage"), *counts)


def line_changes(run: DataFrame, key: Sequence[str] = ("record_key",), is_control: Column | None = None) -> DataFrame:
    """``key, nth, stage_ord, digest, surplus``: what the rows of a ``paired`` run add to the control run and
    take from it. Where a row and the control run's, which it is set against, have the same outputs
    for a stage, they cancel on the spot, so only what a fault changed is handed on. ``is_control``
    marks the control rows of lines that are looked up under another key. ``nth`` counts what a row hands on."""
    wide, is_control, alone, source = both_sides(run, is_control)
    there = present()

    def entry(stage: int, digest: str, sign: int) -> Column:
        return F.struct(
            F.lit(stage).alias("stage_ord"), F.col(digest).alias("digest"), F.lit(sign).cast("bigint").alias("surplus")
        )

    entries = []
    for stage in STAGE_COLUMNS:
        same = ~alone & source & there[stage] & (F.col(f"_d{stage}") == F.col(f"_c{stage}"))
        entries.append(F.when(~is_control & there[stage] & ~same, entry(stage, f"_d{stage}", 1)))
        entries.append(F.when(is_control | (~alone & source & ~same), entry(stage, f"_c{stage}", -1)))
    changed = wide.select(*key, F.posexplode(F.array_compact(F.array(*entries))).alias("nth", "_e"))
    return changed.select(*key, "nth", "_e.*")


def customer_regions(spark: SparkSession, sf: str) -> DataFrame:
    """``customer_key, region``, a row for each time a customer is listed."""
    return geography(
        spark, sf, table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", ["r_name"]
    ).select(F.col("c_custkey").alias("customer_key"), F.col("r_name").alias("region"))


def metric_sums(facts: DataFrame) -> DataFrame:
    """What stage 7 adds up by run, region, rule and priority, over signed rows with their ``regions``."""
    signed = {"n_lines": F.lit(1), "amount": F.col("price"), "_product": F.col("price") * F.col("discount"), "_rates": F.col("discount")}
    return (
        facts.where(~F.col("dropped"))
        .withColumn("region", F.explode_outer("regions"))
        .groupBy(RUN, F.coalesce("region", F.lit(UNKNOWN)).alias("region"), "rule_id", "priority")
        .agg(*[F.sum(F.when(F.col(SIGN) > 0, v).otherwise(-v)).alias(name) for name, v in signed.items()])
    )


def metrics_of(sums: DataFrame) -> DataFrame:
    """Stage 7: count, amount and price-weighted discount of each group that has lines. Under F8 the
    discount is a plain mean; ``weighted`` is what its contract asks for."""
    weighted = F.try_divide(F.col("_product").cast("double"), F.col("amount").cast("double"))
    mean = F.col("_rates").cast("double") / F.col("n_lines")
    return (
        sums.where(F.col("n_lines") > 0)
        .withColumn("weighted", weighted)
        .withColumn("discount", F.when(active("F8"), mean).otherwise(F.col("weighted")))
        .drop("_product", "_rates")
    )


def metric_digests(metrics: DataFrame) -> DataFrame:
    """Stage 7; its key is the metric group."""
    group = F.concat_ws("|", "region", "rule_id", "priority")
    keyed = metrics.withColumn("record_key", group).withColumn(
        "discount", F.col("discount").cast("decimal(18,9)")
    )
    return row_digests(keyed, [RUN, "record_key"], {7: ["n_lines", "amount", "discount"]})


