"""Cases the given tables do not hold: NULL keys, malformed records, overlaps, missing periods."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plumbline.operators import contracts, facts, govern, history, ingest, intervals, metrics, verify
from plumbline.sources import shared

LOG = dict(key=["k"], ts="at", tie="seq", attrs=["v"])


def log(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, at timestamp_ntz, seq long, v string")


def at(day):
    return dt.datetime(2020, 1, day)


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_member_keeps_its_number(spark):
    first = spark.createDataFrame([(1,), (None,)], "k long")
    dim = history.assign_sk(first, ["k"])
    again = history.extend_sk(history.extend_sk(dim, first, ["k"]), first, ["k"])
    assert bag(again) == bag(dim)


@pytest.mark.parametrize("apply", [history.apply_history, history.backdate])
def test_changes_of_a_null_key_are_applied(spark, apply):
    old = log(spark, (None, at(1), 1, "a"), (1, at(1), 2, "x"))
    new = log(spark, (None, at(2), 3, "b"), (2, at(2), 4, "y"))
    got = apply(history.build_history(old, **LOG), old, new, **LOG)
    assert bag(got) == bag(history.build_history(old.union(new), **LOG)) and got.count() == 4


def test_upsert_replaces_a_null_key(spark):
    dim = spark.createDataFrame([(None, "a"), (1, "x"), (2, None)], "k long, v string")
    batch = spark.createDataFrame([(None, "b"), (3, "z")], "k long, v string")
    assert bag(history.upsert(dim, batch, ["k"])) == [(1, "x"), (2, None), (3, "z"), (None, "b")]


def test_revalidate_recomputes_a_null_key(spark):
    source = spark.createDataFrame([(None, 9), (1, 5)], "k long, v long")
    stored = spark.createDataFrame([(None, 1), (1, 5)], "k long, v long")
    keys = source.where("k is null").select("k")
    assert bag(govern.revalidate(lambda s: s, source, stored, keys, ["k"])) == [(1, 5), (None, 9)]


def test_equal_sides_with_nulls_hold_every_edge(spark):
    a = spark.createDataFrame([(None, 1), (1, None), (1, 2)], "k long, m long")
    assert verify.edge_measure(a, a, ["k"], "m").count() == 0
    assert verify.edge_keys(a, a, ["k"]).count() == 0
    assert verify.edge_equal(a, a).count() == 0
    twice = a.union(a.where("k is null"))
    assert bag(verify.edge_fanout(a, twice, ["k"])) == [(None, 1, 2)]
    assert bag(verify.edge_equal(a, twice)) == [(None, 1, "RIGHT", 1)]
    assert bag(verify.edge_keys(a, a.where("k is not null"), ["k"])) == [(None, "LOST")]


def test_lost_rows_are_counted(spark):
    rows = spark.range(10)
    counts = verify.edge_rows(rows, rows.where("id < 6"), rows.where("id > 7")).first()
    assert tuple(counts) == (10, 6, 2, 2)


def test_overlapping_versions_give_the_same_rows_on_both_paths(spark):
    versions = [(1, at(1), at(20), "long"), (1, at(5), at(9), "inner")]
    versions += [(1, at(20 + i), at(21 + i), f"v{i}") for i in range(5)]
    versions += [(2, at(1 + i), at(2 + i), f"w{i}") for i in range(8)]
    hist = spark.createDataFrame(versions, "k long, valid_from timestamp_ntz, valid_to timestamp_ntz, v string")
    fact = spark.createDataFrame([(1, at(6)), (1, at(12)), (2, at(3)), (1, at(22)), (None, at(3)), (3, at(3))], "k long, ts timestamp_ntz")
    plain = bag(intervals.asof(fact, hist, ["k"], "ts", dense=None))
    assert plain == bag(intervals.asof(fact, hist, ["k"], "ts", dense=3)) and len(plain) == 7


def test_orders_without_lines_stay(spark):
    orders = spark.createDataFrame([(1, at(1)), (2, at(1))], "o_orderkey long, o_orderdate timestamp_ntz")
    lines = spark.createDataFrame([(1, at(3))], "l_orderkey long, l_shipdate timestamp_ntz")
    got = {r.o_orderkey: (r.n_lines, r.lag_days) for r in facts.fact_lifecycle(orders, lines).collect()}
    assert got == {1: (1, 2), 2: (0, None)}


def test_trailing_extremes_of_a_null_key(spark):
    rows = spark.createDataFrame([(None, at(1), 5.0), (None, at(2), 1.0), (1, at(1), 2.0)], "k string, ts timestamp_ntz, v double")
    got = facts.fact_trailing(rows, "k", "ts", "v", 7 * 86400, 7)
    assert {(r.k, r.v): (r.trailing_high, r.trailing_low) for r in got.collect()} == {
        (None, 5.0): (5.0, 5.0), (None, 1.0): (5.0, 1.0), ("1", 2.0): (2.0, 2.0),
    }


def test_a_missing_period_has_no_change(spark):
    rows = spark.createDataFrame([("g", 1, 10), ("g", 3, 30), ("g", 4, 50)], "g string, p long, v long")
    got = metrics.metric_change(rows, ["g"], "p", "v", F.col("p") - 1)
    assert {r.p: r.change for r in got.collect()} == {1: None, 3: None, 4: 20}


SCHEMA = StructType([StructField("a", LongType(), False), StructField("b", StringType())])


def test_extra_and_missing_fields_are_quarantined(spark):
    lines = spark.createDataFrame([("1|x",), ("1|x|y",), ("1",), ("z|x",)], "line string")
    parsed = ingest.cast_fields(ingest.split_line(lines, "line", "|", ["a", "b"]), SCHEMA)
    good, bad = ingest.split_disposition(parsed)
    assert [r.line for r in good.collect()] == ["1|x"]
    assert {r.line: r.errors for r in bad.collect()} == {
        "1|x|y": ["BAD:arity"], "1": ["BAD:arity"], "z|x": ["BAD:a"],
    }


def test_fixed_width_errors_and_unrouted_records(spark):
    layout = [ingest.Slot("n", 4, 4, LongType())]
    lines = spark.createDataFrame([("CUSx2y4",), ("CUS  42",), ("CUS    ",), ("XXX   1",), (None,)], "line string")
    routed = ingest.route_records(lines, "line", F.substring("line", 1, 3), {"CUS": layout})
    assert {r.line: (r.n, r.errors) for r in routed["CUS"].collect()} == {
        "CUSx2y4": (None, ["BAD:n"]), "CUS  42": (42, []), "CUS    ": (None, []),
    }
    assert bag(routed[ingest.UNROUTED].select("line")) == [("XXX   1",), (None,)]


def test_single_pass_routing_prunes_and_keeps_what_does_not_fit(spark, tmp_path):
    layouts = {"CUS": [ingest.Slot("n", 4, 4, LongType())], "SUP": [ingest.Slot("m", 4, 2, LongType())]}
    lines = spark.createDataFrame([("CUSx2y4",), ("CUS  42",), ("SUP 7",), ("XXX   1",), (None,)], "line string")
    routed = ingest.route_once(lines, "line", F.substring("line", 1, 3), layouts, str(tmp_path / "routed"))
    assert bag(routed["CUS"].select("line", "n", F.concat_ws(",", "errors"))) == [("CUSx2y4", None, "BAD:n"), (None, 42, "")]
    assert bag(routed["SUP"].select("line", "m")) == [(None, 7)]
    assert bag(routed[ingest.UNROUTED].select("line", F.concat_ws(",", "errors"))) == [("XXX   1", "BAD:tag"), (None, "BAD:tag")]
    plan = routed["CUS"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(record_type" in plan and "SUP" not in plan
    tagged = ingest.tag_records(lines, "line", F.substring("line", 1, 3), layouts)
    assert tagged._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1


def test_units_of_any_size_do_not_fail_the_job(spark):
    units = spark.createDataFrame(
        [("USD", "USD", Decimal(1)), ("N", "USD", Decimal("0.000000001")), ("M", "USD", Decimal(10**6))], "unit string, to_unit string, factor decimal(18,10)"
    )
    rows = [("USD", Decimal(2 * 10**14)), ("N", Decimal(10**9)), ("M", Decimal(10**15)), ("?", Decimal(1)), ("N", None)]
    df = spark.createDataFrame(rows, "unit string, m decimal(18,2)")
    got = bag(ingest.normalize_units(df, units, "m").select("m", F.concat_ws(",", "errors")))
    assert got == sorted([(Decimal("200000000000000.00"), ""), (Decimal("1.00"), ""), (None, "BAD:m"), (None, "BAD:unit"), (None, "")], key=repr)


def test_malformed_nested_records_carry_an_error(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("{nope",), (None,)], "r string")
    got = ingest.flatten_record(rows, "r", "a long")
    assert {r.r: (r.a, r.errors) for r in got.collect()} == {
        '{"a": 1}': (1, []), "{nope": (None, ["BAD:r"]), None: (None, ["MISSING:r"]),
    }


def test_digests_tell_doubles_apart(spark):
    values = [1.001, 1.004, float("nan"), None, 1e17, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert ingest.record_key(df, ["v"]).select("record_key").distinct().count() == len(values)


def test_units_are_rounded_once(spark):
    units = spark.createDataFrame([("K", "USD", "1000")], "unit string, to_unit string, factor string")
    rows = spark.createDataFrame([("K", 0.004), ("?", 1.0)], "unit string, m double")
    got = {r.unit: r.m for r in ingest.normalize_units(rows, units, "m").collect()}
    assert float(got["USD"]) == 4.0 and got[None] is None


def test_curated_counterexamples_follow_the_latest_review(spark):
    rows = [(1, "b1", "ACCEPTED", 1), (2, "b2", "ACCEPTED", 2), (3, "b1", "PENDING", 3)]
    cex = spark.createDataFrame([(*r, "same") for r in rows], "cex_id long, boundary_id string, status string, reviewed_at long, record_key string")
    assert [r.cex_id for r in govern.accepted(cex, ["record_key"]).collect()] == [2]


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("k"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(shared.checked_keys(wide))
    assert not hinted(shared.checked_keys(wide, max_bytes=10_000))
    assert not hinted(shared.checked_keys(wide, max_rows=10))


def test_contracts_from_a_relation_name_what_failed(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k long, code string")
    codes = spark.createDataFrame([("a",)], "legal string")
    contract = lambda check, kind, other, grain, reads: contracts.Contract(
        1, "stage", check, kind, "rows", other, grain, reads, "code", None, f"rule-{check}", "QUARANTINE"
    )
    told = contracts.contracts_relation(spark, [
        contract("grain", "grain", None, ("k",), ("k",)),
        contract("domain", "domain", "codes", ("k",), ("code", "legal")),
        contract("same", "keys", "rows", ("k",), ("k",)),
    ])
    got = {r.check: r for r in contracts.contract_gate(told, {"rows": rows, "codes": codes}).collect()}
    assert {c: (r.violations, r.passed, r.disposition) for c, r in got.items()} == {
        "grain": (1, False, "QUARANTINE"), "domain": (2, False, "QUARANTINE"), "same": (0, True, "NONE"),
    }
    assert got["domain"].evidence == "code,legal" and got["domain"].rule_id == "rule-domain"
