"""The one-pass gate: every kind against the check it stands for, and one scan per relation."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import contracts, verify
from plumbline.operators.contracts import Contract
from plumbline.plans.registry import QUERIES


def contract(check, kind, frame, other=None, grain=("k",), reads=("k",), unit=None, limits=()):
    return Contract(1, "stage", check, kind, frame, other, grain, reads, unit, None, f"rule-{check}", "REJECT", limits)


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("frames")
    rows = [
        (1, "a", 5.0, "USD", 1), (1, "b", 500.0, "USD", 1), (2, None, 5.0, "CENT", 0), (None, "a|b", None, "USD", 2),
        (None, "a", 3.0, "USD", 3), (4, "z", 4.0, None, 9),
    ]
    after = [(1, "a", 5.0, "USD", 1), (2, None, 6.0, "CENT", 0), (2, None, 6.0, "CENT", 0), (5, "q", 1.0, "USD", 1), (None, "a", 3.0, "USD", 3)]
    schema = "k long, code string, m double, u string, t int"
    made = {
        "rows": spark.createDataFrame(rows, schema), "after": spark.createDataFrame(after, schema),
        "codes": spark.createDataFrame([("a",), ("z",), (None,)], "legal string"),
        "said": spark.createDataFrame(
            [(1, "R1", "NO", {"x": "1"}), (2, "R1", "YES", {"x": "1"}), (3, None, "NO", {}), (4, "R2", "YES", {}), (5, "R1", "NO", {})],
            "k long, rule_id string, disposition string, evidence map<string,string>"),
        "rules": spark.createDataFrame([("R1", "NO", ["x"]), ("R2", "YES", [])], "rule_id string, disposition string, reads array<string>"),
        "other": spark.createDataFrame([], "k int, code string, extra string"),
    }
    for name, df in made.items():
        df.coalesce(1).write.parquet(str(root / name))
        made[name] = spark.read.schema(df.schema).parquet(str(root / name))
    return made


def some():
    return [
        contract("grain", "grain", "rows"), contract("grain_after", "grain", "after"),
        contract("domain", "domain", "rows", "codes", reads=("code", "legal")),
        contract("fk", "fk", "rows", "codes", reads=("code", "legal")),
        contract("cause", "cause", "rows", reads=("t", "k")),
        contract("unit", "unit", "rows", reads=("m", "u", "t"), unit="USD", limits=(0.0, 10.0)),
        contract("proof", "provenance", "said", "rules", reads=("rule_id", "disposition", "evidence")),
        contract("keys", "keys", "rows", "after"), contract("fanout", "fanout", "rows", "after"),
        contract("measure", "measure", "rows", "after", reads=("m",)),
        contract("rows", "rows", "rows", "after+codes", (), ()), contract("equal", "equal", "rows", "after"),
        contract("schema", "schema", "rows", "other"),
    ]


def test_every_kind_counts_what_its_check_finds(spark, frames):
    rows, after, codes = frames["rows"], frames["after"], frames["codes"]
    want = {
        "grain": verify.check_grain(rows, ["k"]).count(), "grain_after": verify.check_grain(after, ["k"]).count(),
        "domain": verify.check_domain(rows, "code", codes, "legal").count(),
        "fk": verify.check_fk(rows, codes, "code", "legal").count(),
        "cause": verify.check_cause(rows, "t", "k").count(),
        "unit": verify.check_unit(rows, "m", "u", "USD", F.col("t"), 0.0, 10.0).count(),
        "proof": verify.check_provenance(frames["said"], frames["rules"]).count(),
        "keys": verify.edge_keys(rows, after, ["k"]).count(), "fanout": verify.edge_fanout(rows, after, ["k"]).count(),
        "measure": verify.edge_measure(rows, after, ["k"], "m").count(),
        "rows": abs(rows.count() - after.count() - codes.count()), "equal": verify.edge_equal(rows, after).count(),
        "schema": verify.check_schema(rows, frames["other"].schema).count(),
    }
    assert all(n > 0 for n in want.values()), want
    got = {r.check: r for r in contracts.contract_gate(contracts.contracts_relation(spark, some()), frames).collect()}
    assert {c: r.violations for c, r in got.items()} == want
    assert not any(r.passed for r in got.values()) and {r.disposition for r in got.values()} == {"REJECT"}
    assert got["cause"].sample_key == "1" or got["cause"].sample_key is not None


def test_each_relation_is_scanned_once(spark, frames):
    rows = [c for c in some() if c.kind not in ("provenance", "schema")]
    gate = contracts.Gate(frames)
    for no, c in enumerate(rows):
        gate.add(no, c)
    plan = gate.violations()._jdf.queryExecution().optimizedPlan().toString()
    scans = re.findall(r"Relation \[([^\]]*)\] parquet", plan)
    assert len(scans) == 3 and plan.count("Aggregate") == 1
    # Columns that no contract reads are not scanned.
    assert sorted("legal" in s for s in scans) == [False, False, True]


def test_entries_stay_in_generated_code_and_unused_amounts_are_not_summed(spark, frames):
    def plan(kinds):
        gate = contracts.Gate(frames)
        for no, c in enumerate(c for c in some() if c.kind in kinds):
            gate.add(no, c)
        return gate.violations()._jdf.queryExecution().optimizedPlan().toString()

    told = plan(["grain", "domain", "fk", "cause", "keys", "fanout"])
    assert "lambda" not in told and "sum(" not in told
    assert "lambda" not in plan(["measure"]) and "sum(" in plan(["measure"])


def test_the_gate_builds_the_history_once(spark, sf):
    plan = QUERIES["vf_13"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "max_by" not in plan


def test_a_clean_run_passes_and_an_unknown_kind_is_refused(spark, frames):
    told = contracts.contracts_relation(spark, [contract("same", "equal", "rows", "rows"), contract("kept", "keys", "rows", "rows")])
    got = contracts.contract_gate(told, frames).collect()
    assert [(r.violations, r.passed, r.sample_key, r.disposition) for r in got] == [(0, True, None, "NONE")] * 2
    assert contracts.contract_gate(told.limit(0), frames).count() == 0
    with pytest.raises(ValueError):
        contracts.contract_gate(contracts.contracts_relation(spark, [contract("x", "odd", "rows")]), frames)
