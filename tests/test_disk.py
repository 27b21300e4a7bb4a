"""What the large runs write and shuffle: lines once, keys as 16 bytes, nothing for edges that agree."""

from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import contracts, govern, history, intervals, stages, verify
from plumbline.operators.contracts import Contract
from plumbline.plans import arms, raw_run
from plumbline.plans import stages as worked
from plumbline.plans.registry import ORACLE, QUERIES
from plumbline.sources.tables import table
from tests.compare import difference
from tests.test_contracts import contract, frames, some  # noqa: F401
from tests.test_queries import plan


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_the_raw_run_stores_short_keys_and_a_line_once_a_stage(spark, sf, tmp_path):
    raw_run.raw_run(spark, sf, str(tmp_path / "run")).collect()
    stored = {p.parent.name + "/" + p.name: spark.read.parquet(str(p)) for p in (tmp_path / "run").glob("[0-9]*/*")}
    keys = {name: df.schema["record_key"].dataType.simpleString() for name, df in stored.items() if "record_key" in df.columns}
    assert keys == dict.fromkeys(["1-parse/lines", "3-identity/located", "4-classify/judged", "6-facts/facts"], "binary")
    assert stored["3-identity/located"].count() == stored["1-parse/lines"].count()
    assert all(f.name.endswith(".gz") for f in (tmp_path / "run/raw/lines").glob("part-*"))
    shown = spark.read.parquet(str(tmp_path / "run/gates")).where("check = 'orphans'").first()["sample_key"]
    assert len(shown) == 32 and stored["1-parse/lines"].where(F.hex("record_key") == shown.upper()).count() > 0


def test_versions_come_with_the_order_and_lines_are_shuffled_once(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    orders = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(F.col("o_custkey")))
    hist = history.build_history(orders, ["o_custkey"], "o_orderdate", "o_orderkey", ["o_orderpriority"])
    own = orders.where("o_orderkey % 11 > 0").select("o_orderkey", "o_custkey")
    lines = lines.select("l_orderkey", "l_linenumber", "l_shipdate")
    on = F.col("l_orderkey") == F.col("o_orderkey")
    want = bag(intervals.asof(lines.join(own, on, "left"), hist, ["o_custkey"], "l_shipdate"))
    for listed in (0, 8, 10_000):
        got = intervals.asof_through(lines, own, on, hist, ["o_custkey"], "l_shipdate", "left", listed=listed, dense=50)
        assert bag(got) == want
    # Overlapping versions repeat a fact.
    twice = hist.unionByName(hist)
    got = intervals.asof_through(lines, own, on, twice, ["o_custkey"], "l_shipdate", listed=10_000)
    assert bag(got) == bag(intervals.asof(lines.join(own, on), twice, ["o_custkey"], "l_shipdate").select(*got.columns))
    # Lines meet their orders and nothing after that.
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert sum("l_orderkey" in line for line in joins) == 1 and not any("l_shipdate" in line for line in joins)


def run_gate(spark, told, frames, first):  # noqa: F811
    got = contracts.contract_gate(contracts.contracts_relation(spark, told), frames, sums_first=first)
    return {r.check: (r.violations, r.sample_key) for r in got.collect()}


def test_sums_first_finds_what_the_gate_finds(spark, frames):  # noqa: F811
    assert run_gate(spark, some(), frames, True) == run_gate(spark, some(), frames, False)


@pytest.mark.parametrize("kind", ["keys", "fanout"])
def test_edges_that_agree_leave_no_entries(spark, sf, kind):
    lines = table(spark, sf, "lineitem").select(F.md5(F.col("l_orderkey").cast("string")).alias("k"))
    short = lines.select(F.unhex("k").alias("k"))
    less = short.where(F.hex("k") != short.agg(F.hex(F.min("k"))).first()[0])
    told = contract("edge", kind, "a", "b")
    for other, left in ((short, False), (less if kind == "keys" else short.unionByName(short.limit(1)), True)):
        frames_ = {"a": lines, "b": other}
        gate = contracts.Gate(frames_)
        gate.add(0, told)
        gate.compare_sums()
        assert bool(gate.entries) == left
        full, first = run_gate(spark, [told], frames_, False), run_gate(spark, [told], frames_, True)
        assert full == first and full["edge"][0] == int(left)
        assert not left or len(full["edge"][1]) == 32


def test_gate_keys_that_are_digests_travel_as_16_bytes(spark):
    keys = spark.createDataFrame([("0" * 32,), ("f" * 31,), (None,), ("F" * 32,)], "k string")
    both = keys.select(*[part.alias(name) for part, name in zip(contracts.key_parts(keys, ["k"]), ("short", "text"))])
    assert [(r.short is None, r.text) for r in both.collect()] == [(False, None), (True, "f" * 31), (True, "\\N"), (True, "F" * 32)]
    made = Contract(1, "stage", "same", "equal", "a", "a", ("k",), ("k",), None, None, "X", "REVIEW")
    gate = contracts.Gate({"a": keys})
    gate.add(0, made)
    assert "concat_ws" not in plan(gate.violations())


def test_arms_read_lone_lines_where_they_are(spark, sf, monkeypatch):
    """gv_12: only lines that share a key or have two versions are grouped by it, lines are shuffled to their
    orders alone, and the counterexamples come from the stored run."""
    stored, handed = {}, []
    real_store, real_surplus = arms.store, arms.surplus_divergence
    monkeypatch.setattr(arms, "store", lambda df, name: stored.setdefault(name, real_store(df, name)))
    monkeypatch.setattr(arms, "surplus_divergence", lambda rows, key: handed.append(rows) or real_surplus(rows, key))
    monkeypatch.setattr(arms, "order_lines", None)
    arms.findings(spark, sf)
    assert {"copies", "two_versions", "regions"} <= set(stored["runs"].columns)
    assert {r.run for r in handed[0].select("run").distinct().collect()} <= {"F3", "F4"}


def test_arms_of_lines_that_share_their_key(spark, sf, tmp_path):
    """Every seventh line is there twice and every fifth customer, so keys and groups repeat."""
    for name in ("orders", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    for name, some_rows in (("lineitem", "(l_orderkey + l_linenumber) % 7 = 0"), ("customer", "c_custkey % 5 = 0")):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        df.unionByName(df.where(some_rows)).toPandas().to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    other = duckdb.connect()
    for name in ("orders", "nation", "region", "lineitem", "customer"):
        other.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    got = QUERIES["gv_06"](spark, str(tmp_path))
    assert difference(got, other, ORACLE["gv_06"].replace("AS sk FROM customer)", "AS sk FROM (SELECT DISTINCT c_custkey FROM customer))")) is None
    sql = ORACLE["gv_12"].replace("AS sk FROM customer)", "AS sk FROM (SELECT DISTINCT c_custkey FROM customer))")
    assert difference(QUERIES["gv_12"](spark, str(tmp_path)), other, sql) is None


def test_replayed_stages_meet_what_is_stored_in_the_row(spark, sf, monkeypatch):
    """gv_05_replay: of the stages only identity and metrics hand rows on to be gathered by key, and neither
    stage 5 nor 6 joins lines again."""
    handed, runs = [], {n: 0 for n in range(1, 8)}
    real = stages.surplus_divergence
    monkeypatch.setattr(stages, "surplus_divergence", lambda rows, key: handed.append(rows) or real(rows, key))
    reviewed = worked.pipeline_stages(spark, sf, paired=True)
    run = stages.run_stages(worked.source(spark, sf, paired=True), reviewed, worked.KEPT)

    def counted(stage):
        def go(df):
            runs[stage.number] += 1
            return stage.run(df)
        return replace(stage, run=go)

    wrong = [counted(s) for s in worked.pipeline_stages(spark, sf, worked.ALL, paired=True)]
    got = stages.own_divergence(wrong, reviewed, run)
    assert got.count() == got.distinct().count() == QUERIES["gv_05_replay"](spark, sf).count()
    assert runs == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: 0, 7: 1}
    assert {r.stage_ord for r in handed[0].select("stage_ord").distinct().collect()} == {3, 7}
    # A stage tells of its rows what running it does.
    for n in (5, 6):
        rows = wrong[n - 1].run(run.outputs[n - 1])
        times = run.outputs[n].select(wrong[n - 1].times.alias("n"))
        assert rows.count() == times.agg(F.sum("n")).first()[0] != run.outputs[n].count()


@pytest.mark.parametrize("times", ["1", "2", "v % 3"])
def test_rows_of_one_key_that_a_fault_repeats_or_drops(spark, times):
    rows = [("a", 1), ("b", 2), ("b", 2), ("c", 3), ("d", 4), ("d", 6), ("e", 5)]
    source = spark.createDataFrame(rows, "record_key string, v long")
    add = lambda df: df.withColumn("w", F.col("v") * 2)
    again = lambda df: add(df).withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.expr(f"int({times})")))).drop("_n")
    good = [stages.Stage(1, "add", add, ("w",), adds=True)]
    run = stages.run_stages(source, good)
    plain = stages.own_divergence([stages.Stage(1, "again", again, ("w",))], good, run)
    told = stages.own_divergence([stages.Stage(1, "again", again, ("w",), times=F.expr(f"bigint({times})"))], good, run)
    assert bag(told) == bag(plain)


def test_relations_that_agree_are_counted_without_a_shuffle_of_rows(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    other = lines.repartition(3)
    assert govern.differing_buckets(lines, {"same": other}) == (6000, {})
    same = govern.count_differences(lines, {"same": other})
    assert tuple(same.first()) == (6000, 0) and "parquet" not in plan(same).lower()
    # One row more and one less are in two buckets at most, and only those are opened.
    row = lines.orderBy("l_orderkey", "l_linenumber", "l_tax").limit(1)
    changed = lines.exceptAll(row).unionByName(row.withColumn("l_tax", F.lit(7.0)))
    rows, buckets = govern.differing_buckets(lines, {"same": other, "changed": changed, "twice": lines.unionByName(lines)})
    assert rows == 6000 and set(buckets) == {"changed", "twice"} and 1 <= len(buckets["changed"]) <= 2
    got = govern.count_differences(lines, {"changed": changed, "same": other, "twice": lines.unionByName(lines)})
    assert tuple(got.first()) == (6000, 2, 0, lines.distinct().count())


def test_the_faulty_gate_joins_short_keys_and_counts_failing_rows_where_they_are(spark, sf, frames):  # noqa: F811
    text = QUERIES["vf_13_kinds"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # Three relations of lines are joined, and none under 32 letters.
    assert text.count("unhex(md5(") >= 3 and "Project [md5(" not in text
    alone = [contract("proof", "provenance", "said", "rules", reads=("rule_id", "disposition", "evidence"))]
    gate = contracts.Gate(frames)
    gate.add(0, alone[0])
    keyed = gate.violations()._jdf.queryExecution().optimizedPlan().toString()
    gate.set_apart(every=False)
    assert "Aggregate [slot" in keyed and not gate.entries
    assert "Aggregate [slot" not in gate.violations()._jdf.queryExecution().optimizedPlan().toString()
    assert run_gate(spark, alone, frames, False) == {"proof": (3, "2")}


def test_equal_rows_are_told_within_their_key(spark):
    rows = spark.range(50).select(F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 5).alias("v"))
    other = rows.withColumn("v", F.when(F.col("v") == 3, 4).otherwise(F.col("v")))
    for key in (("k",), ("v",)):
        told = contract("same", "equal", "a", "b", grain=key)
        violations = run_gate(spark, [told], {"a": rows, "b": other}, False)["same"][0]
        assert violations == verify.edge_equal(rows, other).count() == 20
