"""Every registered query against its check SQL, and the shape of its plan."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry_module
from plumbline.plans.registry import ORACLE, QUERIES
from tests.compare import difference

# The operator inventory: count per family.
FAMILIES = {
    "in": 13, "rf": 7, "ih": 14, "ec": 9, "wm": 6, "df": 7, "mt": 4, "vf": 13, "gv": 13,
}


def test_every_operator_is_registered():
    ids = {f"{f}_{i:02d}" for f, n in FAMILIES.items() for i in range(1, n + 1)}
    assert set(QUERIES) == ids | {"flagship", "gv_05_replay", "gv_09_recorded", "vf_13_kinds", "raw_run", "ec_01_indexed"}
    assert set(QUERIES) == set(ORACLE)
    assert len(ids) == 86


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLE[name]) is None


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_python_and_no_cross_product(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert banned not in text, banned


def test_scan_reads_only_what_is_used(spark, sf):
    text = plan(QUERIES["ih_12"](spark, sf))
    assert "o_totalprice" not in text and "o_orderstatus" not in text
    text = plan(QUERIES["ec_02"](spark, sf))
    assert "o_totalprice" not in text


def test_topk_is_cut_before_the_shuffle(spark, sf):
    text = plan(QUERIES["mt_04"](spark, sf))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_entry(spark):
    assert len(entry_module.entry(spark).collect()) == 130
    assert set(entry_module.queries()) >= set(QUERIES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["df_03", "ec_01_indexed", "ih_10", "ih_11"])
def test_lines_are_shuffled_under_short_keys(spark, sf, name):
    assert "unhex(md5(" in plan(QUERIES[name](spark, sf))
