"""The registered queries against SQL or plain versions, and the pipeline stage by stage."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from plumbline.llm.queries import ORACLE, QUERIES
from tests.compare import TESTDATA, difference
from tests.llm import brute


@pytest.fixture(scope="module")
def texts(sf):
    con = duckdb.connect()
    for name in "documents embeddings pages labels benchmark".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{TESTDATA}/sf0.001/{name}.parquet')")
    return con


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, texts, name):
    assert difference(QUERIES[name](spark, sf), texts, ORACLE[name]) is None


def test_near_duplicate_query_equals_brute_force(spark, sf, texts):
    docs = texts.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    want = brute.groups(brute.jaccard([t for _, t in docs]) >= 0.8)
    got = {r.doc_id: r.group_id for r in QUERIES["op5_minhash"](spark, sf).collect()}
    assert [got[d] for d, _ in docs] == [docs[g][0] for g in want]


def test_pipeline_stages(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == documents.columns
        kept[name] = before, after = docs.toPandas(), out.toPandas()
        docs = spark.createDataFrame(after, documents.schema)
        if name == "quality":
            assert set(after.doc_id) < set(before.doc_id)
        if name == "line_dedup":
            want = brute.clean_lines(list(before[["doc_id", "text", "source"]].itertuples(index=False)), 10)
            texts = dict(zip(after.doc_id, after.text))
            assert texts == {d: t for d, t in want.items() if d in texts}
            assert all(not want[d].strip() for d in set(want) - set(texts))
            assert (after.n_chars == after.text.str.len()).all()
        if name == "near_dedup":
            ids = before.doc_id.to_numpy()
            order = np.argsort(ids)
            group = brute.groups(brute.jaccard(list(before.text.iloc[order])) >= 0.8)
            assert set(after.doc_id) == {ids[order][g] for g in group}
        if name == "mixing":
            rows = list(before[["doc_id", "text", "source"]].itertuples(index=False))
            begun = {d: -(-t // n) if n else 0 for d, n, _, _, t in brute.taken(rows)}
            assert after.doc_id.value_counts().to_dict() == {d: c for d, c in begun.items() if c}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 4096
    assert set(pieces.doc_id) == set(kept["mixing"][1].doc_id)


def test_whole_pipeline_runs(spark, sf):
    assert entry_module.queries()["pipeline"](spark, sf).count() > 0
