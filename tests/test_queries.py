"""Each query with SQL gives the rows that DuckDB gives, over the smallest tables."""

import importlib
import math
import os
import sys

import pytest

DATA = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
catalogue = importlib.import_module("sieveline.plans.catalogue")


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, tables, name):
    got = catalogue.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = tables.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert plain(got.select(columns).collect()) == plain(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows(spark, tables, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["label_relevance"])
def test_every_vector_is_a_query(spark, name):
    ids = {r["vec_id"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    assert {r["qid"] for r in catalogue.queries()[name](spark, DATA).select("qid").distinct().collect()} == ids


def test_entry(spark):
    import __spark_entry__

    assert set(catalogue.oracle_sql()) <= set(__spark_entry__.oracle_sql()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["qid", "doc_id", "bm25_score", "bm25_rank"]


def test_entry_without_the_training_data_queries(spark, tmp_path):
    """With llm and the pipeline gone, the entry still imports and has the others."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/sieveline", tmp_path / "sieveline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert int(out.stdout) == len(catalogue.queries())


def test_an_evaluation_searches_once(spark, monkeypatch):
    calls, real = [], catalogue.search.bm25_documents
    monkeypatch.setattr(catalogue.search, "bm25_documents", lambda *a, **k: calls.append(a) or real(*a, **k))
    catalogue.queries()["eval_hit_rate_mrr"](spark, DATA)
    assert len(calls) == 1


def test_scores_of_documents_do_not_move(spark):
    plan = catalogue.queries()["bm25_scores"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan and "hashpartitioning(term" not in plan
