import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.operators import search


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid long, source_ix int, id long, rank int")


def test_rrf_values_ties_and_missing_sources(spark):
    out = search.rrf_fuse(ranked(spark, [(1, 0, 10, 1), (1, 0, 20, 2), (1, 1, 20, 1), (1, 1, 30, 2)]), 2).orderBy("position").collect()
    assert [r["id"] for r in out] == [20, 10, 30]
    assert abs(out[0]["score"] - (1 / 61 + 1 / 62)) < 1e-12 and out[0]["ranks"] == [2, 1] and out[1]["ranks"] == [1, None]
    tie = search.rrf_fuse(ranked(spark, [(1, 0, 7, 1), (1, 1, 3, 1)]), 2).orderBy("position").collect()
    assert [r["id"] for r in tie] == [3, 7]


def test_rrf_refuses_bad_input(spark):
    for rows in ([(1, 0, 5, 1), (1, 0, 5, 2)], [(1, 0, 5, 0)]):
        with pytest.raises(Exception, match="rrf_fuse"):
            search.rrf_fuse(ranked(spark, rows), 1).collect()
    for bad in (0, 1001, 1.5, True):
        with pytest.raises(ValueError):
            search.rrf_fuse(ranked(spark, []), 1, k=bad)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations([(1, 0, 1, 1), (1, 0, 2, 2), (1, 1, 2, 1), (1, 1, 3, 2), (1, 2, 1, 1)]))
def test_rrf_ignores_row_order(spark, rows):
    out = search.rrf_fuse(ranked(spark, rows), 3).orderBy("position").collect()
    assert [r["id"] for r in out] == [1, 2, 3]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog"), (3, "bird fish"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat CAT"), (2, "none"), (3, "")], "qid long, query string")
    out = search.bm25_documents(docs, queries, 10).collect()
    assert [(r["qid"], r["doc_id"], r["bm25_rank"]) for r in out] == [(1, 1, 1)]
    idf = math.log((4 - 1 + 0.5) / 1.5)
    part = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 1.5))
    assert abs(out[0]["bm25_score"] + 2 * part) < 1e-9
    stored = search.bm25_topk(search.postings(docs), search.doc_terms(docs), queries).collect()
    assert [(r["doc_id"], round(r["bm25_score"], 9)) for r in stored] == [(1, round(-2 * part, 9))]


def test_top_k_is_limited_before_the_sort(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a")], "qid long, query string")
    plan = search.bm25_topk(search.postings(docs), search.doc_terms(docs), queries, 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_knn_ties_zero_vectors_and_faults(spark):
    base = spark.createDataFrame([(3, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0])], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 0.0])], "qid long, embedding array<float>")
    for k in (3, None):
        assert [(r["doc_id"], r["vec_rank"]) for r in search.knn_topk(base, q, 2, k).orderBy("vec_rank").collect()] == [(2, 1), (1, 2), (3, 3)]
    assert [r["cosine"] for r in search.cosines(base, q, 2).collect()] == [0, 0, 0]
    with pytest.raises(Exception, match="finite"):
        search.knn_topk(base, q.select("qid", F.array(F.lit(1.0)).alias("embedding")), 2, 1).collect()
    with pytest.raises(ValueError):
        search.knn_topk(base, q, 2, 0)


def test_knn_keeps_all_ties_in_any_blocks(spark):
    """50 equal vectors, the least ids last: any k of them won't do; neither a batch's nor a block's size changes
    anything."""
    rows = [(100 - i, [1.0, 2.0]) for i in range(50)] + [(200 + i, [9.0, float(i)]) for i in range(20)]
    base = spark.createDataFrame(rows, "doc_id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1, [0.1, 0.2]), (2, [1.0, 2.0]), (3, [9.0, 3.2])], "qid long, embedding array<float>")
    want = [(i, d, r) for i, ds in ((1, (51, 52, 53)), (2, (51, 52, 53)), (3, (203, 204, 202))) for r, d in enumerate(ds, 1)]
    for b, block in ((base, 32 << 20), (base.repartition(5), 32 << 20), (base, 16)):
        assert sorted(map(tuple, search.knn_topk(b, q, 2, 3, block).select("qid", "doc_id", "vec_rank").collect()), key=lambda r: (r[0], r[2])) == want
    with pytest.raises(Exception, match="finite"):
        search.knn_topk(base, q.select("qid", F.array(F.lit(1.0), F.lit(None)).alias("embedding")), 2, 1).collect()


def test_mean_cosines_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)] + [(30, 9, [1.0, 0.0, 0.0, 0.0]), (31, 0, [0.0] * 4)]
    got = {r["v"]: r["mean_cosine"] for r in search.mean_cosines(spark.createDataFrame(rows, "v long, g int, e array<double>"), "v", "g", "e").collect()}

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    for i, g, e in rows:
        others = [cos(e, f) for j, h, f in rows if h == g and j != i]
        assert got[i] is None if not others else abs(got[i] - sum(others) / len(others)) < 1e-9


def test_documents_are_read_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} x" if i else None) for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "w1 w2 w2"), (2, "x")], "qid long, query string")
    path = str(tmp_path / "d")
    docs.write.parquet(path)
    got = search.bm25_documents(spark.read.parquet(path), queries, None)
    assert path not in got._jdf.queryExecution().toString(), "the result stands on its own"
    want = search.bm25_topk(search.postings(docs), search.doc_terms(docs), queries, None)
    key = lambda df: sorted((r["qid"], r["doc_id"], r["bm25_rank"], round(r["bm25_score"], 9)) for r in df.collect())
    assert key(got) == key(want)
    assert search.bm25_documents(docs.limit(0), queries).count() == 0 and search.bm25_documents(docs, queries.limit(0)).count() == 0


def test_scores_are_added_up_where_the_document_is(spark):
    """Of queries times documents nothing moves between tasks, and each sum is added in one order, however rows come."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 60)))) for i in range(300)] + [(7, "a b"), (7, "a b c"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(q, " ".join(rng.choices("abcdefghijk", k=9))) for q in range(12)] + [(20, "k"), (21, None)], "qid long, query string")
    got = search.document_scores(docs.repartition(7), queries)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "hashpartitioning(doc_id" in plan and "hashpartitioning(qid" not in plan
    scores = {(r["qid"], r["doc_id"]): r["bm25_score"] for r in got.collect()}
    assert scores == {(r["qid"], r["doc_id"]): r["bm25_score"] for r in search.document_scores(docs.repartition(3, "text"), queries).collect()}
    assert len(scores) > 3000 and {q for q, _ in scores} == set(range(12))
    unique = docs.where("doc_id not in (7, 8)")
    want = {(r["qid"], r["doc_id"]): r["bm25_score"] for r in search.bm25_scores(search.postings(unique), search.doc_terms(unique), queries).collect()}
    alone = {(r["qid"], r["doc_id"]): r["bm25_score"] for r in search.document_scores(unique, queries).collect()}
    assert want.keys() == alone.keys() and all(abs(want[k] - alone[k]) < 1e-9 for k in want)


def test_scores_with_terms_too_many_to_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog"), (3, "bird fish")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat CAT"), (2, "dog bird")], "qid long, query string")
    found = lambda: sorted(map(tuple, search.document_scores(docs, queries).collect()))
    want = found()
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "CELLS", 1)
    assert found() == want and len(want) == 4


def test_hybrid_needs_a_query_and_keeps_per_source_columns(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id long, text string")
    vecs = spark.createDataFrame([(1, [1.0]), (2, [0.0])], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(1, "alpha", [0.0])], "qid long, query string, embedding array<float>")
    out = search.hybrid_search(search.postings(docs), search.doc_terms(docs), vecs, q, 1).orderBy("position").collect()
    assert [(r["doc_id"], r["bm25_rank"], r["vec_rank"]) for r in out] == [(1, 1, 2), (2, None, 1)]
    with pytest.raises(Exception, match="blank"):
        search.hybrid_search(search.postings(docs), search.doc_terms(docs), vecs, q.withColumn("query", F.lit("  ")), 1).collect()


def test_options_resolve():
    assert search.resolved({"top_k": 3, "rrf_k": None}, search.HybridOptions(rrf_k=7)) == search.HybridOptions(30, 3, 7)
    for bad in ({"per_source_top_k": 0}, {"rrf_k": 1001}, {"top_k": 0}):
        with pytest.raises(ValueError):
            search.HybridOptions(**bad)
    assert search.HybridOptions(top_k=None).top_k is None


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 5, "q", "bb"), (1, 4, "q", "aa"), (1, 3, "q", "cccc")], "qid long, doc_id long, query string, content string")
    out = search.reranked(search.model_logits(hits, lambda pairs: [len(c) - 2.0 for _, c in pairs]), F.col("logit"), 2).orderBy("rerank_rank").collect()
    assert [(r["doc_id"], round(r["rerank_score"], 6)) for r in out] == [(3, round(1 / (1 + math.exp(-2)), 6)), (4, 0.5)]
    with pytest.raises(Exception, match="finite"):
        search.model_logits(hits, lambda pairs: [float("nan")] * len(pairs)).collect()
    adapted = search.adapted(search.reranked(hits.withColumn("bm25_rank", F.lit(1)), F.lit(0.0)), spark.createDataFrame([(3, "s"), (4, "s"), (5, None)], "doc_id long, source string"))
    with pytest.raises(Exception, match="no source"):
        adapted.collect()
