import json
import math
import time

import pytest
from pyspark.sql import functions as F

from sieveline.operators import evaluation, judges, metrics, providers


def value(spark, expr, data, kind):
    return spark.createDataFrame([(data,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_ndcg(spark):
    assert value(spark, metrics.ndcg, [1.0, 0.0, 0.0], "array<double>") == 1.0
    got = value(spark, lambda c: metrics.ndcg(c, 2), [0.0, 3.0, 1.0], "array<double>")
    assert abs(got - (3 / math.log2(3)) / (3 + 1 / math.log2(3))) < 1e-12
    assert value(spark, metrics.ndcg, [0.0, 0.0], "array<double>") == 0 and value(spark, metrics.ndcg, [], "array<double>") == 0
    for bad in ([-1.0], [float("nan")]):
        with pytest.raises(Exception, match="EVAL_INVALID"):
            value(spark, metrics.ndcg, bad, "array<double>")
    for k in (0, 1.5, True):
        with pytest.raises(ValueError):
            metrics.ndcg(F.lit(None), k)


def test_shares_and_precision(spark):
    claims = "array<struct<claim:string,supported:boolean>>"
    assert value(spark, metrics.faithfulness, [("a", True), ("b", False), ("c", None)], claims) == 1 / 3
    assert value(spark, metrics.faithfulness, [], claims) == 0 and value(spark, metrics.context_recall, [True, None], "array<boolean>") == 0.5
    assert abs(value(spark, metrics.context_precision, [True, False, True], "array<boolean>") - (1 + 2 / 3) / 2) < 1e-12
    assert value(spark, metrics.context_precision, [False], "array<boolean>") == 0


def test_correctness_and_relevance(spark):
    st = "array<struct<statement:string,label:string>>"
    got = value(spark, metrics.answer_correctness, [("a", "TP"), ("b", "FP"), ("c", "FN"), ("d", "??")], st)
    assert got["f1"] == 0.5 and (got["tp"], got["fp"], got["fn"]) == (1, 1, 1)
    assert value(spark, metrics.answer_correctness, [("b", "FP")], st)["f1"] == 0
    df = spark.createDataFrame([([1.0, 0.0], [[1.0, 0.0], [-1.0, 0.0], [0.0, 0.0]])], "q array<double>, e array<array<double>>")
    assert df.select(metrics.answer_relevance(F.col("q"), F.col("e"))).first()[0] == 0.0


def frames(spark):
    queries = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "x")], "qid long, query string, category string")
    expected = spark.createDataFrame([(1, "s1", 2), (1, "s9", None), (2, "s2", None), (3, "s3", None)], "qid long, source string, page int")
    results = spark.createDataFrame([(1, 1, "s0", 1), (1, 2, "s1", 1), (1, 3, "s1", 2), (2, 1, "s2", 7), (3, 1, None, 1)], "qid long, pos int, source string, page int")
    return queries, expected, results


def test_run_eval_strict_pages_errors_and_summary(spark):
    queries, expected, results = frames(spark)
    loose = {r["qid"]: r for r in evaluation.run_eval(queries, expected, results).collect()}
    strict = {r["qid"]: r for r in evaluation.run_eval(queries, expected, results, strict=True).collect()}
    assert [loose[q]["hit_rank"] for q in (1, 2, 3)] == [2, 1, None] and [strict[q]["hit_rank"] for q in (1, 2, 3)] == [3, 1, None]
    assert loose[3]["error"] == "a result has no source" and len(loose[1]["top_results"]) == 3
    s = metrics.summary(evaluation.run_eval(queries, expected, results)).first()
    assert (s["total"], s["hits"]) == (3, 2) and abs(s["mrr"] - 0.5) < 1e-12
    cats = {r["category"]: (r["hits"], r["total"]) for r in metrics.by_category(evaluation.run_eval(queries, expected, results)).collect()}
    assert cats == {"x": (1, 2), metrics.UNCATEGORIZED: (1, 1)}
    none = evaluation.run_eval(queries.withColumn("category", F.lit(None).cast("string")), expected, results)
    assert metrics.by_category(none).count() == 0
    empty = metrics.summary(evaluation.run_eval(queries.limit(0), expected, results)).first()
    assert (empty["total"], empty["hit_rate"], empty["mrr"]) == (0, 0, 0)


def test_mean_ndcg_counts_queries_without_results(spark):
    queries, expected, results = frames(spark)
    got = metrics.mean_ndcg(queries, results.where("qid <> 3"), expected).first()[0]
    one = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert abs(got - (one + 1) / 3) < 1e-12


def test_sampling(spark):
    q = spark.createDataFrame([(i,) for i in range(13)], "qid long")
    assert sorted(r[0] for r in metrics.sampled(q).collect()) == [i * 13 // 5 for i in range(5)]
    assert sorted(r[0] for r in metrics.sampled(q, every=4).collect()) == [0, 4, 8, 12]
    assert metrics.sampled(q, size=13).count() == metrics.sampled(q, size=99).count() == 13
    for bad in ({"every": 0}, {"size": 0}):
        with pytest.raises(ValueError):
            metrics.sampled(q, **bad)


def test_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    got = metrics.percentiles(df, "v").first()
    assert abs(got["p95"] - 4.8) < 1e-12 and got["p50"] == 3 and got["max"] == 5


def test_json_extraction():
    assert judges.extract_json('[1]') == judges.extract_json("so:\n```json\n[1]\n```") == judges.extract_json("well [1] ok") == [1]
    for bad in ("", "no", "[1"):
        with pytest.raises(ValueError):
            judges.extract_json(bad)


def test_judge_parsers_are_strict():
    assert judges.parse_claims('[{"claim":"a","supported":true,"more":1}]') == [{"claim": "a", "supported": True}]
    for f, bad in ((judges.parse_claims, '[{"claim":"a","supported":"yes"}]'), (judges.parse_statements, '[{"statement":"a","label":"XX"}]'), (judges.parse_questions, "[1]"), (lambda r: judges.parse_flags(r, 2), "[true]")):
        with pytest.raises(ValueError):
            f(bad)


def test_calls_time_out_degrade_and_raise():
    assert providers.call(lambda p: "x", "p", str.upper) == {"ok": True, "value": "X"}
    late = providers.call(lambda p: time.sleep(0.3), "p", str, 20)
    assert late["error"]["error"] == providers.JUDGE_TIMEOUT and late["error"]["retryable"]
    assert providers.call(lambda p: "x", "p", int)["error"]["error"] == providers.JUDGE_MALFORMED
    with pytest.raises(ConnectionError):
        providers.call(lambda p: (_ for _ in ()).throw(ConnectionError()), "p", str)
    assert [providers.timeout_of(x, 7) for x in (None, 0, -1, float("inf"), True, 2**40, 5)] == [7, 7, 7, 7, 7, 2**31 - 1, 5]
    assert [providers.backoff_ms(i) for i in range(5)] == [500, 1500, 4500, 13500, 30000] and providers.backoff_ms(0, 90000) == 30000


def test_judge_cache():
    asked = []

    def judge(p):
        asked.append(p)
        if p == "bad":
            raise OSError
        return p

    cached = judges.with_judge_cache(judge, "m", judges.MemoryStore(2))
    assert [cached(p) for p in "aab"] == list("aab") and asked == ["a", "b"]
    for _ in range(2):
        with pytest.raises(OSError):
            cached("bad")
    cached("c"), cached("a")
    assert asked == ["a", "b", "bad", "bad", "c", "a"]


def test_each_distinct_prompt_is_asked_once(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "k"), (4, None)], "qid long, prompt string")
    known = spark.createDataFrame([("k", "kept")], "prompt string, raw string")
    out = {r["qid"]: r["outcome"] for r in judges.asked(prompts, lambda p: p * 2, known).collect()}
    assert (out[1]["raw"], out[2]["raw"], out[3]["raw"], out[4]) == ("aa", "aa", "kept", None)


def judge(prompt: str) -> str:
    if "single claims" in prompt:
        return '[{"claim":"a","supported":true},{"claim":"b","supported":false}]'
    if "numbered passages" in prompt:
        return "[true, false]" if "[1] " in prompt else "[true]"
    if "Which questions" in prompt:
        return '["q"]'
    if "Label each statement" in prompt:
        return "nonsense" if "odd" in prompt else '[{"statement":"s","label":"TP"},{"statement":"t","label":"FN"}]'
    return "[true, true]"


def test_answer_eval_and_benchmark(spark):
    queries = spark.createDataFrame([(1, "one", "ref"), (2, "two", None), (3, "three", "odd"), (4, "four", "ref")], "qid long, query string, reference_answer string")
    results = spark.createDataFrame([("c1", 1, 1, "x"), ("c1", 1, 2, "y"), ("c1", 2, 1, "x"), ("c1", 3, 1, "x"), ("c1", 4, 1, " ")], "config string, qid long, pos int, content string")
    models = evaluation.AnswerModels(lambda p: "an answer", judge, lambda texts: [[1.0, 0.0]] * len(texts))
    out = {r["qid"]: r for r in evaluation.run_answer_eval(queries, results, models).collect()}
    assert [out[1][m] for m in metrics.ANSWER_METRICS] == [0.5, 1.0, 1.0, 1 / 1.5, 1.0] and out[1]["skipped"] == {}
    assert out[2]["skipped"] == {"answer_correctness": "NO_REFERENCE_ANSWER", "context_recall": "NO_REFERENCE_ANSWER"}
    assert out[3]["skipped"] == {"answer_correctness": providers.JUDGE_MALFORMED} and out[3]["context_recall"] == 1.0
    assert out[4]["error"].startswith(providers.CONTENT_MISSING) and out[4]["faithfulness"] is None
    bare = evaluation.run_answer_eval(queries.limit(1), results, evaluation.AnswerModels(lambda p: "a", judge)).first()
    assert bare["skipped"] == {"answer_relevance": "NO_EMBED_FN"}
    expected = spark.createDataFrame([(1, "s", None)], "qid long, source string, page int")
    table = evaluation.benchmark(queries, expected, results.withColumn("source", F.lit("s")), evaluation.run_answer_eval(queries, results, models)).first()
    assert (table["config"], table["total"], table["hits"], table["hit_rate"]) == ("c1", 4, 1, 0.25) and table["faithfulness"] == 0.5


def test_reports(tmp_path):
    assert [evaluation.fixed(x, 2) for x in (3.125, 0.005, None, float("nan"), 1)] == ["3.13", "0.01", "n/a", "n/a", "1.00"]
    table = evaluation.benchmark_table([{"config": "a|b", "hit_rate": 1.0, "mrr": 0.5, "mean_ndcg": None}], evaluation.VersionMeta("g", "j", "1"))
    assert "a\\|b | 1.00 | 0.5000 | n/a" in table and "- judge_model: j" in table
    summary = {"hit_rate": 0.5, "mrr": 0.25, "total": 2}
    per = [{"query": "q1", "hit_rank": 2}, {"query": "q2", "hit_rank": None}, {"query": "q3", "error": "boom"}]
    report = evaluation.markdown_report(summary, [{"category": "b", "hits": 1, "total": 2, "rate": 0.5}, {"category": "a", "hits": 0, "total": 1, "rate": 0.0}], per)
    assert report.index("| a |") < report.index("| b |") and "| q2 | MISS |" in report and "ERROR: boom" in report
    paths = evaluation.write_artifacts(str(tmp_path / "o"), summary, [], per)
    assert json.loads(open(paths[0]).read()) == summary
    assert evaluation.model_label({"a": "m", "b": "m"}) == "m" and evaluation.model_label({"a": "m", "b": "n"}) == "a=m; b=n"


def test_gate():
    assert evaluation.hit_rate_min({}) == 0.9 and evaluation.hit_rate_min({"EVAL_HIT_RATE_MIN": "0.5"}) == 0.5
    for bad in ("x", "1.1"):
        with pytest.raises(ValueError):
            evaluation.hit_rate_min({"EVAL_HIT_RATE_MIN": bad})
    assert evaluation.annotation({"hit_rate": 1}, 0.9, {}) is None and evaluation.annotation({"hit_rate": 0}, 0.9, {"GITHUB_ACTIONS": "true"}).startswith("::error::")
    gate = evaluation.Gate(0.9)
    assert [gate.code(f) for f in (lambda: {"hit_rate": 0.9}, lambda: {"hit_rate": 0.8}, lambda: 1 / 0)] == [0, 1, 2]
    assert metrics.judge_calls(3, 2) == 30


def letters(texts):
    """An embedder that counts a few letters."""
    return [[float(t.lower().count(c)) + 0.01 for c in "aeiou"] for t in texts]


def overlap(pairs):
    """A scorer by shared words."""
    return [float(len(set(q.lower().split()) & set(c.lower().split()))) for q, c in pairs]


def test_the_command_line_measures_an_index(spark, tmp_path, capsys, monkeypatch):
    from sieveline import __main__ as cli
    from sieveline.sources.index import Index

    texts = ["annual leave is twenty days", "sick notes go to the office", "travel costs are refunded", "the canteen opens at noon"]
    rows = [(t, "handbook", i + 1, v) for (i, t), v in zip(enumerate(texts), letters(texts))]
    index = Index.open(spark, str(tmp_path / "ix"), dim=5)
    index.append(spark.createDataFrame(rows, "content string, source string, page int, embedding array<float>"), ["page"])
    queries = ["how many days of annual leave", "where do sick notes go", "are travel costs refunded", "when does the canteen open"]
    lines = [f"  - query: {q}\n    category: c{i % 2}\n    expected: [{{source: handbook, page: {i + 1}}}]" for i, q in enumerate(queries)]
    (tmp_path / "set.yml").write_text("version: '1'\nqueries:\n" + "\n".join(lines))
    base = ["eval", "--index", str(tmp_path / "ix"), "--set", str(tmp_path / "set.yml"), "--top-k", "1"]
    assert cli.main([*base, "--out", str(tmp_path / "out")]) == 0
    assert "hit rate 1.00" in capsys.readouterr().out and (tmp_path / "out" / "report.md").exists()
    assert cli.main([*base, "--scorer", f"{__name__}:overlap", "--embed", f"{__name__}:letters"]) == 0
    (tmp_path / "set.yml").write_text("version: '1'\nqueries:\n" + "\n".join(lines).replace("page: 1", "page: 9"))
    assert cli.main(base) == 1 and cli.main([*base, "--any-page"]) == 0
    assert cli.main(["eval", "--index", str(tmp_path / "none"), "--set", str(tmp_path / "set.yml")]) == 2
