"""Evaluation runs: retrieval, answers, comparison of configurations, and their reports."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..functions.text import escape_cell_py, is_blank
from ..sources.shared import cut, scratch
from . import judges, metrics
from .providers import CONTENT_MISSING, Embed, Generate, strip

HIT_RATE_MIN = 0.9
RESULTS_DIR = "eval-results"
ANSWER_SCHEMA = "config string, qid long, faithfulness double, answer_relevance double, context_precision double, answer_correctness double, context_recall double, skipped map<string,string>, error string"


def run_eval(queries: DataFrame, expected: DataFrame, results: DataFrame, errors: DataFrame | None = None, top_k: int = metrics.TOP_K, strict: bool = False) -> DataFrame:
    """Each query with hit_rank, reciprocal_rank, top_results (the first top_k) and error. results has (qid, pos,
    source, page, ...); a result without source is an error of its query, as are rows of errors (qid, error)."""
    kept = results.where(F.col("pos") <= top_k)
    lacking = kept.where(is_blank("source")).select("qid", F.lit("a result has no source").alias("error"))
    failed = (lacking if errors is None else lacking.unionByName(errors.select("qid", "error"))).groupBy("qid").agg(F.min("error").alias("error"))
    sound = kept.join(failed, "qid", "left_anti")
    fields = [c for c in kept.columns if c not in ("qid", "config")]
    listed = sound.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in fields if c != "pos"]))).alias("top_results"))
    return metrics.per_query(queries, sound, expected, top_k, strict).join(listed, "qid", "left").join(failed, "qid", "left")


@dataclass(frozen=True)
class AnswerModels:
    """The models of an answer evaluation; without embed the relevance is skipped."""

    generate: Generate
    judge: Generate
    embed: Embed | None = None
    timeout_ms: float | None = None


def _cosine(a: list[float], b: list[float]) -> float:
    import math

    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    if len(a) != len(b) or not math.isfinite(norm):
        raise ValueError("vectors must be finite and of one length")
    return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0


def answer_row(config: str, qid: int, query: str, reference: str | None, contents: list[str | None], m: AnswerModels) -> dict[str, Any]:
    """The answer metrics of one query. A blank passage, or a model that raises, is the row's error and keeps what was
    measured before; a judge that answers badly or late skips its metric only."""
    out: dict[str, Any] = {"config": config, "qid": qid, **dict.fromkeys(metrics.ANSWER_METRICS), "skipped": {}, "error": None}

    def take(name: str, outcome: dict, score: Callable[[Any], float]) -> None:
        if outcome["ok"]:
            out[name] = score(outcome["value"])
        else:
            out["skipped"][name] = outcome["error"]["error"]

    def mean(flags: list) -> float:
        return sum(1 for f in flags if f is True) / len(flags) if flags else 0.0

    def precision(flags: list[bool]) -> float:
        useful = total = 0
        for i, f in enumerate(flags, 1):
            useful += f
            total += useful / i if f else 0
        return total / useful if useful else 0.0

    def f1(statements: list[dict]) -> float:
        tp, fp, fn = (sum(s["label"] == x for s in statements) for x in ("TP", "FP", "FN"))
        return tp / (tp + 0.5 * (fp + fn)) if tp else 0.0

    try:
        if any(not isinstance(c, str) or not strip(c) for c in contents):
            raise ValueError(f"{CONTENT_MISSING}: a retrieved passage has no content")
        context = "\n\n".join(contents)
        answer = m.generate(f"{query}\n\n{context}")
        if not isinstance(answer, str):
            raise TypeError("the generator must give a text")
        take("faithfulness", judges.judge_claims(m.judge, answer, context, m.timeout_ms), lambda v: mean([c["supported"] for c in v]))
        take("context_precision", judges.judge_usefulness(m.judge, query, contents, m.timeout_ms), precision)
        if m.embed is None:
            out["skipped"]["answer_relevance"] = "NO_EMBED_FN"
        else:
            got = judges.judge_questions(m.judge, answer, m.timeout_ms)
            if got["ok"] and got["value"]:
                vs = m.embed([query, *got["value"]])
                out["answer_relevance"] = sum(_cosine(vs[0], v) for v in vs[1:]) / len(got["value"])
            else:
                take("answer_relevance", got, lambda v: 0.0)
        if reference is None or not strip(reference):
            out["skipped"] |= dict.fromkeys(("answer_correctness", "context_recall"), "NO_REFERENCE_ANSWER")
        else:
            take("answer_correctness", judges.judge_statements(m.judge, answer, reference, m.timeout_ms), f1)
            take("context_recall", judges.judge_attribution(m.judge, reference, context, m.timeout_ms), mean)
    except Exception as e:  # a row's failure is that row's alone
        out["error"] = str(e) or type(e).__name__
    return out


def run_answer_eval(queries: DataFrame, results: DataFrame, models: AnswerModels, top_k: int = metrics.TOP_K) -> DataFrame:
    """ANSWER_SCHEMA rows for queries (qid, query, reference_answer) and results ([config,] qid, pos, content). One
    Arrow stage, one row a query and configuration, so a retried task repeats only its own calls."""
    config = F.col("config") if "config" in results.columns else F.lit("default")
    listed = results.where(F.col("pos") <= top_k).select(config.alias("config"), "qid", "pos", "content")
    configs = listed.select("config").distinct()
    passages = listed.groupBy("config", "qid").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("l")).select("config", "qid", F.col("l.content").alias("contents"))
    work = queries.select("qid", "query", "reference_answer").crossJoin(configs).join(passages, ["config", "qid"], "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [answer_row(r.config, r.qid, r.query, r.reference_answer, list(r.contents) if r.contents is not None else [], models) for r in pdf.itertuples()]
            yield pd.DataFrame(rows, columns=["config", "qid", *metrics.ANSWER_METRICS, "skipped", "error"]).astype({m: "float64" for m in metrics.ANSWER_METRICS})

    return work.select("config", "qid", "query", "reference_answer", "contents").mapInPandas(run, ANSWER_SCHEMA)


def benchmark(queries: DataFrame, expected: DataFrame, results: DataFrame, answers: DataFrame | None = None, top_k: int = metrics.TOP_K, strict: bool = False) -> DataFrame:
    """One row a configuration of results (config, qid, pos, source, ...): total, hits, hit_rate, mrr, mean_ndcg and
    the answer means. A query that a configuration gives nothing for counts as a miss; an answer metric that was
    never measured is null. What makes the results runs once, at once."""
    with scratch(queries.sparkSession) as keep:
        results = cut(results.select("config", "qid", "pos", "source", *[c for c in ("page",) if c in results.columns]))
        grid = queries.crossJoin(results.select("config").distinct())
        kept = results.where(F.col("pos") <= top_k)
        hits = metrics.matching(kept, expected, strict).withColumn("_gain", F.lit(1.0))
        gains = kept.select("config", "qid", "pos").join(hits, ["config", "qid", "pos"], "left").groupBy("config", "qid").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_gain", F.lit(0.0)).alias("g")))).alias("l"), F.min(F.when(F.col("_gain") == 1, F.col("pos"))).alias("hit_rank"))
        scored = grid.join(gains.select("config", "qid", "hit_rank", metrics.ndcg(F.col("l.g"), top_k).alias("ndcg")), ["config", "qid"], "left")
        scored = keep(cut(scored.select("config", "qid", "hit_rank", F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce("ndcg", F.lit(0.0)).alias("ndcg"))))
    out = metrics.summary(scored, ["config"]).join(scored.groupBy("config").agg(F.avg("ndcg").alias("mean_ndcg")), "config")
    return out if answers is None else out.join(metrics.answer_means(answers, ["config"]), "config", "left")


@dataclass(frozen=True)
class VersionMeta:
    generate_model: str
    judge_model: str
    eval_spec_version: str
    judge_prompt_version: str = judges.PROMPT_VERSION
    toolkit_version: str = __version__


def model_label(models: dict[str, str]) -> str:
    """The one model of all configurations, or name=model of each in their order."""
    kinds = set(models.values())
    return next(iter(kinds), "") if len(kinds) <= 1 else "; ".join(f"{k}={v}" for k, v in models.items())


def fixed(x: float | None, digits: int) -> str:
    """x with so many decimals, ties away from zero; n/a for what wasn't measured."""
    return "n/a" if x is None or x != x else str(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def benchmark_table(rows: list[dict], meta: VersionMeta | None = None) -> str:
    """A Markdown table of benchmark() rows."""
    names = [("hit_rate", 2), ("mrr", 4), ("mean_ndcg", 4), *[(m, 4) for m in metrics.ANSWER_METRICS]]
    lines = ["| config | " + " | ".join(n for n, _ in names) + " |", "|:--|" + "--:|" * len(names)]
    lines += ["| " + " | ".join([escape_cell_py(r["config"]), *[fixed(r.get(n), d) for n, d in names]]) + " |" for r in rows]
    if meta:
        lines += ["", *[f"- {k}: {escape_cell_py(str(v))}" for k, v in meta.__dict__.items()]]
    return "\n".join(lines) + "\n"


def markdown_report(summary: dict, categories: list[dict], per_query: list[dict], title: str = "Evaluation") -> str:
    """The summary, the categories by name, and a line for each query: its rank, MISS or ERROR."""
    out = [f"# {title}", "", f"Hit rate {fixed(summary['hit_rate'], 2)}, MRR {fixed(summary['mrr'], 4)}, {summary['total']} queries.", ""]
    if categories:
        out += ["| category | hits | total | rate |", "|:--|--:|--:|--:|"]
        out += [f"| {escape_cell_py(c['category'])} | {c['hits']} | {c['total']} | {fixed(c['rate'], 2)} |" for c in sorted(categories, key=lambda c: c["category"])] + [""]
    out += ["| query | result |", "|:--|:--|"]
    for q in per_query:
        result = f"ERROR: {escape_cell_py(q['error'])}" if q.get("error") else "MISS" if q.get("hit_rank") is None else str(q["hit_rank"])
        out.append(f"| {escape_cell_py(q['query'])} | {result} |")
    return "\n".join(out) + "\n"


def write_artifacts(folder: str, summary: dict, categories: list[dict], per_query: list[dict]) -> list[str]:
    """summary.json, per-query.json and report.md in folder."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    texts = {"summary.json": json.dumps(summary, ensure_ascii=False, indent=2), "per-query.json": json.dumps(per_query, ensure_ascii=False, indent=2, default=str), "report.md": markdown_report(summary, categories, per_query)}
    for name, text in texts.items():
        Path(folder, name).write_text(text, encoding="utf-8")
    return [str(Path(folder, n)) for n in texts]


def hit_rate_min(env: dict[str, str] | None = None, name: str = "EVAL_HIT_RATE_MIN") -> float:
    """The threshold of the environment, a number from 0 to 1, or 0.9."""
    raw = (os.environ if env is None else env).get(name, "").strip()
    if not raw:
        return HIT_RATE_MIN
    value = float(raw)
    if not 0 <= value <= 1:
        raise ValueError(f"{name} must be from 0 to 1")
    return value


def passes(summary: dict, least: float) -> bool:
    return summary["hit_rate"] >= least


def annotation(summary: dict, least: float, env: dict[str, str] | None = None) -> str | None:
    """A line that marks the outcome for a CI that asks for such lines, else None."""
    if (os.environ if env is None else env).get("GITHUB_ACTIONS") != "true":
        return None
    kind = "notice" if passes(summary, least) else "error"
    return f"::{kind}::hit rate {fixed(summary['hit_rate'], 2)}, wanted {fixed(least, 2)}"


@dataclass
class Gate:
    """Exit codes of an evaluation run: 0 passed, 1 below the threshold, 2 failed to run."""

    least: float = field(default_factory=hit_rate_min)

    def code(self, run: Callable[[], dict]) -> int:
        try:
            return 0 if passes(run(), self.least) else 1
        except Exception:
            return 2
