"""Retrieval and answer metrics as aggregates and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors

UNCATEGORIZED = "(uncategorized)"
TOP_K = 5


def matching(results: DataFrame, expected: DataFrame, strict: bool = False) -> DataFrame:
    """The rows of results (qid, pos, source, page, ...) that some row of expected (qid, source, page) names; strict
    wants the page too where expected has one."""
    keys = ["qid", "pos"] + (["config"] if "config" in results.columns else [])
    want = expected.select(F.col("qid").alias("_q"), F.col("source").alias("_s"), F.col("page").cast("int").alias("_p"))
    same = (results["qid"] == F.col("_q")) & (results["source"] == F.col("_s"))
    if strict:
        same = same & (F.col("_p").isNull() | F.col("_p").eqNullSafe(results["page"] if "page" in results.columns else F.lit(None)))
    return results.join(want, same, "left_semi").select(*keys)


def per_query(queries: DataFrame, results: DataFrame, expected: DataFrame, top_k: int = TOP_K, strict: bool = False) -> DataFrame:
    """queries with hit_rank, the first matching position up to top_k (null: a miss), and reciprocal_rank."""
    by = ["qid"] + (["config"] if "config" in results.columns else [])
    first = matching(results.where(F.col("pos") <= top_k), expected, strict).groupBy(*by).agg(F.min("pos").alias("hit_rank"))
    return queries.join(first, by, "left").withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0)))


def summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(total, hits, hit_rate, mrr); rows with an error count as misses, without rows the rates are 0."""
    hit = F.when(F.col("hit_rank").isNotNull(), 1).otherwise(0)
    aggs = [F.count("*").alias("total"), F.coalesce(F.sum(hit), F.lit(0)).alias("hits"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("hit_rate"), F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr")]
    return scored.groupBy(*(by or [])).agg(*aggs)


def by_category(scored: DataFrame) -> DataFrame:
    """(category, hits, total, rate) if any query has a category, else no rows; queries without are uncategorized."""
    any_category = scored.agg(F.max(F.col("category").isNotNull()).alias("_any"))
    hit = F.when(F.col("hit_rank").isNotNull(), 1).otherwise(0)
    each = scored.groupBy(F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category")).agg(F.sum(hit).alias("hits"), F.count("*").alias("total"), F.avg(hit).alias("rate"))
    return each.join(F.broadcast(any_category), F.col("_any")).drop("_any")


def dcg(gains: Column, k: Column | None = None) -> Column:
    held = F.transform(gains, lambda g, i: g / F.log2(i.cast("double") + 2))
    return F.aggregate(held if k is None else F.slice(held, F.lit(1), F.greatest(k, F.lit(0))), F.lit(0.0), lambda s, x: s + x)


def ndcg(gains: Column, k: int | None = None) -> Column:
    """nDCG of gains in their order: the ideal is the same gains, all sorted, then cut at k. Without a positive gain 0;
    a gain below 0, or one that isn't finite, is an error."""
    if k is not None and (isinstance(k, bool) or not isinstance(k, int) or k < 1):
        raise ValueError("k must be a whole number from 1")
    gains = gains.cast("array<double>")
    cut = F.lit(k) if k is not None else F.size(gains)
    ideal = dcg(F.reverse(F.array_sort(gains)), cut)
    bad = ~vectors.finite(gains) | F.exists(gains, lambda g: g < 0)
    value = F.when(ideal > 0, dcg(gains, cut) / ideal).otherwise(F.lit(0.0))
    return F.when(bad, F.raise_error(F.lit("EVAL_INVALID_METRIC_INPUT: gains must be finite and 0 or more"))).otherwise(value)


def mean_ndcg(queries: DataFrame, results: DataFrame, expected: DataFrame, k: int = TOP_K, strict: bool = False) -> DataFrame:
    """(mean_ndcg) over all queries of the nDCG of binary gains; queries without results count as 0."""
    hits = matching(results, expected, strict).withColumn("_gain", F.lit(1.0))
    gains = results.select("qid", "pos").join(hits, ["qid", "pos"], "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_gain", F.lit(0.0)).alias("g")))).alias("l"))
    scored = gains.select("qid", ndcg(F.col("l.g"), k).alias("ndcg"))
    return queries.select("qid").join(scored, "qid", "left").agg(F.coalesce(F.avg(F.coalesce("ndcg", F.lit(0.0))), F.lit(0.0)).alias("mean_ndcg"))


def share(flags: Column, test=lambda x: x) -> Column:
    """The share of elements that pass; 0 of none is 0. Null elements don't pass."""
    n = F.size(flags)
    return F.when(n > 0, F.size(F.filter(flags, lambda x: F.coalesce(test(x), F.lit(False)))) / n).otherwise(F.lit(0.0))


def faithfulness(claims: Column) -> Column:
    """Share of supported among claims {claim, supported}."""
    return share(claims, lambda c: c["supported"])


def context_recall(flags: Column) -> Column:
    """Share of reference sentences that the context supports."""
    return share(flags)


def context_precision(flags: Column) -> Column:
    """Average precision of the useful flags in their order; 0 if none is useful."""
    zero = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("useful"), F.lit(0.0).alias("sum"))

    def step(acc: Column, flag: Column) -> Column:
        on = F.coalesce(flag, F.lit(False))
        useful, seen = acc["useful"] + on.cast("int"), acc["seen"] + 1
        return F.struct(seen.alias("seen"), useful.alias("useful"), (acc["sum"] + F.when(on, useful / seen).otherwise(F.lit(0.0))).alias("sum"))

    return F.aggregate(flags, zero, step, lambda a: F.when(a["useful"] > 0, a["sum"] / a["useful"]).otherwise(F.lit(0.0)))


def answer_correctness(statements: Column) -> Column:
    """{precision, recall, f1, tp, fp, fn} of statements {statement, label}; other labels don't count, no TP gives 0."""

    def count(label: str) -> Column:
        return F.size(F.filter(statements, lambda s: F.coalesce(s["label"] == label, F.lit(False))))

    tp, fp, fn = count("TP"), count("FP"), count("FN")
    some = tp > 0
    return F.struct(F.when(some, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"), F.when(some, tp / (tp + fn)).otherwise(F.lit(0.0)).alias("recall"), F.when(some, tp / (tp + 0.5 * (fp + fn))).otherwise(F.lit(0.0)).alias("f1"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


def answer_relevance(query: Column, questions: Column) -> Column:
    """Mean cosine of a query's vector with those of the questions that its answer answers; none gives 0."""
    total = F.aggregate(F.transform(questions, lambda q: vectors.cosine(query, q)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(questions) > 0, total / F.size(questions)).otherwise(F.lit(0.0))


ANSWER_METRICS = ("faithfulness", "answer_relevance", "context_precision", "answer_correctness", "context_recall")


def answer_means(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The mean of each answer metric over the rows that have it; null where none has."""
    return rows.groupBy(*(by or [])).agg(*[F.avg(m).alias(m) for m in ANSWER_METRICS if m in rows.columns])


def judge_calls(queries: int, configs: int, metrics: int = 5, variance: int = 1) -> int:
    return queries * metrics * configs * variance


def percentiles(df: DataFrame, column: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(p50, p95, ..., mean, min, max): percentiles with linear interpolation between order statistics."""
    if not ps or any(not 0 <= p <= 1 for p in ps):
        raise ValueError("percentiles must be from 0 to 1")
    value = F.col(column).cast("double")
    return df.agg(*[F.percentile(value, F.lit(p)).alias(f"p{p * 100:g}".replace(".", "_")) for p in ps], F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def sampled(queries: DataFrame, order: str = "qid", every: int | None = None, size: int | None = None) -> DataFrame:
    """Each every-th query from the first, or size of them at floor(i * total / size); all if there are no more. With
    neither, 5."""
    if every is not None and every < 1 or size is not None and size < 1:
        raise ValueError("every and size must be 1 or more")
    placed = queries.withColumn("_ix", F.row_number().over(Window.orderBy(order)).cast("long") - 1)
    if every is not None:
        return placed.where(F.col("_ix") % every == 0).drop("_ix")
    size = size or 5
    total = queries.agg(F.count("*").alias("_total"))
    # place _ix is floor(i * total / size) for some i: the least such i gives it back
    i = F.ceil(F.col("_ix") * F.lit(size) / F.col("_total"))
    chosen = (F.col("_total") <= size) | ((F.floor(i * F.col("_total") / F.lit(size)) == F.col("_ix")) & (i < size))
    return placed.crossJoin(F.broadcast(total)).where(chosen).drop("_ix", "_total")
