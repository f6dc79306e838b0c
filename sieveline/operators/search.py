"""Retrieval: BM25, exact nearest neighbours, rank fusion, hybrid search and reranking, for many queries at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import is_blank, terms
from ..sources.shared import cut, light_batches, scratch

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
SOURCE_TOP_K, TOP_K, RRF_K, RERANK_TOP_K = 30, 10, 60, 5
#: Numbers that one matrix product of a block of queries gives.
QUERY_CELLS = 1 << 20


def positive(name: str, value: float | None, most: float = math.inf) -> None:
    """value must be a whole number from 1 to most; None stands for no limit where there is none."""
    if value is None and most == math.inf:
        return
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise ValueError(f"{name} must be a whole number from 1" + (f" to {most}" if most < math.inf else ""))


def top(df: DataFrame, by: list[str], order: list[Column], rank: str, k: int | None) -> DataFrame:
    """df with its position within by, from 1; the first k only."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


#: Makes an array of terms of a column of texts: terms(), or a segmenter of one's own.
Segment = Callable[[Column], Column]


def doc_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: Segment = terms) -> DataFrame:
    """(doc_id, terms, dl); a null text has no terms."""
    found = F.coalesce(segment(F.col(text_col)), F.array().cast("array<string>"))
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("terms")).withColumn("dl", F.size("terms"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: Segment = terms) -> DataFrame:
    """(term, doc_id, tf), one row for each term of each document."""
    return doc_terms(docs, id_col, text_col, segment).select("doc_id", F.explode("terms").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, id_col: str = "qid", text_col: str = "query", segment: Segment = terms) -> DataFrame:
    """(qid, term, qtf); a term that a query repeats counts as often."""
    return queries.select(F.col(id_col).alias("qid"), F.explode(segment(F.col(text_col))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def _scores(held: DataFrame, totals: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores from the postings (term, doc_id, tf, dl) of all query terms."""
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    weighed = asked.join(df, "term").crossJoin(F.broadcast(totals)).select("qid", "term", "avgdl", (idf * F.col("qtf")).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return held.join(weighed, "term").groupBy("qid", "doc_id").agg((-F.sum(part)).alias("bm25_score"))


def _totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25_scores(posting: DataFrame, stats: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id, bm25_score): the negated BM25 score, so the least is best, of documents with any query term."""
    asked = query_terms(queries)
    held = posting.join(asked.select("term").distinct(), "term", "left_semi").join(stats.select("doc_id", "dl"), "doc_id")
    return _scores(held, _totals(stats), asked)


def _best(scores: DataFrame, k: int | None) -> DataFrame:
    return top(scores, ["qid"], [F.round("bm25_score", 9), F.col("doc_id")], "bm25_rank", k)


def bm25_topk(posting: DataFrame, stats: DataFrame, queries: DataFrame, k: int | None = SOURCE_TOP_K) -> DataFrame:
    """(qid, doc_id, bm25_score, bm25_rank) of each query's best k; ties go to the least doc_id. A query without
    terms has no hits."""
    positive("k", k)
    return _best(bm25_scores(posting, stats, queries), k)


#: A side is broadcast only when its rows, counted first, fit in this many bytes, at about so many a row.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 100
#: Scores that a task adds up, about.
CELLS = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() * ROW_BYTES <= BROADCAST_BYTES else df


def _straight(keep: Callable[[DataFrame], DataFrame], docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, segment: Segment) -> DataFrame:
    """Scores whose rows, until they are added up, never leave the task that has their document. What a query term has
    in a document is kept with the document, one row each; of all others only counts move."""
    spark = docs.sparkSession
    asked = cut(query_terms(queries, "qid", "query", segment))
    # in the order of the terms, so sums are always added in this order; -1 stands once in each document
    numbers = cut(asked.select("term").distinct().sort("term").withColumn("no", F.monotonically_increasing_id()))
    wanted = _small(cut(numbers.unionByName(spark.createDataFrame([("", -1)], "term string, no long"))))
    each = doc_terms(docs, id_col, text_col, segment)
    found = each.select("doc_id", "dl", F.explode(F.array_append("terms", F.lit(""))).alias("term")).join(wanted, "term").select("doc_id", "dl", "no")
    counted = found.repartition("doc_id").groupBy("doc_id", "dl", "no").agg(F.count("*").alias("tf"))
    times, term = F.max(F.when(F.col("no") < 0, F.col("tf"))).alias("times"), F.when(F.col("no") >= 0, F.struct("no", "tf"))
    held = keep(cut(counted.groupBy("doc_id", "dl").agg(times, F.array_sort(F.collect_list(term)).alias("held"))))
    n, avgdl = held.agg(F.coalesce(F.sum("times"), F.lit(0)), (F.sum(F.col("dl") * F.col("times")) / F.sum("times"))).first()
    terms_ = F.explode("held").alias("h")
    df = held.select(terms_).groupBy(F.col("h.no").alias("no")).agg(F.count("*").alias("df"))
    idf = F.greatest(F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    weights = keep(cut(asked.join(numbers, "term").join(df, "no").select("no", "qid", (idf * F.col("qtf")).alias("idf"))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * asked.select("qid").distinct().count() / CELLS))
    rows = held.repartition(parts, "doc_id").select("doc_id", "dl", terms_).select("doc_id", "dl", "h.no", "h.tf").join(_small(weights), "no")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl).cast("double")))
    return rows.groupBy("qid", "doc_id").agg((-F.sum(part)).alias("bm25_score"))


def document_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: Segment = terms) -> DataFrame:
    """bm25_scores() straight from documents, which are read once, at once; the scores themselves are added up when
    they are read."""
    with scratch(docs.sparkSession) as keep:
        return _straight(keep, docs, queries, id_col, text_col, segment)


def bm25_documents(docs: DataFrame, queries: DataFrame, k: int | None = SOURCE_TOP_K, id_col: str = "doc_id", text_col: str = "text", segment: Segment = terms) -> DataFrame:
    """bm25_topk() straight from documents, which are read once: what query terms each has goes to the shared folder,
    with its length for the totals. Runs at once; only the best k stay in the folder. For many calls keep an Index
    instead."""
    positive("k", k)
    with scratch(docs.sparkSession) as keep:
        return keep(cut(_best(_straight(lambda df: df, docs, queries, id_col, text_col, segment), k)))


def _checked(df: DataFrame, key: str, dim: int, name: str) -> DataFrame:
    v = vectors.doubles("embedding")
    return df.select(key, F.when(vectors.valid(v, dim), v).otherwise(F.raise_error(F.lit(f"embedding must have {dim} finite numbers"))).alias(name))


def _matrix(vs: pd.Series, dim: int) -> np.ndarray:
    return np.array(vs.tolist(), np.float64).reshape(len(vs), dim)


def _blocks(base: DataFrame, queries: DataFrame, dim: int, name: str, block_bytes: int, some: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(qid, doc_id, name) that some(queries, base rows) picks, as places of both and a number, of each block of
    queries and each batch of base. Queries come in blocks of about block_bytes, each a pass over base, so neither
    the driver nor a task holds more of them, however many there are."""
    asked = _checked(queries, "qid", dim, "e")
    n = max(1, math.ceil(queries.count() * dim * 8 / block_bytes))
    kinds = {c: df.select(c).schema[0].dataType.simpleString() for df, c in ((queries, "qid"), (base, "doc_id"))}

    def block(i: int) -> DataFrame:
        held = (asked if n == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)).toPandas()
        ids, q = held["qid"].to_numpy(), _matrix(held["e"], dim)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if not len(pdf):
                    continue
                x, doc = _matrix(pdf["embedding"], dim), pdf["doc_id"].to_numpy()
                step = max(1, QUERY_CELLS // len(x))
                for at in range(0, len(q), step):
                    row, best, value = some(q[at : at + step], x)
                    yield pd.DataFrame({"qid": ids[at + row], "doc_id": doc[best], name: value})

        return _checked(base, "doc_id", dim, "embedding").mapInPandas(run, f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, {name} double")

    return reduce(DataFrame.unionByName, map(block, range(n)))


def knn_topk(base: DataFrame, queries: DataFrame, dim: int, k: int | None = SOURCE_TOP_K, block_bytes: int = 32 << 20) -> DataFrame:
    """(qid, doc_id, distance, vec_rank): exact nearest by Euclidean distance, by matrix products in Arrow batches, each
    keeping what may be among the best k of each query, ties included; the least doc_id goes first of equal distances.
    base has (doc_id, embedding), queries (qid, embedding); a vector of another length than dim or with a number that
    isn't finite is an error. k None gives all."""
    positive("k", k)
    eps = 4 * (dim + 4) * np.finfo(np.float64).eps

    def near(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        qq, xx = (q * q).sum(1), (x * x).sum(1)
        d2 = qq[:, None] + xx[None] - 2 * q @ x.T
        # all within the k-th place's rounding: of the squares' sums, and of the 9 digits that ties go by
        off = eps * (qq + xx.max())
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1] if k is not None and len(x) > k else np.full(len(q), np.inf)
        most = (np.sqrt(np.maximum(kth + off, 0)) + 1e-9) ** 2 + off
        row, best = np.nonzero(d2 <= most[:, None])
        return row, best, np.sqrt(((x[best] - q[row]) ** 2).sum(1))

    return top(_blocks(base, queries, dim, "distance", block_bytes, near), ["qid"], [F.round("distance", 9), F.col("doc_id")], "vec_rank", k)


def cosines(base: DataFrame, queries: DataFrame, dim: int, block_bytes: int = 32 << 20) -> DataFrame:
    """(qid, doc_id, cosine) of each query with each vector of base; 0 with a vector of zeros. Faults as in knn_topk()."""

    def every(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        unit = [np.divide(v, n, out=np.zeros_like(v), where=n > 0) for v in (q, x) for n in [np.linalg.norm(v, axis=1, keepdims=True)]]
        row, best = np.divmod(np.arange(len(q) * len(x)), len(x))
        return row, best, (unit[0] @ unit[1].T).ravel()

    return _blocks(base, queries, dim, "cosine", block_bytes, every)


def mean_cosines(df: DataFrame, id_col: str, by: str, vector_col: str) -> DataFrame:
    """(id_col, mean_cosine): of each vector with the others in its group by, null where there are none; 0 with a
    vector of zeros. The product with the sum of all unit vectors of the group, which is added up before rows move."""
    v = vectors.doubles(vector_col)
    norm = F.sqrt(vectors.dot(v, v))
    unit = df.select(id_col, by, F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))).alias("_u"))
    sums = unit.select(by, F.posexplode("_u").alias("_at", "_x")).groupBy(by, "_at").agg(F.sum("_x").alias("_x"))
    groups = sums.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda x: x["_x"]).alias("_sum")).join(unit.groupBy(by).agg(F.count("*").alias("_n")), by)
    total = vectors.dot(F.col("_u"), F.col("_sum")) - vectors.dot(F.col("_u"), F.col("_u"))
    return unit.join(groups, by).select(id_col, F.try_divide(total, F.col("_n") - 1).alias("mean_cosine"))


def rrf_fuse(ranked: DataFrame, sources: int, k: int = RRF_K, top_k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (qid, source_ix, id, rank[, payload]): (qid, id, score, ranks, payloads, position).

    score sums 1 / (k + rank); ranks and payloads have a place for each source, null where it lacks the id. Order:
    score descending, then id. An id that a source lists twice, or a rank below 1, is an error.
    """
    positive("k", k, 1000)
    positive("top_k", top_k)
    has_payload = "payload" in ranked.columns
    slots = [F.max(F.when(F.col("source_ix") == i, F.col("rank"))) for i in range(sources)]
    loads = [F.max(F.when(F.col("source_ix") == i, F.col("payload"))) for i in range(sources)] if has_payload else []
    fused = ranked.groupBy("qid", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array(*slots).alias("ranks"), *([F.array(*loads).alias("payloads")] if loads else []), F.count("*").alias("_n"), F.size(F.collect_set("source_ix")).alias("_sources"), F.min("rank").alias("_least"))
    bad = (F.col("_n") != F.col("_sources")) | (F.col("_least") < 1)
    fused = fused.withColumn("score", F.when(bad, F.raise_error(F.lit("rrf_fuse: an id twice in a source, or a rank below 1"))).otherwise(F.col("score"))).drop("_n", "_sources", "_least")
    return top(fused, ["qid"], [F.round("score", 12).desc(), F.col("id")], "position", top_k)


@dataclass(frozen=True)
class HybridOptions:
    """Hits of each source, fused hits (None: all) and the constant of the fusion."""

    per_source_top_k: int = SOURCE_TOP_K
    top_k: int | None = TOP_K
    rrf_k: int = RRF_K

    def __post_init__(self) -> None:
        positive("per_source_top_k", self.per_source_top_k, 1000)
        positive("rrf_k", self.rrf_k, 1000)
        positive("top_k", self.top_k)


def resolved(call: dict | None, defaults: HybridOptions | None) -> HybridOptions:
    """The call's options over the defaults over the constants; None in a call counts as absent."""
    base = defaults or HybridOptions()
    return HybridOptions(**{**base.__dict__, **{k: v for k, v in (call or {}).items() if v is not None}})


def hybrid(lexical: DataFrame, dense: DataFrame, options: HybridOptions = HybridOptions()) -> DataFrame:
    """Fusion of bm25_topk() and knn_topk() rows: (qid, doc_id, rrf_score, position, bm25_rank, bm25_score, vec_rank,
    distance), null where a source lacks the document."""
    both = lexical.select("qid", F.lit(0).alias("source_ix"), F.col("doc_id").alias("id"), F.col("bm25_rank").alias("rank"), F.col("bm25_score").alias("payload"))
    both = both.unionByName(dense.select("qid", F.lit(1).alias("source_ix"), F.col("doc_id").alias("id"), F.col("vec_rank").alias("rank"), F.col("distance").alias("payload")))
    fused = rrf_fuse(both, 2, options.rrf_k, options.top_k)
    ranks, loads = F.col("ranks"), F.col("payloads")
    return fused.select("qid", F.col("id").alias("doc_id"), F.col("score").alias("rrf_score"), "position", ranks[0].alias("bm25_rank"), loads[0].alias("bm25_score"), ranks[1].alias("vec_rank"), loads[1].alias("distance"))


def hybrid_search(posting: DataFrame, stats: DataFrame, vecs: DataFrame, queries: DataFrame, dim: int, options: HybridOptions = HybridOptions()) -> DataFrame:
    """hybrid() for queries (qid, query, embedding); a blank query is an error."""
    query = F.when(is_blank("query"), F.raise_error(F.lit("query must not be blank"))).otherwise(F.col("query"))
    asked = queries.withColumn("query", query)
    return hybrid(bm25_topk(posting, stats, asked, options.per_source_top_k), knn_topk(vecs, asked, dim, options.per_source_top_k), options)


def reranked(hits: DataFrame, logit: Column, k: int | None = RERANK_TOP_K) -> DataFrame:
    """hits with rerank_score = sigmoid(logit) and rerank_rank; the best k of each query, ties to the least doc_id."""
    positive("k", k)
    scored = hits.withColumn("rerank_score", vectors.sigmoid(logit))
    return top(scored, ["qid"], [F.round("rerank_score", 12).desc(), F.col("doc_id")], "rerank_rank", k)


def model_logits(hits: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], batch: int = 32, max_length: int = 512) -> DataFrame:
    """hits (with query and content) and the scorer's logit of each pair, asked in batches; a logit that isn't finite
    is an error. The rows come out in their order."""
    positive("batch", batch, 64)
    if not 16 <= max_length <= 512:
        raise ValueError("max_length must be from 16 to 512")
    light_batches(hits.sparkSession)

    @F.pandas_udf("double")
    def logits(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, c in parts:
            pairs, out = list(zip(q, c)), []
            for i in range(0, len(pairs), batch):
                out += [float(x) for x in scorer(pairs[i : i + batch])]
            if len(out) != len(pairs) or not all(map(math.isfinite, out)):
                raise ValueError("the scorer must give a finite logit for each pair")
            yield pd.Series(out, dtype="float64")

    return hits.withColumn("logit", logits("query", "content"))


def answers(hits: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], k: int = RERANK_TOP_K) -> DataFrame:
    """From hybrid() hits to what an evaluation takes: the best max(2 * k, 10) of each query (qid, query) with their
    content from docs (doc_id, source, content, ...) are reranked by the scorer, and the best k adapted()."""
    positive("k", k)
    near = hits.where(F.col("position") <= max(2 * k, 10))
    held = near.join(queries.select("qid", "query"), "qid").join(docs.select("doc_id", "content"), "doc_id")
    return adapted(reranked(model_logits(held, scorer), F.col("logit"), k).drop("content"), docs)


def with_confidence(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, hits, confidence): high for queries with hits, low for those without."""
    n = hits.groupBy("qid").agg(F.count("*").alias("hits"))
    return queries.select("qid").join(n, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") > 0, "high").otherwise("low").alias("confidence"))


def adapted(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Reranked hits as the evaluation wants them; a hit without source is an error."""
    joined = hits.join(docs.select("doc_id", "source", *[c for c in ("page", "section", "content") if c in docs.columns]), "doc_id")
    source = F.when(F.col("source").isNull(), F.raise_error(F.lit("a hit has no source"))).otherwise(F.col("source"))
    return joined.withColumn("source", source).withColumnRenamed("bm25_rank", "fts_rank").withColumn("pos", F.col("rerank_rank"))
