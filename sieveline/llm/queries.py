"""The registered training-data queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, ctph, langid, minhash, mixing, packing, pii, tokenpack, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(_table(spark, sf_dir, "documents"), more=("_copy", "_place"))
    return out.withColumnsRenamed({"_copy": "copy_no", "_place": "place"})


def op2_itq_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.grouped(_table(spark, sf_dir, "embeddings"))


def op3_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenpack.packed_tokens(_table(spark, sf_dir, "documents"))


def op4_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


def op5_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicates(_table(spark, sf_dir, "documents"))


def op6_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.flagged(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_ids(_table(spark, sf_dir, "documents"))


def op8_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.grouped(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents"))


def op10_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judged(_table(spark, sf_dir, "pages"))
    return out.withColumns({"strict": F.array_join("strict", ","), "soft": F.array_join("soft", ",")})


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _uniform(seed: int, *cols: str) -> str:
    joined = ", ".join([f"'{seed}'", *[f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols]])
    return f"(CAST('0x' || substr(md5(concat_ws('|', {joined})), 1, 13) AS BIGINT) / 4503599627370496.0)"


OP1_SQL = f"""
WITH s AS (
  SELECT coalesce(source, '') AS src, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM documents GROUP BY 1
), r AS (
  SELECT src, (CASE WHEN chars > 0 THEN 1.0 ELSE 0.0 END / (SELECT sum(CASE WHEN chars > 0 THEN 1.0 ELSE 0.0 END) FROM s))
         * (CAST((SELECT sum(chars) FROM s) AS DOUBLE) / CAST(chars AS DOUBLE)) AS rate
  FROM s WHERE chars > 0
), t AS (
  SELECT src, k, exp(k * ln(rate) - rate - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: ln(i))), 0)) AS p
  FROM (SELECT src, rate, unnest(range(0, CAST(floor(30 + rate + 12 * sqrt(rate)) AS BIGINT) + 1)) AS k FROM r)
), c AS (
  SELECT src, list(cum ORDER BY k) AS cdf FROM (
    SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k ROWS UNBOUNDED PRECEDING) AS cum FROM t) GROUP BY src
), n AS (
  SELECT d.*, len(list_filter(c.cdf, lambda x: x <= {_uniform(42, "d.doc_id")})) AS n
  FROM documents d JOIN c ON coalesce(d.source, '') = c.src
), e AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1)) AS copy_no FROM n WHERE n > 0
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS INTEGER) AS copy_no,
       CAST(floor({_uniform(43, "doc_id", "copy_no")} * 2147483648) AS BIGINT) AS place FROM e
"""


def _url_sql(v: urlfilter.Vocabulary) -> str:
    edge, literal = "[^\\p{L}\\p{N}]", lambda t: "'" + t.replace("'", "''") + "'"

    def weight(t: urlfilter.Term) -> str:
        whole = lambda part: f"regexp_matches({part}, '(^|{edge}){re.escape(t.term)}($|{edge})')"
        host = f"contains(host, {literal(t.term)})" if t.inside else whole("host")
        return f"{{'t': {literal(t.term)}, 'w': greatest(CASE WHEN {host} THEN {t.host}::DOUBLE ELSE 0 END, CASE WHEN {whole('path')} THEN {t.path}::DOUBLE ELSE 0 END)}}"

    shields = "|".join(sorted(v.shields, key=lambda w: (-len(w), w)))
    blank = lambda part: f"regexp_replace({part}, '{shields}', ' ', 'g')" if shields else part
    return f"""
WITH u AS (
  SELECT page_id, url, lower(url_decode(coalesce(url, ''))) AS l FROM pages
), p AS (
  SELECT page_id, url, {blank(f"regexp_extract(l, '{urlfilter.HOST}', 1)")} AS host, {blank(f"substr(l, length(regexp_extract(l, '{urlfilter.HOST}')) + 1)")} AS path FROM u
), w AS (
  SELECT page_id, url, list_filter(list_sort([{", ".join(weight(t) for t in v.terms)}]), lambda x: x.w > 0) AS held FROM p
), s AS (
  SELECT page_id, url, list_transform(list_filter(held, lambda x: x.w >= 1), lambda x: x.t) AS strict, list_transform(list_filter(held, lambda x: x.w < 1), lambda x: x.t) AS soft,
         coalesce(list_sum(list_transform(held, lambda x: x.w)), 0.0)::DOUBLE AS weight FROM w
)
SELECT page_id, url, array_to_string(strict, ',') AS strict, array_to_string(soft, ',') AS soft, weight,
       len(strict) > 0 OR (len(soft) >= {v.soft_needed} AND weight >= 1) AS rejected FROM s
"""


OP10_SQL = _url_sql(urlfilter.load())


def queries() -> dict:
    return {
        "op1_poisson_mix": op1_poisson_mix,
        "op2_itq_near_dups": op2_itq_near_dups,
        "op3_packed_tokens": op3_packed_tokens,
        "op4_hyperdimensional_langid": op4_hyperdimensional_langid,
        "op5_minhash_tensor": op5_minhash_tensor,
        "op6_fm_toxicity": op6_fm_toxicity,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_ctph": op8_ctph,
        "op9_pii": op9_pii,
        "op10_url_vocabulary": op10_url_vocabulary,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_poisson_mix": OP1_SQL, "op10_url_vocabulary": OP10_SQL}
