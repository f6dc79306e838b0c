"""From raw documents to packed sequences: language ID, near-dedup, PII masking, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import langid, minhash, mixing, packing, pii
from sieveline.llm.common import cut, discard, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang becomes what was recognised."""
    return langid.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near copies."""
    return minhash.deduplicated(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by the name of its kind; n_chars follows."""
    return pii.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks, in shuffled order."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences: each piece of each document and copy with its token ids and its place."""
    return packing.packed_ids(docs)


STAGES = [("language_id", language), ("minhash_dedup", near_dedup), ("pii", private_data), ("poisson_mix", mix), ("best_fit_packing", pack)]

#: SQL can't express the trained profiles, the Arrow-side hashing, the token ids or the online packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bin_id, bin_start, doc_id, copy_no, start, length, ids): the ids of the pieces of a bin, in the order of
    bin_start, are a training sequence. What a stage has written is deleted once the next has been."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(cut(stage(spark, docs, sf_dir)))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
