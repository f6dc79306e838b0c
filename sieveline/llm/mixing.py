"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

#: Copies of a document that a source may ask for on average; more are taken for a mistake in the weights.
MOST_RATE = 1e9
#: Copies that one array holds.
RUN = 10_000
#: Characters in a partition of the shuffled mixture.
PARTITION_CHARS = 128 << 20


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the seed and the columns; nulls count as empty."""
    joined = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_table(rate: float) -> tuple[int, np.ndarray]:
    """(first, cdf): the distribution function of Poisson(rate) at first, first + 1, ..., within 30 and 12 standard
    deviations of the mean, beyond which it has less than what a double can tell from 0 or 1."""
    reach = 30 + 12 * math.sqrt(rate)
    first = max(0, math.floor(rate - reach))
    k = np.arange(first + 1, math.floor(rate + reach) + 1, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(math.log(rate) - np.log(k))])
    mass = np.exp(logs - logs.max())
    cdf = np.cumsum(mass)
    return first, cdf / cdf[-1]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, rate in enumerate(batch.column("rate").to_pylist()):
            first, cdf = poisson_table(rate)
            yield pa.RecordBatch.from_arrays([batch.column("source").slice(i, 1), pa.array([first], pa.int64()), pa.array([cdf], pa.list_(pa.float64()))], ["_source", "_first", "_cdf"])


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, chars, rate): how often a document of the source has to come on average.

    A source's share of the characters is its weight over the weights of the sources that occur; weights None gives
    all sources the same. budget is the size of the mixture over that of the corpus. A source that weights lacks, or
    one without characters, has rate 0.
    """
    if not budget > 0 or not math.isfinite(budget):
        raise ValueError("budget must be a positive number")
    if weights is not None and (not weights or any(not w >= 0 or not math.isfinite(w) for w in weights.values())):
        raise ValueError("weights must be finite and 0 or more")
    sizes = docs.groupBy(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source")).agg(F.coalesce(F.sum(F.length(F.col(f"`{text_col}`").cast("string"))), F.lit(0)).cast("long").alias("chars"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.when(F.col("chars") > 0, 1.0).otherwise(0.0))
    else:
        given = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "source string, weight double")
        weighed = sizes.join(F.broadcast(given), "source", "left").withColumn("weight", F.when(F.col("chars") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    total = weighed.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    share = F.try_divide(F.col("weight"), F.col("all_weight"))
    return weighed.crossJoin(F.broadcast(total)).select("source", "chars", F.coalesce(F.lit(float(budget)) * share * F.try_divide(F.col("all_chars").cast("double"), F.col("chars").cast("double")), F.lit(0.0)).alias("rate"))


def _copies(docs: DataFrame, weights: Mapping[str, float] | None, budget: float, seed: int, id_col: str, source_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(_row, _copy, _place): each row of docs as a struct, so that no column of its can clash with others; and about
    how many characters the copies have."""
    known = cut(rates(docs, weights, budget, source_col, text_col))
    chars, most = known.agg(F.sum(F.col("chars") * F.col("rate")), F.max("rate")).first()
    if (most or 0) > MOST_RATE:
        raise ValueError(f"a source would come {most:.3g} times over, more than {MOST_RATE}")
    table = cut(known.where("rate > 0").mapInArrow(_tables, "_source string, _first long, _cdf array<double>"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("_source"))
    width = table.agg(F.sum(F.size("_cdf") * 8 + 64)).first()[0] or 0
    joined = held.join(small(table, 1, width), "_source").withColumn("_u", uniform(seed, F.col("_id")))
    counted = joined.select("_row", "_id", (F.col("_first") + F.expr("size(filter(_cdf, c -> c <= _u))")).alias("_n")).where("_n > 0")
    # runs of copies, then the copies of each: no array is longer than RUN however often a row comes
    runs = counted.select("_row", "_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))).alias("_run"))
    copies = runs.select("_row", "_id", F.explode(F.sequence((F.col("_run") * RUN + 1).cast("int"), F.least((F.col("_run") + 1) * RUN, F.col("_n")).cast("int"))).alias("_copy"))
    return copies.select("_row", "_copy", F.floor(uniform(seed + 1, F.col("_id"), F.col("_copy")) * F.lit(float(1 << 31))).cast("long").alias("_place")), int(chars or 0)


def replicated(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: float = 1.0, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row as often as its Poisson count says, and two columns more: _copy and _place.

    The count inverts the distribution of Poisson(rate of the source) at a uniform number hashed from seed and id,
    so it doesn't depend on partitions, order or other documents' ids. _place is a 31-bit hash of seed, id and copy;
    rows sorted by it are globally shuffled. A null source is the source ''. Rows that repeat an id get the same
    count and places; all null ids hash as one. Null texts have no characters but come at their source's rate. If
    docs has a column of a new one's name, the new one takes its place. A rate above MOST_RATE is a ValueError. Ids may
    be numbers or strings. No documents, no rows.
    """
    names = [c for c in docs.columns if c.lower() not in ("_copy", "_place")]
    return _copies(docs, weights, budget, seed, id_col, source_col, text_col)[0].select(*[F.col("_row").getField(c).alias(c) for c in names], "_copy", "_place")


def shuffled(df: DataFrame, partitions: int | None = None, chars: int = 0) -> DataFrame:
    """df in the order of _place: it is uniform, so equal ranges of it make equal partitions without sampling. Without
    partitions there are spark.sql.shuffle.partitions, or more so that none has above PARTITION_CHARS of the chars."""
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / PARTITION_CHARS))
    return df.repartitionById(n, F.floor(F.col("_place") * n / F.lit(float(1 << 31))).cast("int")).sortWithinPartitions("_place", "_copy")


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: float = 1.0, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """The mixture of replicated() in its shuffled order, with the columns of docs and those of _copy and _place that
    more names."""
    copies, chars = _copies(docs, weights, budget, seed, id_col, source_col, text_col)
    names = [c for c in docs.columns if c.lower() not in more]
    return shuffled(copies, chars=chars).select(*[F.col("_row").getField(c).alias(c) for c in names], *more)
