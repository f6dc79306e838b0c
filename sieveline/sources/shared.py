"""Tables in the folder that all executors share: where lineage is cut, and how such tables are deleted again; how many
rows Python gets at once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where the session names none, a local one if
    there is but this machine, else an error: executors' own disks would lose rows."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="sieveline-"))
    return sc.getCheckpointDir()


#: What cut() has written and not deleted, the newest scratch() last.
_written: list[list[str]] = [[]]


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: later plans start there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing reads it any more."""
    for held in _written:
        if df.cut_path in held:
            held.remove(df.cut_path)
    _delete(df.sparkSession, [df.cut_path])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables cut within are deleted at the end, but for those that the function it gives has been told to keep."""
    _written.append([])
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.cut_path)
        return df

    try:
        yield keep
    finally:
        mine = _written.pop()
        _written[-1].extend(p for p in mine if p in kept)
        _delete(spark, [p for p in mine if p not in kept])


def release(spark: SparkSession, *but: DataFrame) -> None:
    """Deletes all tables that results of this process still stand on, but for those given: call it once the results
    have been written."""
    kept = {df.cut_path for df in but}
    for held in _written:
        _delete(spark, [p for p in held if p not in kept])
        held[:] = [p for p in held if p in kept]


#: Rows and bytes that Spark hands to Python at once, where the session has its default; documents are large rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def light_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default, so that a worker holds a few MB of text, not tens of them."""
    for name, (default, less) in BATCH.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, less)
