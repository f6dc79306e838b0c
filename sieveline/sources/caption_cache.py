"""The caption cache: Parquet keyed by image, prompt, provider and model."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["image_sha256", "prompt_sha256", "provider_id", "model_id"]
SCHEMA = "image_sha256 string, prompt_sha256 string, provider_id string, model_id string, caption string, created_at string"


def sha256_hex(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


class CaptionCache:
    """Appends are new files; of several captions of a key the latest counts. A closed cache refuses all."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.closed = spark, path.rstrip("/"), False

    def _check(self) -> None:
        if self.closed:
            raise ValueError("the caption cache is closed")

    def rows(self) -> DataFrame:
        self._check()
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path)
        held = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)
        return held.groupBy(*KEY).agg(F.max_by("caption", "created_at").alias("caption"), F.max("created_at").alias("created_at"))

    def misses(self, work: DataFrame) -> DataFrame:
        """The rows of work whose key has no caption."""
        return work.join(self.rows().select(*KEY), KEY, "left_anti")

    def hits(self, work: DataFrame) -> DataFrame:
        return work.join(self.rows().select(*KEY, "caption"), KEY)

    def put(self, captions: DataFrame) -> None:
        self._check()
        stamped = captions.select(*KEY, "caption", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"))
        stamped.write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def close(self) -> None:
        self.closed = True
