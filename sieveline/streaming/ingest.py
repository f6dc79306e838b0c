"""Continuous ingestion: a stream of documents chunked, embedded and appended to an index batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunked
from ..operators.enrich import embedded
from ..operators.providers import Embed
from ..sources.index import Index


def ingest(stream: DataFrame, index: Index, load: Callable[[], Embed], checkpoint: str, size: int = 1000, overlap: int = 200) -> StreamingQuery:
    """Starts a query that appends the chunks of a stream (source, text). A batch's number is kept in the index's
    manifest, so one that is delivered again after a failure is left out."""

    def append(batch: DataFrame, number: int) -> None:
        if index.manifest.get("stream_batch", -1) >= number:
            return
        chunks = embedded(chunked(batch, size, overlap, id_col="source"), load, "content", dim=index.dim)
        index.manifest["stream_batch"] = number
        try:
            done = index.append(chunks.select("source", "chunk_ix", "section", "content", "embedding"), ["source", "chunk_ix"])
        except BaseException:
            index.manifest["stream_batch"] = number - 1
            raise
        if not done["inserted"]:
            index._save()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
