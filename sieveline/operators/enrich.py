"""Index-time enrichment: embeddings, contextual prefixes and captions, through injected models."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..sources.caption_cache import CaptionCache, sha256_hex
from ..sources.shared import light_batches
from .chunking import caption_pages, stitched
from .metrics import first_wins
from .providers import Embed, Vision, backoff_ms, is_retryable, strip

PREFIX_LENGTH = (50, 100)
CAPTION_PROMPT = "Describe this picture from a document for full-text and vector search: what it shows, all readable text and figures, and how its parts relate. Plain prose, no preamble."
MIN_TEXT_CHARS = 90
CONTEXT_SYSTEM = "You place passages within their document. Write {} to {} characters that name the section, topic or position of a passage and make it easier to find by words and by meaning. Do not repeat the passage; no quotes, brackets or Markdown.\n\nThe document:\n"
CONTEXT_USER = "Write the context for this passage and nothing else:\n\n"


def hashing_embedder(dim: int = 64, seed: int = 0) -> Embed:
    """A deterministic embedder without a model: signed hashes of words, as a unit vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float64)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int(sha256_hex(f"{seed}:{w}")[:16], 16)
                out[i, h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32).tolist()

    return embed


@lru_cache(maxsize=8)
def _loaded(load: Callable[[], Any]) -> Any:
    return load()


def loaded(load: Callable[[], Any]) -> Any:
    """What load gives, once in each Python worker; a load that raises is tried again the next time."""
    return _loaded(load)


def embedded(df: DataFrame, load: Callable[[], Embed], text_col: str = "content", batch: int = 32, dim: int | None = None) -> DataFrame:
    """df with embedding, asked in batches of 1 to 256 in the rows' order. A blank text, or a vector of another dim or
    with a number that isn't finite, is an error."""
    if isinstance(batch, bool) or not isinstance(batch, int) or not 1 <= batch <= 256:
        raise ValueError("batch must be a whole number from 1 to 256")
    light_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(load)
        for part in parts:
            texts, out = part.tolist(), []
            if any(not isinstance(t, str) or not strip(t) for t in texts):
                raise ValueError("a text to embed is blank")
            for i in range(0, len(texts), batch):
                out += model(texts[i : i + batch])
            if len(out) != len(texts) or any((dim is not None and len(v) != dim) or not all(map(math.isfinite, v)) for v in out):
                raise ValueError("the embedder must give a finite vector for each text")
            yield pd.Series([[float(x) for x in v] for v in out])

    return df.withColumn("embedding", embed(text_col))


def context_prompts(document: Column, content: Column, least: int = PREFIX_LENGTH[0], most: int = PREFIX_LENGTH[1]) -> Column:
    """{system, user}: the document belongs in the system part, which the chunks of a document share."""
    system = F.concat(F.lit(CONTEXT_SYSTEM.format(least, most)), document)
    user = F.concat(F.lit(CONTEXT_USER), content)
    return F.struct(system.alias("system"), user.alias("user"))


def contextualised(chunks: DataFrame, docs: DataFrame, model: Callable[[str, str, str], str], least: int = PREFIX_LENGTH[0], most: int = PREFIX_LENGTH[1]) -> DataFrame:
    """chunks (doc_id, content) with prefix from model(system, user, cache_key) and stitched content. The chunks of a
    document go to one task one after the other, so a provider's prompt cache can serve them; cache_key is the hash of
    the document. An answer that is no text is an error."""
    if not 10 <= least <= most <= 500:
        raise ValueError("10 <= least <= most <= 500 must hold")
    light_batches(chunks.sparkSession)

    @F.pandas_udf("string")
    def ask(parts: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        for prompts, keys in parts:
            out = [model(s, u, k) for s, u, k in zip(prompts["system"], prompts["user"], keys)]
            if not all(isinstance(x, str) for x in out):
                raise TypeError("the model must give a text")
            yield pd.Series([strip(x) for x in out])

    joined = chunks.join(docs.select("doc_id", F.col("text").alias("_doc")), "doc_id").withColumn("_key", F.sha2("_doc", 256))
    placed = joined.repartition("_key").sortWithinPartitions("_key")
    out = placed.withColumn("prefix", ask(context_prompts(F.col("_doc"), F.col("content"), least, most), F.col("_key")))
    return out.withColumn("content", stitched(F.col("prefix"), F.col("content"))).drop("_doc", "_key")


class VisionCaptionFailed(RuntimeError):
    """A picture got no caption though all must."""


class EmptyAnswer(ValueError):
    """A model answered with nothing; another attempt may help."""


@dataclass(frozen=True)
class CaptionOptions:
    provider_id: str
    model_id: str
    prompt: str = CAPTION_PROMPT
    concurrency: int = 3
    retries: int = 2
    timeout_ms: int = 30_000
    fail_index: bool = False

    def __post_init__(self) -> None:
        for name, low, high in (("concurrency", 1, 32), ("retries", 0, 10), ("timeout_ms", 100, 600_000)):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int) or not low <= v <= high:
                raise ValueError(f"{name} must be a whole number from {low} to {high}")


def caption(vision: Vision, image: bytes, o: CaptionOptions, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(caption, error): tried again after retryable failures, an empty answer among them, with growing pauses. Each
    try may take one and a half times the timeout that the provider itself should keep."""
    for attempt in range(o.retries + 1):
        pool = ThreadPoolExecutor(1)
        try:
            got = pool.submit(vision, image, o.prompt).result(o.timeout_ms * 1.5 / 1000)
            if not isinstance(got, str) or not strip(got):
                raise EmptyAnswer("the model gave no caption")
            return strip(got), None
        except Exception as e:
            if attempt == o.retries or not is_retryable(e):
                return None, str(e) or type(e).__name__
            sleep(backoff_ms(attempt, getattr(e, "retry_after_ms", None)) / 1000)
        finally:
            pool.shutdown(wait=False)
    return None, None


def captioned(images: DataFrame, vision: Vision, o: CaptionOptions, cache: CaptionCache | None = None, order: tuple[str, ...] = ("source", "page", "image_ix")) -> DataFrame:
    """images (source, page, image_ix, image) with caption and section, one chunk a picture; pictures without a caption
    are left out, or fail the job once all are done if fail_index.

    Equal pictures are asked for once, those in the cache not at all; new captions go into the cache.
    """
    key = {"image_sha256": F.sha2("image", 256), "prompt_sha256": F.lit(sha256_hex(o.prompt)), "provider_id": F.lit(o.provider_id), "model_id": F.lit(o.model_id)}
    work = images.withColumns(key)
    names = list(key)
    light_batches(images.sparkSession)
    distinct = first_wins(work, names, list(order)).select(*names, "image")
    todo = cache.misses(distinct) if cache else distinct

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(o.concurrency) as pool:
            for pdf in parts:
                got = list(pool.map(lambda x: caption(vision, bytes(x), o), pdf["image"]))
                yield pdf[names].assign(caption=[c for c, _ in got], error=[e for _, e in got])

    fresh = todo.mapInPandas(run, ", ".join(f"{n} string" for n in names) + ", caption string, error string").persist()
    failed = fresh.where("caption is null").agg(F.count("*"), F.min("error")).first()
    good = fresh.where("caption is not null").select(*names, "caption")
    if cache:
        cache.put(good)
    if failed[0] and o.fail_index:
        raise VisionCaptionFailed(f"{failed[0]} pictures have no caption: {failed[1]}")
    known = good if cache is None else cache.rows().select(*names, "caption")
    section = F.format_string("[图片描述 #%d]", F.col("image_ix")) if "image_ix" in images.columns else F.lit("[图片描述]")
    return work.join(known, names).select(*[c for c in images.columns if c != "image"], section.alias("section"), F.col("caption").alias("content"))


def page_captions(pages: DataFrame, vision: Vision, o: CaptionOptions, cache: CaptionCache | None = None, least_chars: int = MIN_TEXT_CHARS, wanted: Column | None = None) -> DataFrame:
    """captioned() for whole pages (source, page, text, image): those with little text, or those that wanted picks."""
    return captioned(caption_pages(pages, "text", least_chars, wanted).drop("text"), vision, o, cache, ("source", "page"))


def resized(width: Column, height: Column, edge: int = 1568) -> Column:
    """{width, height} of a picture brought down to a longest edge; smaller ones stay."""
    if not 64 <= edge <= 8192:
        raise ValueError("edge must be from 64 to 8192")
    longest = F.greatest(width, height)

    def side(x: Column) -> Column:
        return F.when(longest <= edge, x).otherwise(F.greatest(F.lit(1), F.floor(x * edge / longest + 0.5))).cast("int")

    return F.struct(side(width).alias("width"), side(height).alias("height"))


def with_plugins(text_chunks: DataFrame, pages: DataFrame, plugins: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """text_chunks and the chunks that each plugin makes of the pages."""
    for plugin in plugins:
        text_chunks = text_chunks.unionByName(plugin(pages), allowMissingColumns=True)
    return text_chunks


def populated(df: DataFrame, content_col: str = "content") -> DataFrame:
    """df with error: the code for content that is null or blank, else null."""
    return df.withColumn("error", F.when(is_blank(content_col), "EVAL_CONTENT_MISSING"))
