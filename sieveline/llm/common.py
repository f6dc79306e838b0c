"""Shared folder, size-checked broadcasts and vectorised text hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, discard, light_batches, release, scratch, shared_folder  # noqa: F401

#: A side is broadcast only when its rows, counted first, fit in this many bytes.
BROADCAST_BYTES = 32 << 20
#: Text bytes that one numpy step handles at once; a longer document is a step of its own.
CHUNK_BYTES = 1 << 19


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit in BROADCAST_BYTES, else df for Spark to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def id_type(df: DataFrame, id_col: str) -> str:
    """The type of the id column, which results keep: numbers, strings and what else Spark can compare."""
    return df.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()


def with_id(df: DataFrame, id_col: str, text_col: str | None = None) -> DataFrame:
    """(id[, text]) of df under these names, for Python to work on; ids keep their type."""
    light_batches(df.sparkSession)
    cols = [F.col(f"`{id_col}`").alias("id")]
    return df.select(*cols, *([F.col(f"`{text_col}`").cast("string").alias("text")] if text_col else []))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about limit bytes of text each, and their texts, where a null is an empty one."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            texts[i] = t = t or ""
            if size and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits of x."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], from prefix sums of a polynomial hash."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


#: Bytes of words: ASCII letters and digits, and all bytes of other letters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts; starts and ends of their words in them; the text of each word."""
    joined = "\0".join([t.replace("\0", " ") for t in texts]).lower() + "\0"
    data = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = WORD[data]
    step = np.diff(inside)
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    stops = np.flatnonzero(data == 0)
    return data, starts, ends, np.searchsorted(stops, starts)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, and its text's place among them."""
    data, starts, ends, owner = words(texts)
    return span_hashes(data, starts, ends), owner


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64))


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list array with counts[i] of the values in row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
