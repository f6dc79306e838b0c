"""Token ids in the fewest bits that the vocabulary needs, in blocks that numpy unpacks at once."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, id_type, lists, with_id

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words of letters with a space before them, numbers, other signs and white space, as byte-level BPE splits them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = 50257
#: The id that ends a document, the only special one of this vocabulary.
END = 50256


def width(vocabulary: int) -> int:
    """Bits of the largest id, 1 at least."""
    if vocabulary < 1:
        raise ValueError("vocabulary must be 1 or more")
    return max(1, (vocabulary - 1).bit_length())


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("packed", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids one after the other, most significant bit first, filled up to a byte."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype({8: ">u1", 16: ">u2", 32: ">u4"}[bits]).tobytes()
    octets = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(octets, axis=1)[:, 32 - bits :].ravel()).tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first count ids of what pack() made."""
    raw = np.frombuffer(data, np.uint8)
    if bits in (8, 16, 32):
        return np.frombuffer(data, {8: ">u1", 16: ">u2", 32: ">u4"}[bits], count).astype(np.uint32)
    each = np.zeros((count, 32), np.uint8)
    each[:, 32 - bits :] = np.unpackbits(raw, count=count * bits).reshape(count, bits)
    return np.packbits(each, axis=1).view(">u4").ravel().astype(np.uint32)


def pack_blocks(ids: np.ndarray, bits: int, block: int) -> tuple[bytes, np.ndarray]:
    """Blocks of block ids (fewer in the last), each from a byte of its own, and where each begins; the end is last."""
    parts = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    return b"".join(parts), np.cumsum([0, *map(len, parts)]).astype(np.int32)


def read(data: bytes, offsets, n: int, bits: int, block: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """ids[start:stop] of n, unpacking only the blocks that hold them."""
    start, stop, _ = slice(start, stop).indices(n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first, last = start // block, (stop - 1) // block
    got = [unpack(data[offsets[b] : offsets[b + 1]], bits, min(block, n - b * block)) for b in range(first, last + 1)]
    return np.concatenate(got)[start - first * block : stop - first * block]


def _encode(path: str, bits: int, block: int, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_to_numpy
        for batch, texts in chunks(batches):
            n, data, offsets = [], [], []
            for t in texts:
                ids = encode(t, disallowed_special=())
                if end is not None:
                    ids = np.append(ids, np.uint32(end))
                packed, at = pack_blocks(ids, bits, block)
                n.append(len(ids)), data.append(packed), offsets.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), lists(pa.array(np.concatenate(offsets)), np.array([len(x) for x in offsets])), pa.array(data, pa.binary())], ["id", "n_tokens", "offsets", "packed"])

    return run


def packed_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, vocabulary: int = VOCABULARY, block: int = 1024, id_col: str = "doc_id", text_col: str = "text", end: int | None = None) -> DataFrame:
    """(id_col, n_tokens, offsets, packed) of each row: its token ids in width(vocabulary) bits each.

    The text is split and merged as the byte-level BPE of the vocabulary file does; strings of special tokens are
    ordinary text. If end is given, it follows the ids of each document. Block b lies in
    packed[offsets[b]:offsets[b + 1]]. Null and empty texts have no tokens but the end, offsets [0] and no bytes if
    that is none. Null and repeated ids, numbers or strings, are carried along, row by row. tokenizer is a path that
    all executors can read: of a shared file, or of one that SparkContext.addFile() has sent to them.
    """
    if block < 1:
        raise ValueError("block must be 1 or more")
    schema = f"id {id_type(docs, id_col)}, n_tokens long, offsets array<int>, packed binary"
    return with_id(docs, id_col, text_col).mapInArrow(_encode(tokenizer, width(vocabulary), block, end), schema).withColumnRenamed("id", id_col)
