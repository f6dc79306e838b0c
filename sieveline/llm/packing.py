"""Bounded-space online best-fit packing of documents into fixed-length sequences."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokenpack
from .common import cut, id_type, small

#: Units, with what they carry, in a partition of the shuffle that brings shards together.
PARTITION_UNITS = 1 << 26


@dataclass(frozen=True)
class Packing:
    """capacity units in a sequence; at most open_bins are open at a time. Documents are dealt to shards of about
    shard_units by a hash of their id, text and copy; each shard is one online run, so shards, not executors, decide
    the result."""

    capacity: int = 8192
    open_bins: int = 64
    shard_units: int = 1 << 24
    seed: int = 42

    def __post_init__(self) -> None:
        if min(self.capacity, self.open_bins, self.shard_units) < 1:
            raise ValueError("capacity, open_bins and shard_units must be 1 or more")


class Bins:
    """An online run.

    Bit f of a bitset is set while some open bin has f units free, so the bin with the least sufficient space is the
    lowest set bit from the size upwards; of equal ones the one that came there last. If none fits and open_bins are
    open, the fullest, the lowest set bit of all, closes. A full bin closes at once.
    """

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.free: dict[int, list[int]] = {}
        self.bits = self.count = self.made = 0

    def _take(self, space: int) -> int:
        at = self.free[space].pop()
        if not self.free[space]:
            self.bits ^= 1 << space
        self.count -= 1
        return at

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for the next size, from 1 to capacity."""
        if fit := self.bits >> size:
            space = size + (fit & -fit).bit_length() - 1
            at = self._take(space)
        else:
            if self.count == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            space, at = self.capacity, self.made
            self.made += 1
        left = space - size
        if left:
            self.free.setdefault(left, []).append(at)
            self.bits |= 1 << left
            self.count += 1
        return at, self.capacity - space


def best_fit(sizes: Iterable[int], capacity: int, open_bins: int) -> Iterator[tuple[int, int]]:
    """(bin, offset) for each size from 1 to capacity, in their order."""
    bins = Bins(capacity, open_bins)
    return (bins.place(s) for s in sizes)


def _pack(p: Packing):
    """Places of rows that come sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bins = None, Bins(p.capacity, p.open_bins)
        for batch in batches:
            at = []
            for of, size in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist()):
                if of != shard:
                    shard, bins = of, Bins(p.capacity, p.open_bins)
                b, offset = bins.place(size)
                at.append(((of << 32) + b, offset))
            rest = [c for c in batch.schema.names if c != "shard"]
            columns = [pa.array([x[k] for x in at], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in rest], ["bin_id", "bin_start", *rest])

    return run


def _packed(sized: DataFrame, p: Packing, total: int, bits: int = 0) -> DataFrame:
    """sized has (id, hash g of id and text, units and, if there are bits of each unit, these one after the other as
    data). Only rows that share their g move in order to be numbered."""
    data = bits > 0
    names = [F.col("data")] if data else []
    sized = sized.where("units > 0")
    again = cut(sized.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    again = small(again, again.count(), 16)
    copy = F.row_number().over(Window.partitionBy("g").orderBy("id", "units")).alias("copy_no")
    numbered = sized.join(again, "g", "left_anti").select("id", "g", "units", F.lit(1).alias("copy_no"), *names)
    numbered = numbered.unionByName(sized.join(again, "g", "left_semi").select("id", "g", "units", copy, *names))
    order = F.xxhash64(F.lit(p.seed), "g", "copy_no").alias("order")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1, F.lit(p.capacity).cast("long"))).alias("start")
    shards = max(1, math.ceil(total / p.shard_units))
    pieces = numbered.select("id", "copy_no", "units", order, starts, *names)
    length = F.least(F.col("units") - F.col("start"), F.lit(p.capacity).cast("long"))
    ids = [F.substring(F.col("data"), (F.col("start") * bits / 8).cast("int") + 1, F.ceil(length * bits / 8).cast("int")).alias("ids")] if data else []
    pieces = pieces.select(F.pmod("order", F.lit(shards)).cast("long").alias("shard"), "order", "id", "copy_no", "start", length.alias("length"), *ids)
    n = max(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PARTITION_UNITS))
    n = min(n, shards)
    pieces = pieces.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions("shard", "order", "id", "copy_no", "start").drop("order")
    kind = id_type(pieces, "id")
    return pieces.mapInArrow(_pack(p), f"bin_id long, bin_start long, id {kind}, copy_no int, start long, length long" + ", ids binary" * data)


def packed(docs: DataFrame, p: Packing = Packing(), units: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin_id, bin_start, id_col, copy_no, start, length): where each piece of each document lies.

    units is the length of a document, by default the UTF-8 bytes of its text and one for the end mark. A document
    longer than capacity is cut into pieces of capacity and a rest; nothing is dropped. The online order is that of a
    hash of id, text and copy_no, which numbers rows with equal ids and texts, so that copies scatter. Null texts count
    as empty ones, which have the end mark only; with units of 0 or null a document has no pieces. Rows that repeat an
    id are packed one by one; a null id is packed like any other; ids may be numbers or strings.
    """
    text = F.col(f"`{text_col}`").cast("string")
    units = F.coalesce(units.cast("long"), F.lit(0)) if units is not None else F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    sized = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("g"), units.cast("long").alias("units"))
    return _packed(sized, p, sized.agg(F.sum("units")).first()[0] or 0).withColumnRenamed("id", id_col)


def packed_ids(docs: DataFrame, p: Packing = Packing(), tokenizer: str = tokenpack.TOKENIZER, vocabulary: int = tokenpack.VOCABULARY, end: int = tokenpack.END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """packed() with token ids as units, and the ids themselves in column ids, width(vocabulary) bits each: the pieces
    of a bin in the order of bin_start are the sequence. Each document ends with the id end. The capacity has to be a
    multiple of 8. A document's tokens are kept in the shared folder while it is packed."""
    if p.capacity % 8:
        raise ValueError("capacity must be a multiple of 8")
    whole = tokenpack.packed_tokens(docs, tokenizer, vocabulary, 1 << 30, id_col, text_col, end)
    sized = cut(whole.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), "packed").alias("g"), F.col("n_tokens").alias("units"), F.col("packed").alias("data")))
    return _packed(sized, p, sized.agg(F.sum("units")).first()[0] or 0, tokenpack.width(vocabulary)).withColumnRenamed("id", id_col)
