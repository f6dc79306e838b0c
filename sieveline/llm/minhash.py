"""MinHash near-dedup with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, as_long, chunks, cut, id_type, lists, mix, scratch, small, with_id, word_hashes
from .grouping import components, links, verified_edges

#: Members of a centre that one task compares with it; a larger group is dealt out to several tasks.
MEMBERS = 10_000


@dataclass(frozen=True)
class MinHash:
    """Two collections of `groups` groups with `rows` minhashes each give groups^2 tables of 2 * rows minhashes, out
    of 2 * groups * rows minhashes only. Documents count as near copies if the Jaccard likeness of their sets of
    `words` successive words is at least `threshold`."""

    words: int = 3
    groups: int = 14
    rows: int = 2
    threshold: float = 0.45
    seed: int = 42

    def __post_init__(self) -> None:
        if min(self.words, self.groups, self.rows) < 1 or not 0 < self.threshold <= 1:
            raise ValueError("words, groups and rows must be 1 or more, threshold in (0, 1]")

    def factors(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 1 << 63, 2 * self.groups * self.rows, dtype=U) * U(2) + U(1)


def shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text; how many each text has; two 64-bit hashes of all its words in order.
    A text of fewer words has one run of what it has, one without words has none."""
    h, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    place = np.arange(len(h)) - first[owner]
    keep = (place + n <= count[owner]) | ((place == 0) & (count[owner] > 0))
    padded = np.concatenate([h, np.zeros(n, U)])
    owner_padded = np.concatenate([owner, np.full(n, -1)])
    at = np.flatnonzero(keep)
    out = np.zeros(len(at), U)
    for k in range(n):
        same = owner_padded[at + k] == owner[at]
        out = out * U(0x100000001B3) + np.where(same, padded[at + k], U(k + 1))
    # the whole document: position-dependent sums of its words
    whole = np.zeros((len(texts), 2), U)
    has = np.flatnonzero(count)
    for k, odd in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        if len(has):
            whole[has, k] = np.add.reduceat(mix(h * U(2 * k + 1) + place.astype(U) * U(odd)), first[has])
    return mix(out), np.bincount(owner[at], minlength=len(texts)), whole


def signatures(hashes: np.ndarray, counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minhashes of each text with shingles: the least of each multiplied and shifted hash."""
    starts = np.concatenate([[0], np.cumsum(counts[counts > 0])[:-1]]).astype(np.int64)
    out = np.empty((len(starts), len(factors)), U)
    for k, f in enumerate(factors):
        out[:, k] = np.minimum.reduceat(((hashes * f) >> U(32)).astype(np.uint32), starts)
    return out


def group_keys(sig: np.ndarray, groups: int, rows: int) -> np.ndarray:
    """A key for each group of either collection of each text, the group's place in it."""
    g = sig.reshape(len(sig), 2 * groups, rows)
    h = np.arange(2 * groups, dtype=U)[None].repeat(len(sig), axis=0)
    for k in range(rows):
        h = mix(h * U(0x9E3779B97F4A7C15) + g[:, :, k] + U(1))
    return h


def _sketch(p: MinHash):
    factors = p.factors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            hashes, counts, whole = shingles(texts, p.words)
            has = counts > 0
            if not has.any():
                continue
            keys = group_keys(signatures(hashes, counts, factors), p.groups, p.rows)
            ids = batch.column("id").filter(pa.array(has))
            yield pa.RecordBatch.from_arrays([ids, as_long(whole[has, 0]), as_long(whole[has, 1]), lists(as_long(keys.ravel()), np.full(len(keys), keys.shape[1]))], ["id", "whole", "whole2", "keys"])

    return run


def _sets(p: MinHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            hashes, counts, _ = shingles(texts, p.words)
            owner = np.repeat(np.arange(len(texts)), counts).astype(U)
            both = np.unique((owner << U(32)) | (hashes >> U(32)))
            n = np.bincount((both >> U(32)).astype(np.int64), minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(pa.array((both & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)), n)], ["id", "set"])

    return run


def _compare(threshold: float):
    """Rows sorted by centre with the centre's own first: likeness of each member with it. Only one set is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.int32)
        for batch in batches:
            cs, ms, sets = batch.column("c").to_pylist(), batch.column("m").to_pylist(), batch.column("set")
            offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy()
            a, b, s = [], [], []
            for i, (c, m) in enumerate(zip(cs, ms)):
                x = values[offsets[i] : offsets[i + 1]]
                if c == m:
                    centre, own = c, x.copy()
                elif c == centre:
                    both = np.concatenate([own, x])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    j = common / max(1, len(own) + len(x) - common)
                    if j >= threshold:
                        a.append(c), b.append(m), s.append(j)
            kind = batch.schema.field("c").type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(s, pa.float64())], ["a", "b", "jaccard"])

    return run


def verify_with(rows: DataFrame, p: MinHash):
    """A function that keeps, of pairs (a, b), those whose Jaccard likeness reaches the threshold. The members of a
    centre a are dealt out to tasks of about MEMBERS, each with the centre's own set."""
    kind = id_type(rows, "id")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.select("a", "b"))
        shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("tasks"))
        members = pairs.join(shares, "a").select(F.col("a").alias("c"), F.col("b").alias("m"), F.pmod(F.xxhash64("b"), "tasks").cast("int").alias("task"))
        own = shares.select(F.col("a").alias("c"), F.col("a").alias("m"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
        ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        sets = rows.join(small(ids, ids.count(), 16), "id", "left_semi").mapInArrow(_sets(p), f"id {kind}, set array<int>")
        placed = members.unionByName(own).join(sets.withColumnRenamed("id", "m"), "m").select("c", "task", "m", "set").repartition("c", "task")
        return placed.sortWithinPartitions("c", "task", F.col("m") != F.col("c"), "m").select("c", "m", "set").mapInArrow(_compare(p.threshold), f"a {kind}, b {kind}, jaccard double")

    return verify


def tables(sketches: DataFrame, groups: int) -> DataFrame:
    """(key, id): for each document (id, keys) its entries in the groups^2 tables, whose keys combine one of each
    collection, but for entries that no other document can share. Who shares a table's key shares both halves, so the
    halves, which are few, are counted first, and only those of several documents are combined."""
    halves = sketches.select("id", F.posexplode("keys").alias("at", "half"))
    shared = cut(halves.groupBy("half").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least <> last").select("half"))
    live = halves.join(shared, "half").groupBy("id").agg(F.collect_set(F.when(F.col("at") < groups, F.col("half"))).alias("first"), F.collect_set(F.when(F.col("at") >= groups, F.col("half"))).alias("second"))
    live = cut(live.where("size(first) > 0 and size(second) > 0"))
    return live.select("id", "second", F.explode("first").alias("a")).select("id", "a", F.explode("second").alias("b")).select(F.xxhash64("a", "b").alias("key"), "id")


def duplicates(docs: DataFrame, p: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, duplicate_of, links) for each document that is a near copy of a kept one, the least id of its group.

    Equal word sequences are joined first, by 128-bit hashes. The others meet in the tables, are compared by the exact
    Jaccard likeness of their shingles, and groups are the connected components of those that pass. links is the
    number of such verified links that the search made to the document: each group has enough of them to be whole,
    copies aren't paired with one another. Words are runs of letters and digits without regard to case. Ids may be
    numbers or strings. A null id, null text or text without words is no copy of anything; rows that repeat an id
    count as one document, which is like whatever any of its texts is like; no documents, no rows.
    """
    rows = with_id(docs, id_col, text_col).where("id is not null and text is not null")
    with scratch(docs.sparkSession) as keep:
        sketches = cut(rows.mapInArrow(_sketch(p), f"id {id_type(docs, id_col)}, whole long, whole2 long, keys array<long>"))
        same = cut(sketches.groupBy("whole", "whole2").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a <> last").drop("last"))
        exact = cut(sketches.select("whole", "whole2", F.col("id").alias("b")).join(small(same, same.count(), 32), ["whole", "whole2"]).where("a <> b").select("a", "b"))
        first = small(exact.select(F.col("b").alias("id")).distinct(), exact.count(), 16)
        buckets = tables(sketches.join(first, "id", "left_anti"), p.groups)
        edges = exact.unionByName(verified_edges(buckets, verify_with(rows, p)))
        found = keep(cut(components(edges).where("id <> root").join(links(edges), "id").select(F.col("id").alias(id_col), F.col("root").alias("duplicate_of"), "links")))
    return found


def deduplicated(docs: DataFrame, p: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that duplicates() names, all its columns as they were; rows of null id stay. Of rows
    that repeat an id one stays, that of the least text, a null being the least."""
    own = docs[f"`{id_col}`"]
    gone = duplicates(docs, p, id_col, text_col).select(F.col(id_col).alias("_gone"))
    kept = docs.join(small(gone, gone.count(), 16), own == gone["_gone"], "left_anti")
    again = cut(docs.select(own.alias("_again")).where("_again is not null").groupBy("_again").agg(F.count("*").alias("n")).where("n > 1").select("_again"))
    n = again.count()
    if not n:
        return kept
    again = small(again, n, 16)
    one = kept.join(again, own == again["_again"], "left_semi").select(own.alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    one = one.groupBy("_id").agg(F.min_by("_row", F.struct("_text")).alias("_row")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return kept.join(again, own == again["_again"], "left_anti").unionByName(one)
