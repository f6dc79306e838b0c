"""Connected components, and groups of rows whose likeness is verified pair by pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, id_type, scratch


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and its neighbours. The minimum is aggregated before rows move, and the
    one row a node joins back, so a node with a third of all edges is no task of its own."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("_m")), "u").select("u", "v", F.least("u", "_m").alias("m"))


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the partition's edges (u, v) with the least that these join it to, roots left out."""
    up: dict = {}

    def root(x):
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up[x]
        return top

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    if schema is not None:
        nodes = list(up)
        for i in range(0, len(nodes), 100_000):
            some = nodes[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, schema.field("u").type), pa.array([root(x) for x in some], schema.field("v").type)], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each node of edges (a, b): root is the least id that a path joins it to; roots come too.

    Each partition first brings its own edges down to stars. Then large-star and small-star steps alternate, each a
    grouped minimum, until the edges stay as they are; every round is written to the shared folder, where the last one
    stays. Loops, nulls and repeated edges change nothing; no edges, no rows. Ids are numbers or strings; Python and
    Spark must agree on which of two is less, as they do on these.
    """
    kind = id_type(edges, "a")
    first = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut(first.mapInArrow(contract, f"u {kind}, v {kind}"))
    stamp = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state = stamp(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = _least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = cut(star.select("e.*").where("u <> v").distinct())
        discard(now)
        now, (before, state) = after, (state, stamp(after))
        if before == state:
            break
    out = now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    out.cut_path = now.cut_path
    return out


def links(edges: DataFrame) -> DataFrame:
    """(id, links): of how many distinct edges (a, b) each id is an end."""
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))


def strangers(members: DataFrame, by: list[str]) -> DataFrame:
    """(a, b): pairs of members (*by, id, root) with equal by and different roots, a < b, each once.

    In any such pair one is not of the root that most members have, so these alone are matched with all: a group of
    copies, however large, costs the number of its strangers times its size, never its square.
    """
    counts = members.groupBy(*by, "root").agg(F.count("*").alias("n"))
    main = counts.groupBy(*by).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select(*by, "main")
    mixed = members.join(main, by)
    few = mixed.where("root <> main").select(*by, F.col("id").alias("b"), F.col("root").alias("other"))
    pairs = mixed.select(*by, F.col("id").alias("a"), "root").join(few, by).where("root <> other")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _members(buckets: DataFrame) -> DataFrame:
    """(set, centre, id), each once, of the buckets (key, id) with more than one id; centre is the least. Buckets with
    the same members are one set. What a bucket has is aggregated before rows move, so one that holds a third of all
    rows is no task of its own."""
    shared = cut(buckets.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre <> last").drop("last"))
    live = cut(buckets.join(shared, "key"))
    sets = live.groupBy("key").agg(F.xxhash64(F.min("centre"), F.max("id"), F.sum(F.xxhash64("id").bitwiseAND(0xFFFFFFFFFF))).alias("set"))
    return cut(live.join(sets, "key").select("set", "centre", "id").distinct())


#: Members of a set that are compared with one another at once, and pairs that a task compares, about.
BLOCK = 2000
PAIRS = 1_000_000


def dealt(buckets: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The members (set, centre, id) of the buckets (key, id); their cells (set, i, j, block, id); partitions for these.

    A set's members are dealt to blocks, and each two blocks are a cell, so the pairs of a large set are those of many
    tasks. A cell (i, i) holds the pairs within a block, a cell (i, j) those of one member in each. Call it within a
    scratch().
    """
    members = _members(buckets)
    sizes = cut(members.groupBy("set").agg(F.count("*").alias("n")))
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0
    parts = max(int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs / PAIRS))
    blocks = members.join(sizes, "set").withColumn("k", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.expr("pmod(xxhash64(id), k)"))
    cells = blocks.select("set", "id", "block", F.explode(F.expr("sequence(0L, k - 1)")).alias("j")).select("set", F.least("block", "j").alias("i"), F.greatest("block", "j").alias("j"), "block", "id")
    return members, cells, parts


def mates(buckets: DataFrame, shapes: DataFrame, alike: str) -> DataFrame:
    """(a, b): all pairs of bucket mates for which alike holds, SQL on their shapes x and y; a < b, each once.

    buckets has (key, id), in which rows may repeat, shapes (id, shape) for each id. Unlike verified_edges() it tries
    every pair, so that its rows can be counted; only pairs that hold move between tasks.
    """
    with scratch(buckets.sparkSession) as keep:
        _, cells, parts = dealt(buckets)
        rows = cells.join(shapes, "id").repartition(parts, "set", "i", "j")
        left = rows.select("set", "i", "j", F.col("id").alias("a"), F.col("block").alias("p"), F.col("shape").alias("x"))
        right = rows.select("set", "i", "j", F.col("id").alias("b"), F.col("block").alias("q"), F.col("shape").alias("y"))
        good = left.join(right, ["set", "i", "j"]).where("a < b and (i = j or p <> q)").where(alike)
        return keep(cut(good.select("a", "b").distinct()))


def verified_edges(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Enough verified pairs (a, b) of bucket mates for the components that all of them form.

    buckets has (key, id), in which rows may repeat; verify keeps of pairs (a, b) those alike enough. Exact without
    trying each pair: members are first compared with their bucket's least id; the pairs left are those of members
    that this didn't join, in buckets where some comparison failed.
    """
    with scratch(buckets.sparkSession) as keep:
        members = _members(buckets)
        tried = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
        good = keep(cut(verify(tried)))
        label = components(good)
        failed = members.where("id <> centre").join(good.select(F.col("a").alias("centre"), F.col("b").alias("id")), ["centre", "id"], "left_anti").select("set").distinct()
        rest = cut(members.join(failed, "set", "left_semi").join(label, "id", "left").select("set", "id", F.coalesce("root", "id").alias("root")))
        more = keep(cut(verify(strangers(rest, ["set"]).join(tried, ["a", "b"], "left_anti"))))
    return good.select("a", "b").unionByName(more.select("a", "b"))


def verified_groups(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, root) of the components that verified_edges() form."""
    return components(verified_edges(buckets, verify))
