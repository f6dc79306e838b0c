"""Context-triggered piecewise hashing: fingerprints and their comparison by edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, as_long, chunks, cut, id_type, lists, mix, powers, scratch, with_id
from .grouping import components, contract, dealt, mates

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Bytes that decide whether a chunk ends.
WINDOW = 7
#: Signs that two signatures must share in a row to be alike at all.
RUN = 7


@dataclass(frozen=True)
class Fingerprints:
    """A signature has at most `chunks` signs. Two fingerprints are alike if their score is at least `threshold`;
    candidates share any run of RUN signs of a signature."""

    chunks: int = 64
    threshold: int = 70

    def __post_init__(self) -> None:
        if self.chunks < RUN or not 0 < self.threshold <= 100:
            raise ValueError(f"chunks must be {RUN} or more, threshold in 1..100")


def signatures(texts: list[str], most: int) -> tuple[np.ndarray, list[str], list[str]]:
    """Each text's level, its signature there and that at the next level.

    A chunk of level k ends where the low k bits of the hash of the last WINDOW bytes are all 1, on average every
    2^k bytes, and at the end of the text. The level is the least at which there are at most `most` chunks; each
    gives the sign for 6 bits of its own hash. An empty text is at level 0 with empty signatures.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    gap = b"\0" * WINDOW
    data = np.frombuffer(gap + gap.join(raw) + gap, np.uint8)
    size = np.array([len(r) for r in raw], np.int64)
    begin = WINDOW + np.concatenate([[0], np.cumsum(size + WINDOW)[:-1]]).astype(np.int64)
    last = begin + size
    window = np.zeros(len(data) - WINDOW, np.uint32)
    for k in range(WINDOW):
        window += data[k + 1 : k + 1 + len(window)].astype(np.uint32) * np.uint32(pow(0x01000193, WINDOW - k, 1 << 32))
    window ^= window >> np.uint32(15)
    window *= np.uint32(0x2C1B3C6D)
    window ^= window >> np.uint32(12)
    n = len(texts)
    owner = np.repeat(np.arange(n), size)
    at = np.arange(len(owner)) + (begin - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64))[owner]
    bits = window[at - WINDOW]
    # the last byte always ends a chunk
    inner = at + 1 < last[owner]
    at, owner, bits = at[inner], owner[inner], bits[inner]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=sums[1:])
    level = np.full(n, -1)
    out: list[list[str]] = [[""] * n, [""] * n]
    k = 0
    while True:
        fits = np.bincount(owner, minlength=n) + (size > 0) <= most
        now, then = (level < 0) & fits, (level >= 0) & (level == k - 1)
        level[now] = k
        for which, pick in ((0, now), (1, then)):
            mine = pick & (size > 0)
            if mine.any():
                inside = mine[owner]
                ends = np.concatenate([at[inside] + 1, last[mine]])
                of = np.concatenate([owner[inside], np.flatnonzero(mine)])
                order = np.lexsort((ends, of))
                ends, of = ends[order], of[order]
                starts = np.concatenate([[0], ends[:-1]])
                fresh = np.concatenate([[True], of[1:] != of[:-1]])
                starts[fresh] = begin[of[fresh]]
                signs = ALPHABET[(mix((sums[ends] - sums[starts]) * down[starts]) >> U(58)).astype(np.int64)].tobytes().decode()
                bounds = np.append(np.flatnonzero(fresh), len(of))
                for j, d in enumerate(np.flatnonzero(mine)):
                    out[which][d] = signs[bounds[j] : bounds[j + 1]]
        if ((level >= 0) & (level < k)).all():
            return level, out[0], out[1]
        stay = (bits >> np.uint32(k)) & np.uint32(1) == 1
        stay &= (level[owner] < 0) | (level[owner] == k)
        at, owner, bits = at[stay], owner[stay], bits[stay]
        k += 1


def runs(levels: np.ndarray, first: list[str], second: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the distinct keys of its two signatures, and how many: their level and each run of RUN signs
    there; a shorter signature is one run, an empty one has none."""
    n = len(levels)
    text = [s for pair in zip(first, second) for s in pair]
    level = np.repeat(levels, 2) + np.tile([0, 1], n)
    padded = "".join([s + " " * max(0, RUN - len(s)) for s in text if s])
    has = np.array([bool(s) for s in text])
    if not has.any():
        return np.zeros(0, U), np.zeros(n, np.int64)
    size = np.array([max(RUN, len(s)) for s in text])[has]
    raw = np.frombuffer(padded.encode(), np.uint8).astype(U)
    stop = np.cumsum(size)
    grams = np.zeros(len(raw) - RUN + 1, U)
    for k in range(RUN):
        grams = grams * U(257) + raw[k : k + len(grams)]
    owner = np.repeat(np.arange(len(size)), size)[: len(grams)]
    ok = np.arange(len(grams)) + RUN <= stop[owner]
    owner = owner[ok]
    keys = mix(grams[ok] + level[has][owner].astype(U) * U(0xD6E8FEB86659FD93))
    of = np.flatnonzero(has)[owner] // 2
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])
    return keys[fresh], np.bincount(of[fresh], minlength=n)


#: How often a sign occurs is told apart up to this.
TIMES = 3
SHAPE = "struct<level:int,sig:string,sig2:string,n:int,n2:int,signs:array<long>,signs2:array<long>>"


def masks(signatures: list[str]) -> np.ndarray:
    """For each signature TIMES sets of signs as bits: those that occur once and more, twice and more, ..."""
    place = np.zeros(256, np.int64)
    place[ALPHABET] = np.arange(64)
    size = np.array([len(s) for s in signatures], np.int64)
    sign = place[np.frombuffer("".join(signatures).encode(), np.uint8)]
    counts = np.bincount(np.repeat(np.arange(len(size)), size) * 64 + sign, minlength=64 * len(size)).reshape(-1, 64)
    return np.stack([np.packbits(counts >= k, axis=1).view(">u8").ravel().astype(U) for k in range(1, TIMES + 1)], axis=1)


def _sign(p: Fingerprints):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            level, first, second = signatures(texts, p.chunks)
            columns = [batch.column("id"), pa.array(level.astype(np.int32)), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "level", "sig", "sig2"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        level = batch.column("level").to_numpy()
        keys, n = runs(level, batch.column("sig").to_pylist(), batch.column("sig2").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists(as_long(keys), n)], ["id", "keys"])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [batch.column(c).to_pylist() for c in ("sig", "sig2")]
        size = [pa.array([len(s) for s in x], pa.int32()) for x in both]
        signs = [lists(as_long(masks(x).ravel()), np.full(len(x), TIMES)) for x in both]
        shape = pa.StructArray.from_arrays([*[batch.column(c) for c in ("level", "sig", "sig2")], *size, *signs], ["level", "sig", "sig2", "n", "n2", "signs", "signs2"])
        yield pa.RecordBatch.from_arrays([batch.column("id"), shape], ["id", "shape"])


def fingerprints(docs: DataFrame, p: Fingerprints = Fingerprints(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, level, sig, sig2) of each row, from its whole text. Null and empty texts are at level 0 with empty
    signatures; null and repeated ids go row by row."""
    schema = f"id {id_type(docs, id_col)}, level int, sig string, sig2 string"
    return with_id(docs, id_col, text_col).mapInArrow(_sign(p), schema).withColumnRenamed("id", id_col)


def _best(a: str, b: str, one) -> list[str]:
    """one(x, y, same) of the signatures, "" or "2", of a and b that are at a common level, with SQL for when."""
    return [one("", "", f"{a}.level = {b}.level"), one("2", "2", f"{a}.level = {b}.level"), one("2", "", f"{a}.level + 1 = {b}.level"), one("", "2", f"{a}.level = {b}.level + 1")]


def score(a: str, b: str, least: int = 1) -> str:
    """SQL for the score of two structs (level, sig, sig2): 100 for equal signatures down to 0, the best of those at
    a common level. Signatures of fewer than RUN signs have to be equal; empty ones are like nothing. A score below
    least may come out as 0, as edits are no longer counted beyond what it allows."""

    def one(i: str, j: str, same: str) -> str:
        x, y = f"{a}.sig{i}", f"{b}.sig{j}"
        longest = f"greatest(length({x}), length({y}))"
        # -1 edits: more than allowed
        far = f"levenshtein({x}, {y}, CAST(floor({100 - least} * {longest} / 100.0) AS INT))"
        alike = f"CASE WHEN {x} = {y} THEN 100 WHEN least(length({x}), length({y})) < {RUN} THEN 0 WHEN {far} < 0 THEN 0 ELSE CAST(floor(100 - 100.0 * {far} / {longest}) AS INT) END"
        return f"CASE WHEN {same} AND {x} <> '' AND {y} <> '' THEN {alike} ELSE 0 END"

    return f"greatest({', '.join(_best(a, b, one))})"


def may_score(a: str, b: str, threshold: int) -> str:
    """SQL on two shapes (level, sig, sig2, n, n2, signs, signs2) that is false only if score() stays below
    threshold: each edit changes a length by 1 at most, and brings at most one sign that the other signature lacks."""

    def one(i: str, j: str, same: str) -> str:
        most = f"{100 - threshold} * greatest({a}.n{i}, {b}.n{j})"
        lacks = [" + ".join(f"bit_count({x}.signs{k}[{t}] & ~{y}.signs{m}[{t}])" for t in range(TIMES)) for x, k, y, m in ((a, i, b, j), (b, j, a, i))]
        return f"({same} AND 100 * abs({a}.n{i} - {b}.n{j}) <= {most} AND 100 * ({lacks[0]}) <= {most} AND 100 * ({lacks[1]}) <= {most})"

    return f"({' OR '.join(_best(a, b, one))})"


#: Signs of the longest signatures whose edits are counted in the bits of one number; longer ones are left to Spark.
BITS = 64
#: Pairs of which one numpy step counts the edits, and of which one holds the places.
STEP = 8192
GRID = 1 << 20


class Strings:
    """The two signatures of each row, at the places 2 * row and 2 * row + 1, ready to be compared."""

    def __init__(self, first: list[str], second: list[str]) -> None:
        text = [s for pair in zip(first, second) for s in pair]
        place = np.zeros(256, np.uint8)
        place[ALPHABET] = np.arange(64)
        self.size = np.array([len(s) for s in text], np.int32)
        self.masks = masks(text)
        signs = place[np.frombuffer("".join(text).encode(), np.uint8)]
        row = np.repeat(np.arange(len(text)), self.size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        #: By place in the signature and string, so a step over many strings reads one line.
        self.signs = np.zeros((max(1, self.size.max(initial=0)), len(text)), np.int64)
        self.signs[at, row] = signs
        #: For each string and sign the places, as bits, where it occurs.
        self.where = np.zeros(len(text) * 64, U)
        np.bitwise_or.at(self.where, row * 64 + signs, U(1) << at.astype(U))

    def edits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The edit distance of each two strings, neither of them empty: the columns of the usual table, as sets of the
        places where they rise and fall, one column a step for all pairs that still have one."""
        out = np.zeros(len(x), np.int32)
        order = np.argsort(-self.size[y], kind="stable")
        for lo in range(0, len(x), STEP):
            some = order[lo : lo + STEP]
            base, col = x[some] * 64, y[some]
            size = self.size[col]
            up, down = np.full(len(some), ~U(0)), np.zeros(len(some), U)
            for j in range(int(size[0])):
                n = int(np.searchsorted(-size, -j, "left"))  # size is falling: these have a sign at j
                p, m = up[:n], down[:n]
                eq = self.where[base[:n] + self.signs[j, col[:n]]]
                eq |= m
                d = eq & p
                d += p
                d ^= p
                d |= eq
                rise = d | p
                np.invert(rise, out=rise)
                rise |= m
                fall = d & p
                rise <<= U(1)
                rise |= U(1)
                np.bitwise_and(rise, d, out=m)
                rise |= d
                np.invert(rise, out=rise)
                fall <<= U(1)
                np.bitwise_or(fall, rise, out=p)
            full = self.size[x[some]].astype(U)
            inside = np.where(full >= U(64), ~U(0), (U(1) << (full & U(63))) - U(1))
            out[some] = size + np.bitwise_count(up & inside).astype(np.int32) - np.bitwise_count(down & inside)
        return out

    def alike(self, x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
        """Whether the score of each two strings of one level reaches the threshold; see score() and may_score()."""
        out = np.zeros(len(x), bool)
        n, m = self.size[x], self.size[y]
        most = (100 - threshold) * np.maximum(n, m)
        k = np.flatnonzero((n > 0) & (m > 0) & (100 * np.abs(n - m) <= most))
        for one, other in ((x, y), (y, x)):
            lacks = sum(np.bitwise_count(self.masks[one[k], t] & ~self.masks[other[k], t]).astype(np.int32) for t in range(TIMES))
            k = k[100 * lacks <= most[k]]
        d = self.edits(x[k], y[k])
        out[k] = (d == 0) | ((np.minimum(n, m)[k] >= RUN) & (100 * d <= most[k]))
        return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of rows sorted by (set, i, j), cut anew so that no cell is parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("set", "i", "j")])
        fresh = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("set", "i", "j")):
            fresh = np.concatenate([[0], fresh])
        if len(fresh):
            last = int(fresh[-1])
            if done := [*held, *([batch.slice(0, last)] if last else [])]:
                yield pa.Table.from_batches(done)
            held = []
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _tried(own: int, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Of a cell's rows a and b, by their lists of sets, which pairs share a set less than own, so are compared there."""
    if len(sets) == 2 and len(a) == 2:
        return np.full((2, 2), min(set(sets[0].tolist()) & set(sets[1].tolist())) < own)
    size = np.array([len(s) for s in sets])
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    less = flat < own
    flat, of = flat[less], of[less]
    if not len(flat):
        return None
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    bounds = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1, [len(flat)]])
    out = np.zeros((len(a), len(b)), bool)
    at = [np.full(len(sets), -1), np.full(len(sets), -1)]
    at[0][a], at[1][b] = np.arange(len(a)), np.arange(len(b))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo > 1:
            left, right = at[0][of[lo:hi]], at[1][of[lo:hi]]
            out[left[left >= 0][:, None], right[right >= 0]] = True
    return out


def _candidates(table: pa.Table, level: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same cell at levels that can be compared, each pair of ids in the least set they share."""
    own, i, j, block = (table.column(c).to_numpy() for c in ("set", "i", "j", "block"))
    lists_ = table.column("sets").combine_chunks()
    flat, offsets = lists_.flatten().to_numpy(), lists_.offsets.to_numpy() - lists_.offsets[0].as_py()
    bounds = [0, *(np.flatnonzero((own[1:] != own[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(own)]
    some: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        same = i[lo] == j[lo]
        a = np.arange(hi - lo) if same else np.flatnonzero(block[lo:hi] == i[lo])
        b = a if same else np.flatnonzero(block[lo:hi] == j[lo])
        if not len(a) or not len(b) or hi - lo < 2:
            continue
        tried = _tried(own[lo], [flat[offsets[r] : offsets[r + 1]] for r in range(lo, hi)], a, b)
        step = max(1, GRID // len(b))
        for at in range(0, len(a), step):
            ok = np.abs(level[lo + a[at : at + step], None] - level[None, lo + b]) <= 1
            if tried is not None:
                ok &= ~tried[at : at + step]
            if same:
                ok &= a[at : at + step, None] < b[None]
            x, y = np.nonzero(ok)
            some.append((lo + a[at + x], lo + b[y]))
            held += len(x)
            if held >= GRID:
                yield tuple(map(np.concatenate, zip(*some)))
                some, held = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*some)))


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the places below n that the pairs (a, b) join each place to."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _compare(p: Fingerprints):
    """Rows of cells (set, i, j, block, id, level, sig, sig2, n, sets), sorted by cell, to (u, near), the n of the rows
    that one row's fingerprint is like, and (u, v), pairs that join what is alike. Neither grows with the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            level, count, ids = (table.column(c).to_numpy() for c in ("level", "n", "id"))
            strings = Strings(table.column("sig").to_pylist(), table.column("sig2").to_pylist())
            near, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for a, b in _candidates(table, level):
                good = np.zeros(len(a), bool)
                for x, y, apart in ((0, 0, 0), (1, 1, 0), (1, 0, 1), (0, 1, -1)):
                    k = np.flatnonzero(~good & (level[b] - level[a] == apart))
                    good[k] = strings.alike(2 * a[k] + x, 2 * b[k] + y, p.threshold)
                a, b = a[good], b[good]
                np.add.at(near, a, count[b])
                np.add.at(near, b, count[a])
                places = np.flatnonzero(root != np.arange(len(root)))
                root = _joined(len(root), np.concatenate([a, places]), np.concatenate([b, root[places]]))
            some, tied = np.flatnonzero(near), np.flatnonzero(root != np.arange(len(root)))
            gap = lambda n: pa.nulls(n, pa.int64())
            for u, v, w in ((ids[some], gap(len(some)), pa.array(near[some])), (ids[tied], pa.array(ids[root[tied]]), gap(len(tied)))):
                yield pa.RecordBatch.from_arrays([pa.array(u), v, w], ["u", "v", "near"])

    return run


def _by_numpy(kinds: DataFrame, buckets: DataFrame, p: Fingerprints) -> tuple[DataFrame, DataFrame]:
    with scratch(kinds.sparkSession) as keep:
        members, cells, parts = dealt(buckets)
        rows = kinds.select(F.col("no").alias("id"), "level", "sig", "sig2", "n").join(members.groupBy("id").agg(F.collect_list("set").alias("sets")), "id")
        placed = cells.join(rows, "id").select("set", "i", "j", "block", "id", "level", "sig", "sig2", "n", "sets").repartition(parts, "set", "i", "j").sortWithinPartitions("set", "i", "j")
        found = keep(cut(placed.mapInArrow(_compare(p), "u long, v long, near long")))
    return found.where("v is null").groupBy(F.col("u").alias("no")).agg(F.sum("near").alias("near")), found.where("v is not null").select("u", "v")


def _by_spark(kinds: DataFrame, buckets: DataFrame, p: Fingerprints) -> tuple[DataFrame, DataFrame]:
    shapes = kinds.select(F.col("no").alias("id"), "level", "sig", "sig2").mapInArrow(_shapes, f"id long, shape {SHAPE}")
    pairs = mates(buckets, shapes, f"{may_score('x', 'y', p.threshold)} and {score('x', 'y', p.threshold)} >= {p.threshold}")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("other")), F.struct(F.col("b").alias("no"), F.col("a").alias("other")))).alias("e")).select("e.*")
    near = ends.join(kinds.select(F.col("no").alias("other"), "n"), "other").groupBy("no").agg(F.sum("n").alias("near"))
    return near, pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))


def alike(kinds: DataFrame, p: Fingerprints) -> tuple[DataFrame, DataFrame]:
    """Of distinct fingerprints (no, level, sig, sig2, n): (no, near), the sum of the n of those that each is like, and
    pairs (u, v) that join all that are alike. All mates of a bucket are compared; signatures of up to BITS signs in
    numpy, where no pair becomes a row."""
    buckets = kinds.select(F.col("no").alias("id"), "level", "sig", "sig2").mapInArrow(_keys, "id long, keys array<long>").select(F.explode("keys").alias("key"), "id")
    return (_by_numpy if p.chunks <= BITS else _by_spark)(kinds, buckets, p)


def grouped(docs: DataFrame, p: Fingerprints = Fingerprints(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprints() with group_id, the least id among the documents that alike fingerprints link, and links, the
    number of other documents that the row's fingerprint is like: all of them, not only those that hold the group
    together.

    Alike are equal fingerprints, and those whose score reaches the threshold and which share a run of RUN signs, of
    which all are tried. Copies aren't made into pairs: what is linked are the distinct fingerprints, and each counts
    with its ids. A document like no other is its own group without links, as are those with empty texts; a null id has
    no group and is no link. Rows that repeat an id share its group; an id of several fingerprints counts for each.
    Ids may be numbers or strings.
    """
    same_print = ["level", "sig", "sig2"]
    with scratch(docs.sparkSession) as keep:
        prints = keep(cut(fingerprints(docs, p, id_col, text_col).withColumnRenamed(id_col, "id")))
        signed = prints.where("id is not null and sig <> ''")
        # written at once, so the numbers stay
        kinds = cut(signed.groupBy(*same_print).agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n")).withColumn("no", F.monotonically_increasing_id()))
        near, joined = alike(kinds, p)
        linked = keep(cut(kinds.join(near, "no", "left").select(*same_print, "rep", "n", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links")).where("links > 0")))
        name = lambda c, to: kinds.select(F.col("no").alias(c), F.col("rep").alias(to))
        held = joined.mapInArrow(contract, "u long, v long").join(name("u", "a"), "u").join(name("v", "b"), "v").select("a", "b")
        equal = signed.join(linked.where("n > 1"), same_print).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
        roots = keep(components(cut(equal.unionByName(held))))
    # a null id has no links
    found = prints.join(linked.select(*[F.col(c).alias(f"_{c}") for c in same_print], "links"), F.expr("id is not null and level = _level and sig = _sig and sig2 = _sig2"), "left")
    out = found.join(roots, "id", "left").select("id", *same_print, F.coalesce("root", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return out.withColumnRenamed("id", id_col)
