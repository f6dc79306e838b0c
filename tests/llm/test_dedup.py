"""MinHash, fuzzy hashes, embeddings and connected components against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import ann, ctph, grouping, minhash
from sieveline.llm import common
from sieveline.llm.common import shared_folder
from sieveline.llm.grouping import components, strangers

DOCS = "doc_id long, text string"


def groups(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def corpus(n=60, seed=0):
    """Random documents with exact copies, copies of few edits, and a long chain of copies of copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(rng.randint(30, 200))) for _ in range(n)]
    out = list(texts)
    for t in texts[: n // 2]:
        ws = t.split()
        for _ in range(rng.randint(1, 4)):
            edited = [word() if rng.random() < rng.choice([0.0, 0.03, 0.1]) else w for w in ws]
            out.append(" ".join(edited).upper() if rng.random() < 0.3 else ", ".join(edited))
            ws = edited
    return list(enumerate(out))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)] + [(7, 7)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(df).collect()}
    real = [(a, b) for a, b in pairs if a != b]
    assert got == groups({x for p in real for x in p}, real)
    assert components(df.limit(0)).count() == 0


def shingle_set(text, n):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_minhash_against_all_pairs(spark):
    docs = corpus()
    p = minhash.MinHash()
    sets = {i: shingle_set(t, p.words) for i, t in docs}
    alike = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= p.threshold]
    want = groups(sets, alike)
    got = {r["doc_id"]: r["duplicate_of"] for r in minhash.duplicates(spark.createDataFrame(docs, DOCS), p).collect()}
    expected = {i: r for i, r in want.items() if i != r}
    assert len(set(got.items()) & set(expected.items())) >= 0.9 * len(expected)
    assert all(want[i] == want[r] for i, r in got.items()), "only verified likeness links"
    kept = minhash.deduplicated(spark.createDataFrame(docs, DOCS), p)
    assert {r["doc_id"] for r in kept.collect()} == set(sets) - set(got)


def test_minhash_finds_pairs_just_above_the_threshold(spark):
    """Groups of two documents of likeness 0.45 to 0.5, with the parameters that are registered."""
    rng, p, docs, want = random.Random(4), minhash.MinHash(), [], 0
    while want < 600:
        ws = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        edited = list(ws)
        for i in rng.sample(range(100), rng.randint(10, 14)):
            edited[i] = f"x{rng.randrange(10**6)}"
        a, b = (shingle_set(" ".join(t), p.words) for t in (ws, edited))
        if 0.45 <= len(a & b) / len(a | b) <= 0.5:
            docs += [" ".join(ws), " ".join(edited)]
            want += 1
    got = minhash.duplicates(spark.createDataFrame(list(enumerate(docs)), DOCS)).count()
    assert 0.9 * want <= got <= want


def test_minhash_edge_rows(spark):
    rows = [(1, "a b c d e f"), (2, "A, b c d e f!"), (None, "a b c d e f"), (3, None), (4, None), (5, ""), (6, " . "), (7, "one"), (8, "one"), (9, "two words"), (2, "a b c d e f"), (10, "x y " * 40000), (11, "x y " * 40000)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"id": F.lit("z"), "key": F.lit(1), "_gone": F.lit(2), "root": F.lit(3)})
    assert {tuple(r) for r in minhash.duplicates(docs).collect()} == {(2, 1, 1), (8, 7, 1), (11, 10, 1)}
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3, 4, 5, 6, 7, 9, 10]
    again = docs.unionByName(docs).unionByName(docs)
    assert sorted(r["doc_id"] for r in minhash.deduplicated(again).where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 9, 10], "rows that repeat an id are one document"
    names = docs.withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id").cast("string")))
    assert {tuple(r)[:2] for r in minhash.duplicates(names).collect()} == {("id-2", "id-1"), ("id-8", "id-7"), ("id-11", "id-10")}
    assert minhash.duplicates(docs.limit(0)).count() == 0
    for bad in ({"groups": 0}, {"threshold": 0}, {"threshold": 1.1}):
        with pytest.raises(ValueError):
            minhash.MinHash(**bad)


def test_links_hold_groups_together(spark):
    docs = corpus(30, 8)
    out = minhash.duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert all(r["links"] >= 1 for r in out)
    sizes = {}
    for r in out:
        sizes[r["duplicate_of"]] = sizes.get(r["duplicate_of"], 0) + 1
    assert any(n > 1 for n in sizes.values())


def test_large_groups_are_dealt_out(spark, monkeypatch):
    """A centre's members are compared in several tasks, each of which has the centre's text."""
    monkeypatch.setattr(minhash, "MEMBERS", 3)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base, f"x{rng.randrange(10**9)}"]) for _ in range(40)]
    got = minhash.duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert {r["doc_id"] for r in got} == set(range(1, 40)) and {r["duplicate_of"] for r in got} == {0}


def test_a_passage_in_every_document_links_none(spark):
    """Documents that share a third of their words meet in buckets but aren't near copies; true copies still are."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [passage + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(80)) for _ in range(120)]
    docs += [t + " more" for t in docs[:10]]
    got = {(r["doc_id"], r["duplicate_of"]) for r in minhash.duplicates(spark.createDataFrame(list(enumerate(docs)), DOCS)).collect()}
    assert got == {(120 + i, i) for i in range(10)}


def test_strangers_are_all_pairs_of_different_roots(spark):
    rng = random.Random(3)
    rows = [(k, i, i if rng.random() < 0.3 else 1000 + k) for k in range(6) for i in rng.sample(range(100), 20)]
    got = sorted(map(tuple, strangers(spark.createDataFrame(rows, "key long, id long, root long"), ["key"]).collect()))
    want = sorted({(min(a, b), max(a, b)) for k, a, r in rows for j, b, q in rows if k == j and r != q})
    assert got == want and want


def test_residual_pairs_are_verified(spark):
    """The bucket's least id is like none of the others; these still find each other."""
    from sieveline.llm.grouping import verified_groups

    buckets = spark.createDataFrame([(1, i) for i in range(8)] + [(1, 3)], "key long, id long")
    alike = {(2, 3), (3, 4), (5, 6)}
    verify = lambda pairs: pairs.where(F.concat_ws("-", "a", "b").isin([f"{a}-{b}" for a, b in alike]))
    got = {r["id"]: r["root"] for r in verified_groups(buckets, verify).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 5, 6: 5}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def naive_signature(text, most):
    """The definition byte by byte."""
    raw, level = text.encode(), 0

    def value(i):
        h = sum((raw[i - j] if i - j >= 0 else 0) * pow(0x01000193, j + 1, 1 << 32) for j in range(ctph.WINDOW)) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        return h ^ (h >> 12)

    values = [value(i) for i in range(len(raw))]
    cut = lambda k: [i + 1 for i in range(len(raw) - 1) if values[i] & ((1 << k) - 1) == (1 << k) - 1] + ([len(raw)] if raw else [])
    while len(cut(level)) > most:
        level += 1
    return level, len(cut(level)), len(cut(level + 1))


def test_signatures_follow_their_definition():
    texts = ["", "a", "short one", "é" * 50, *[t for _, t in corpus(12)], "x" * 300, "0 1 2 3 " * 4000]
    levels, first, second = ctph.signatures(texts, 64)
    for t, k, a, b in zip(texts, levels, first, second):
        assert (k, len(a), len(b)) == naive_signature(t, 64) and len(a) <= 64
    alone = [ctph.signatures([t], 64) for t in texts]
    assert [(int(k[0]), a[0], b[0]) for k, a, b in alone] == list(zip(levels.tolist(), first, second))
    base = texts[8]
    edited = base[: len(base) // 2] + "INSERTED" + base[len(base) // 2 :]
    _, a, _ = ctph.signatures([base], 64)
    _, b, _ = ctph.signatures([edited], 64)
    assert distance(a[0], b[0]) <= 4


def alike(x, y):
    def one(a, b):
        if not a or not b:
            return 0
        if a == b:
            return 100
        if min(len(a), len(b)) < ctph.RUN or not {a[i : i + 7] for i in range(len(a) - 6)} & {b[i : i + 7] for i in range(len(b) - 6)}:
            return 0
        return int(100 - 100 * distance(a, b) / max(len(a), len(b)))

    if x["level"] == y["level"]:
        return max(one(x["sig"], y["sig"]), one(x["sig2"], y["sig2"]))
    if x["level"] + 1 == y["level"]:
        return one(x["sig2"], y["sig"])
    return one(x["sig"], y["sig2"]) if x["level"] == y["level"] + 1 else 0


def test_shapes_never_rule_out_what_is_alike(spark):
    """The bound on edits by lengths and signs holds for all pairs, and tells most unlike ones."""
    docs = scattered(40) + [(1000 + i, t) for i, t in corpus(30, 5)]
    prints = ctph.fingerprints(spark.createDataFrame(docs, DOCS)).withColumnRenamed("doc_id", "id")
    rows = prints.collect()
    shapes = prints.mapInArrow(ctph._shapes, f"id long, shape {ctph.SHAPE}").join(prints, "id").select("id", "shape", F.struct("level", "sig", "sig2").alias("p"))
    both = shapes.select(F.col("id").alias("a"), F.col("shape").alias("x"), F.col("p").alias("u")).crossJoin(shapes.select(F.col("id").alias("b"), F.col("shape").alias("y"), F.col("p").alias("v"))).where("a < b")
    got = {(r["a"], r["b"]): (r["m"], r["s"], r["t"]) for r in both.select("a", "b", F.expr(ctph.may_score("x", "y", 70)).alias("m"), F.expr(ctph.score("u", "v")).alias("s"), F.expr(ctph.score("u", "v", 70)).alias("t")).collect()}
    assert all(m for m, s, _ in got.values() if s >= 70) and sum(s >= 70 for _, s, _ in got.values()) > 40
    assert all(s == t for _, s, t in got.values() if s >= 70 or t >= 70)
    assert sum(m for m, s, _ in got.values() if s < 70) < 0.2 * len(got)
    by = {r["id"]: r for r in rows}
    assert all(s >= 70 for (a, b), (_, s, _) in got.items() if alike(by[a], by[b]) >= 70)


def test_fuzzy_groups_against_all_pairs(spark):
    docs = corpus(40, 3)
    out = ctph.grouped(spark.createDataFrame(docs, DOCS)).collect()
    pairs = [(a["doc_id"], b["doc_id"]) for a in out for b in out if a["doc_id"] < b["doc_id"] and alike(a, b) >= 70]
    want = groups([i for i, _ in docs], pairs)
    got = {r["doc_id"]: r["group_id"] for r in out}
    linked = [i for i in want if want[i] != i]
    assert linked and got == want


def scattered(n=150, seed=9):
    """Documents and copies of them with edits spread over the text, so that few runs of signs stay whole."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    out = []
    for _ in range(n):
        ws = [word() for _ in range(rng.randint(250, 450))]
        step = len(ws) // rng.randint(7, 13)
        out += [" ".join(ws), " ".join(word() if i % step == step // 2 else w for i, w in enumerate(ws))]
    return list(enumerate(out))


def test_fuzzy_pairs_of_middling_score_meet(spark):
    """A single shared run makes a pair a candidate, so none of score 70 to 85 is lost."""
    docs = scattered()
    out = {r["doc_id"]: r for r in ctph.grouped(spark.createDataFrame(docs, DOCS)).collect()}
    middling = [i for i in range(0, len(docs), 2) if 70 <= alike(out[i], out[i + 1]) <= 85]
    assert len(middling) > 40
    assert all(out[i]["group_id"] == out[i + 1]["group_id"] for i in middling)


def linked(x, y):
    """Some run of signs in common at one level, and the best score at a common level reaches 70."""
    signs = [[(r["level"] + k, r[c]) for k, c in ((0, "sig"), (1, "sig2")) if r[c]] for r in (x, y)]
    run = lambda own: {(k, s[i : i + 7]) for k, s in own for i in range(max(1, len(s) - 6))}
    score = lambda a, b: 100 if a == b else 0 if min(len(a), len(b)) < 7 else int(100 - 100 * distance(a, b) / max(len(a), len(b)))
    return bool(run(signs[0]) & run(signs[1])) and max(score(a, b) for k, a in signs[0] for m, b in signs[1] if k == m) >= 70


@pytest.mark.parametrize("block", [2000, 3])
def test_all_links_between_fuzzy_prints_are_counted(spark, monkeypatch, block):
    """Versions of a document that are like its first are like each other too; copies count without pairs of their own."""
    monkeypatch.setattr(grouping, "BLOCK", block)
    docs = corpus(16, 11)
    rng = random.Random(12)
    base = scattered(1)[0][1].split()
    docs += [(500 + i, " ".join([*base[: (at := rng.randrange(len(base)))], f"v{i}", *base[at:]])) for i in range(12)]
    docs += [(600 + i, t) for i, (_, t) in enumerate(docs[::3])]
    docs += [(700, ""), (701, None), (702, "abc"), (703, "abc")]
    out = ctph.grouped(spark.createDataFrame(docs, DOCS)).collect()
    want = {a["doc_id"]: sum(linked(a, b) for b in out if b["doc_id"] != a["doc_id"]) for a in out}
    assert {r["doc_id"]: r["links"] for r in out} == want
    assert min(want[500 + i] for i in range(12)) > 8 and want[700] == want[701] == 0 and want[702] == want[703] == 1


def test_mates_are_all_pairs(spark, monkeypatch):
    """Each pair of mates once, however many buckets it shares and in whatever blocks its rows are."""
    rng = random.Random(4)
    rows = [(k, i) for k in range(8) for i in rng.sample(range(60), 25)]
    rows += [(20 + k, i) for k, i in rows if k < 2] + rows[:9]
    buckets, shapes = spark.createDataFrame(rows, "key long, id long"), spark.createDataFrame([(i, i % 7) for i in range(60)], "id long, shape int")
    want = sorted({(i, j) for k, i in rows for m, j in rows if k == m and i < j and (i % 7 + j % 7) % 3})
    for block in (2000, 4):
        monkeypatch.setattr(grouping, "BLOCK", block)
        assert sorted(map(tuple, grouping.mates(buckets, shapes, "(x + y) % 3 <> 0").collect())) == want
    assert grouping.mates(buckets.limit(0), shapes, "true").count() == 0


def test_fuzzy_edge_rows(spark):
    rows = [(1, "same text here"), (2, "same text here"), (None, "same text here"), (3, None), (4, ""), (2, "other words entirely"), (5, "other words entirely"), (6, "long " * 50000)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"id": F.lit(0), "level": F.lit("x"), "root": F.lit("y")})
    got = {(r["doc_id"], r["group_id"]) for r in ctph.grouped(docs).collect()}
    assert {r["doc_id"] for r in ctph.grouped(docs).where("links > 0").collect()} == {1, 2, 5}
    names = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {r["group_id"] for r in ctph.grouped(names).where("links > 0").collect()} == {"d1"}
    assert got == {(1, 1), (2, 1), (None, None), (3, 3), (4, 4), (5, 1), (6, 6)}
    assert ctph.grouped(docs.limit(0)).count() == 0


def near_vectors(seed=0, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(1500, dim))
    near = base[:600] + rng.normal(size=(600, dim)) * rng.uniform(0.01, 0.25, (600, 1))
    hot = base[700] + rng.normal(size=(150, dim)) * 0.05
    return np.concatenate([base, near, base[:20], hot])


@pytest.mark.parametrize("dim", [32, 96])
def test_near_vectors_against_all_pairs(spark, dim):
    x = near_vectors(dim, dim)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    alike = [(int(i), int(j)) for i, j in zip(*np.nonzero(s >= 0.97)) if i < j]
    want = groups(range(len(x)), alike)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.grouped(df).collect()
    got = {r["vec_id"]: r["group_id"] for r in out}
    linked = [i for i in want if want[i] != i]
    assert len(out) == len(x) and len(linked) > 500
    assert sum(got[i] == want[i] for i in linked) >= 0.95 * len(linked)
    assert all(want[i] == want[g] for i, g in got.items()), "only verified likeness links"
    degree = np.bincount(np.array(alike).ravel(), minlength=len(x))
    for r in out:
        assert (r["links"] > 0) == (r["group_id"] != r["vec_id"] or r["vec_id"] in got.values() and list(got.values()).count(r["vec_id"]) > 1)
        assert r["links"] <= degree[r["vec_id"]]


def test_vectors_meet_by_cosine(spark):
    """Recall of pairs, each a group of its own, by how alike they are."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    c = np.where(np.arange(1200) < 600, 0.971, 0.985)[:, None]
    y = c * x + np.sqrt(1 - c * c) * g
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["group_id"] for r in ann.grouped(df).collect()}
    found = [got[1200 + i] == i for i in range(1200)]
    assert sum(found[:600]) >= 0.93 * 600 and sum(found[600:]) >= 0.99 * 600


def test_tables_find_all_codes_within_the_radius():
    rng = random.Random(2)
    for bits, rows, radius in ((64, 50_000, 5), (64, 10**8, 5), (64, 10**12, 5), (64, 500, 5), (32, 2000, 5), (3, 10, 7), (64, 10**6, 7)):
        layout = ann.tables(bits, rows, radius)
        for _ in range(300):
            a = rng.getrandbits(bits)
            b = a
            for i in rng.sample(range(bits), min(radius, bits)):
                b ^= 1 << i
            assert any(((a >> at) & m) ^ f == (b >> at) & m for at, m, flips in layout for f in flips)


def test_vector_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0]), (10, [None, 1.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit(1), "norm": F.lit(2), "label": F.lit(None).cast("int")})
    got = sorted(((r["vec_id"] or 0), r["group_id"], r["links"]) for r in ann.grouped(df).collect())
    assert got == [(0, None, 0), (1, 1, 1), (2, 1, 1), (2, 1, 1), *[(i, i, 0) for i in range(3, 11)]]
    names = df.withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    assert {r["group_id"] for r in ann.grouped(names).where("links > 0").collect()} == {"v1"}
    assert ann.grouped(df.limit(0)).count() == 0
    for bad in ({"bits": 65}, {"rounds": 0}, {"radius": -1}, {"threshold": 2}, {"rotations": 0}):
        with pytest.raises(ValueError):
            ann.Quantiser(**bad)


def test_shared_folder_is_the_sessions(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    assert shared_folder(spark).removeprefix("file:").startswith(named)


def test_intermediate_tables_are_deleted(spark):
    """Only what the result stands on stays in the shared folder, and release() deletes that."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    held = lambda: len(fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))))
    docs, before = spark.createDataFrame(corpus(10), DOCS), held()
    out = minhash.duplicates(docs)
    assert held() - before == 1 and out.count() > 0
    common.release(spark)
    assert held() <= before


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = lambda self: None
        getConf = lambda self: {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared_folder(Session())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_edit_distances_of_whole_arrays():
    """Signatures of 1 to 64 signs, few different ones among them, in more pairs than a step has."""
    rng = random.Random(4)
    first = ["".join(rng.choices("AB+/"[: rng.choice([2, 4])], k=rng.choice([1, 2, 7, 31, 63, 64]))) for _ in range(60)]
    second = ["".join(x if rng.random() > 0.1 else rng.choice(["", "B", x + "A"]) for x in s)[:64] or "A" for s in first]
    strings, text = ctph.Strings(first, second), [s for pair in zip(first, second) for s in pair]
    x, y = (np.array(z) for z in zip(*[(i, j) for i in range(len(text)) for j in range(len(text))]))
    assert len(x) > ctph.STEP
    got = strings.edits(x, y)
    for k in rng.sample(range(len(x)), 1500):
        assert got[k] == edits(text[x[k]], text[y[k]])


def test_likeness_in_numpy_is_that_in_spark(spark, monkeypatch):
    """The same sums and groups in whatever blocks and batches, though pairs share many buckets; and no pair is a row."""
    rng = random.Random(5)
    parts = [[f"w{rng.randrange(4000)}" for _ in range(300)] for _ in range(6)]
    docs = [(i, " ".join(w if rng.random() > 0.02 else "new" for w in parts[i % 6])) for i in range(160)]
    p = ctph.Fingerprints()
    prints = ctph.fingerprints(spark.createDataFrame(docs, DOCS)).where("sig <> ''")
    kinds = prints.groupBy("level", "sig", "sig2").agg(F.min("doc_id").alias("no"), F.count("*").alias("n")).localCheckpoint()
    buckets = kinds.select(F.col("no").alias("id"), "level", "sig", "sig2").mapInArrow(ctph._keys, "id long, keys array<long>").select(F.explode("keys").alias("key"), "id").localCheckpoint()

    def found(how):
        near, joined = how(kinds, buckets, p)
        roots = {r["id"]: r["root"] for r in grouping.components(joined.select(F.col("u").alias("a"), F.col("v").alias("b"))).collect()}
        return {r["no"]: r["near"] for r in near.collect()}, roots, joined.count()

    want = found(ctph._by_spark)
    assert len(want[1]) > 20 and want[2] > 2 * len(want[1])
    for block, batch in ((2000, "1000"), (7, "5")):
        monkeypatch.setattr(grouping, "BLOCK", block)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = found(ctph._by_numpy)
        assert got[:2] == want[:2]
        if block == 2000:
            assert got[2] < want[2]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
