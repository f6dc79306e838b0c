"""Poisson replication, best-fit packing and bit packing."""

import hashlib
import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import mixing, packing, queries, tokenpack

DOCS = "doc_id long, text string, source string"
DATA = "/root/testdata/sf0.001"


def test_op1_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    got = queries.op1_poisson_mix(spark, DATA)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    columns = sorted(got.columns)
    want = con.sql(queries.oracle_sql()["op1_poisson_mix"]).select(", ".join(columns)).fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want) and want


def count(seed, doc_id, rate):
    u = int(hashlib.md5(f"{seed}|{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, cdf, term = 0, math.exp(-rate), math.exp(-rate)
    while cdf <= u:
        k += 1
        term *= rate / k
        cdf += term
    return k


def test_counts_follow_the_inverted_distribution(spark):
    docs = spark.createDataFrame([(i, "x" * (1 + i % 3), "ab"[i % 2]) for i in range(4000)], DOCS)
    rates = {r["source"]: r["rate"] for r in mixing.rates(docs, {"a": 3.0, "b": 1.0}, 2.0).collect()}
    out = mixing.replicated(docs, {"a": 3.0, "b": 1.0}, 2.0)
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(got.get(i, 0) == count(42, i, rates["ab"[i % 2]]) for i in range(4000))
    chars = {r["source"]: r["c"] for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("c")).collect()}
    total = docs.agg(F.sum(F.length("text"))).first()[0]
    assert abs(chars["a"] / (1.5 * total) - 1) < 0.05 and abs(chars["b"] / (0.5 * total) - 1) < 0.1


def test_tables_invert_the_distribution_at_any_rate():
    import time

    for rate in (1e-6, 0.3, 1.0, 7.5, 60.0):
        first, cdf = mixing.poisson_table(rate)
        term = total = math.exp(-rate)
        want = [total]
        for k in range(1, 20):
            term *= rate / k
            total += term
            want.append(total)
        assert first == 0 and np.allclose(cdf[:20], want, atol=1e-12)
    began = time.time()
    for rate in (1e4, 1e6, 1e9):
        first, cdf = mixing.poisson_table(rate)
        at = [first + int((cdf <= u).sum()) for u in (0.0227501, 0.5, 0.9772499)]
        assert np.allclose(at, [rate - 2 * rate**0.5, rate, rate + 2 * rate**0.5], atol=0.01 * rate**0.5 + 2)
        assert cdf[0] < 1e-12 and cdf[-1] == 1
    assert time.time() - began < 2


def test_rare_sources_come_as_often_as_asked(spark):
    """A source of a millionth of the characters has a rate of half a million; more than MOST_RATE is refused."""
    docs = spark.createDataFrame([(1, "x" * 1_000_000, "big"), (2, "y", "tiny")], DOCS)
    n = mixing.replicated(docs).where("source = 'tiny'").count()
    assert abs(n - 500_000.5) < 6 * 500_000**0.5
    copies = mixing.replicated(docs).where("source = 'tiny'").agg(F.min("_copy"), F.max("_copy"), F.count_distinct("_copy")).first()
    assert tuple(copies) == (1, n, n)
    with pytest.raises(ValueError, match="times over"):
        mixing.replicated(docs, {"tiny": 1.0}, 1e7)


def test_names_with_dots_and_ids_that_are_texts(spark):
    docs = spark.createDataFrame([("a-1", "x" * 30, "s", 1), ("b-2", "yy", "t", 2)], "`doc.id` string, `the.text` string, `the.source` string, `a.b` long")
    out = mixing.mixed(docs, {"s": 1.0, "t": 1.0}, 50.0, id_col="doc.id", source_col="the.source", text_col="the.text")
    assert out.columns == docs.columns and {r["doc.id"] for r in out.collect()} == {"a-1", "b-2"}
    assert {r["doc.id"] for r in packing.packed(out, id_col="doc.id", text_col="the.text").collect()} == {"a-1", "b-2"}


def test_partitions_follow_the_mixtures_size(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PARTITION_CHARS", 1000)
    docs = spark.createDataFrame([(i, "x" * 100, "s") for i in range(200)], DOCS)
    assert mixing.mixed(docs).rdd.getNumPartitions() == 20


def test_order_is_global_and_independent_of_partitions(spark):
    docs = spark.createDataFrame([(i, "t", "s") for i in range(500)], DOCS)
    orders = [[r["doc_id"] for r in mixing.shuffled(mixing.replicated(docs.repartition(p)), p).collect()] for p in (1, 3, 7)]
    assert orders[0] == orders[1] == orders[2] and orders[0] != sorted(orders[0])
    places = [r["_place"] for r in mixing.shuffled(mixing.replicated(docs), 5).collect()]
    assert places == sorted(places)


def test_large_rates_and_edge_rows(spark):
    docs = spark.createDataFrame([(1, "x" * 3000, "big"), (2, "y", "tiny"), (None, None, None), (3, "", "tiny"), (3, "", "tiny")], DOCS).withColumns({"_copy": F.lit("mine"), "_u": F.lit(1), "rate": F.lit(2)})
    out = mixing.replicated(docs, {"big": 1, "tiny": 1, "": 1})
    assert 1200 < out.where("doc_id = 2").count() < 1800 and out.columns == ["doc_id", "text", "source", "_u", "rate", "_copy", "_place"]
    assert mixing.mixed(docs, {"big": 1, "tiny": 1}).columns == docs.columns
    repeats = out.where("doc_id = 3").groupBy("_copy").count().collect()
    assert all(r["count"] == 2 for r in repeats)
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mixed(docs.where("text is null")).count() == 0
    for bad in ({"weights": {}}, {"weights": {"a": -1.0}}, {"weights": {"a": float("nan")}}, {"budget": 0}):
        with pytest.raises(ValueError):
            mixing.rates(docs, **bad)


def naive(sizes, capacity, most):
    """Best fit over a plain list of open bins: [bin, free, when it came to this space]."""
    bins, out, made = [], [], 0
    for step, s in enumerate(sizes):
        fits = [b for b in bins if b[1] >= s]
        if fits:
            b = min(fits, key=lambda b: (b[1], -b[2]))
            bins.remove(b)
        else:
            if len(bins) == most:
                bins.remove(min(bins, key=lambda b: (b[1], -b[2])))
            b = [made, capacity, step]
            made += 1
        out.append((b[0], capacity - b[1]))
        if b[1] > s:
            bins.append([b[0], b[1] - s, step])
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5))
def test_best_fit_equals_the_plain_search(sizes, most):
    got = list(packing.best_fit(sizes, 20, most))
    assert got == naive(sizes, 20, most)
    for b in {b for b, _ in got}:
        spans = sorted((o, o + s) for (k, o), s in zip(got, sizes) if k == b)
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] <= 20


def test_packing_covers_every_unit_once(spark):
    rows = [(i, "é" * (i * 7 % 90), "s") for i in range(300)] + [(5, "again", "s"), (None, "null id", "s"), (900, None, "s"), (901, "z" * 1000, "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"id": F.lit("x"), "shard": F.lit(1), "length": F.lit(2)})
    p = packing.Packing(capacity=100, open_bins=8, shard_units=5000)
    out = packing.packed(docs, p).toPandas()
    assert out["length"].sum() == sum(len((t or "").encode()) + 1 for _, t, _ in rows)
    big = out[out.doc_id == 901].sort_values("start")
    assert big["start"].tolist() == list(range(0, 1001, 100)) and big["length"].sum() == 1001
    for _, g in out.groupby("bin_id"):
        g = g.sort_values("bin_start")
        assert g["length"].sum() <= 100 and (g["bin_start"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all()
    assert out["doc_id"].isna().sum() == 1 and (out["doc_id"] == 5).sum() == 2 and (out["doc_id"] == 900).sum() == 1
    again = packing.packed(docs.repartition(7), p).toPandas()
    assert sorted(map(tuple, out.fillna(-1).to_numpy().tolist())) == sorted(map(tuple, again.fillna(-1).to_numpy().tolist()))
    assert packing.packed(docs.limit(0), p).count() == 0 and packing.packed(docs, p, F.lit(None)).count() == 0
    full = out["length"].sum() / (100 * out["bin_id"].nunique())
    assert full > 0.9


@pytest.mark.skipif(not os.path.exists(tokenpack.TOKENIZER), reason="no vocabulary here")
def test_sequences_hold_the_ids_of_their_pieces(spark):
    texts = ["Hello world", "", None, "naïve ñ 试用期", "w " * 700, "Hello world", "Hello world"]
    docs = spark.createDataFrame([(i if i < 6 else 0, t, "s") for i, t in enumerate(texts)], DOCS).withColumns({"id": F.lit("x"), "data": F.lit(1), "units": F.lit("y"), "g": F.lit(2)})
    enc = tokenpack.encoder(tokenpack.TOKENIZER)
    for vocabulary, bits in ((50257, 16), (100_000, 17)):
        out = packing.packed_ids(docs, packing.Packing(capacity=64, open_bins=4, shard_units=600), vocabulary=vocabulary).toPandas()
        whole = {}
        for r in out.sort_values("start").itertuples():
            ids = tokenpack.unpack(r.ids, bits, r.length)
            assert r.start == len(whole.setdefault((r.doc_id, r.copy_no), []))
            whole[r.doc_id, r.copy_no] += ids.tolist()
        assert all(ids[-1] == tokenpack.END and tokenpack.END not in ids[:-1] for ids in whole.values())
        got = sorted(enc.decode(ids[:-1]) for ids in whole.values())
        assert got == sorted(t or "" for t in texts) and {k for k in whole if k[0] == 0} == {(0, 1), (0, 2)}
        for _, g in out.groupby("bin_id"):
            g = g.sort_values("bin_start")
            assert g["length"].sum() <= 64 and (g["bin_start"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all()
    assert packing.packed_ids(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.packed_ids(docs, packing.Packing(capacity=60))


def test_shards_are_packed_one_by_one(spark):
    """Each shard is an online run of its own in the order of the hashes, however many share a partition."""
    docs = spark.createDataFrame([(i, "x" * (i % 37), "s") for i in range(400)], DOCS)
    p = packing.Packing(capacity=100, open_bins=5, shard_units=1000)
    out = packing.packed(docs, p).toPandas()
    total = sum(i % 37 + 1 for i in range(400))
    shards = math.ceil(total / 1000)
    order = docs.select("doc_id", F.xxhash64(F.lit(p.seed), F.xxhash64("doc_id", "text"), F.lit(1)).alias("o")).collect()
    for s in range(shards):
        line = sorted((r["o"], r["doc_id"]) for r in order if r["o"] % shards == s)
        places = naive([i % 37 + 1 for _, i in line], 100, 5)
        want = sorted((i, (s << 32) + b, o) for (_, i), (b, o) in zip(line, places))
        assert want == sorted(map(tuple, out[out.bin_id // 2**32 == s][["doc_id", "bin_id", "bin_start"]].to_numpy().tolist()))


def test_copies_scatter_over_sequences(spark):
    """30 copies of one document among others don't follow one another."""
    docs = spark.createDataFrame([(i, "x" * 9, "s") for i in range(270)] + [(999, "y" * 9, "s")] * 30, DOCS)
    p = packing.Packing(capacity=100, open_bins=1)
    out = packing.packed(docs, p).toPandas().sort_values(["bin_id", "bin_start"])
    copies = out[out.doc_id == 999]
    assert len(out) == 300 and len(copies) == 30 and copies["bin_id"].nunique() >= 15
    again = packing.packed(docs.repartition(7), p).toPandas().sort_values(["bin_id", "bin_start"])
    assert out.to_numpy().tolist() == again.to_numpy().tolist()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, 2**b - 1), max_size=70))), st.integers(1, 20), st.integers(-5, 80), st.integers(-5, 80))
def test_bits_round_trip(case, block, start, stop):
    bits, ids = case
    ids = np.array(ids, np.uint32)
    assert len(tokenpack.pack(ids, bits)) == math.ceil(len(ids) * bits / 8)
    assert (tokenpack.unpack(tokenpack.pack(ids, bits), bits, len(ids)) == ids).all()
    data, at = tokenpack.pack_blocks(ids, bits, block)
    assert (tokenpack.read(data, at, len(ids), bits, block, start, stop) == ids[slice(start, stop)]).all()


def test_widths():
    assert [tokenpack.width(v) for v in (1, 2, 3, 256, 257, 50257, 32000)] == [1, 1, 2, 8, 9, 16, 15]
    with pytest.raises(ValueError):
        tokenpack.width(0)
    with pytest.raises(ValueError):
        tokenpack.pack(np.array([4]), 2)


@pytest.mark.skipif(not os.path.exists(tokenpack.TOKENIZER), reason="no vocabulary here")
def test_ids_are_those_of_another_implementation(spark):
    """The registered query over all documents against another library's byte-level BPE of the same vocabulary."""
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(tokenpack.TOKENIZER.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op3_packed_tokens(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tokenpack.read(r["packed"], r["offsets"], r["n_tokens"], 16, 1024).tolist() == other.encode(docs[r["doc_id"]], add_special_tokens=False).ids
    for odd in ("Hello  world\n\n x's 12,3 é 试用期\t\t!", "don't  we'll\r\n  y ", "<|endoftext|>"):
        assert tokenpack.encoder(tokenpack.TOKENIZER).encode_ordinary(odd) == other.encode(odd, add_special_tokens=False).ids


@pytest.mark.skipif(not os.path.exists(tokenpack.TOKENIZER), reason="no vocabulary here")
def test_token_rows_decode_to_their_texts(spark):
    texts = ["Hello world", "", None, "<|endoftext|> stays text", "naïve ñ 试用期", "w " * 30000, "Hello world"]
    docs = spark.createDataFrame([(i if i != 4 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("id", F.lit("x"))
    enc = tokenpack.encoder(tokenpack.TOKENIZER)
    for vocabulary, bits in ((50257, 16), (100_000, 17)):
        out = tokenpack.packed_tokens(docs, vocabulary=vocabulary, block=64).collect()
        got = sorted(enc.decode(tokenpack.read(r["packed"], r["offsets"], r["n_tokens"], bits, 64).tolist()) for r in out)
        assert got == sorted(t or "" for t in texts)
        assert all(r["offsets"] == [0] and r["packed"] == b"" for r in out if r["n_tokens"] == 0)
        long = next(r for r in out if r["n_tokens"] > 10000)
        assert tokenpack.read(long["packed"], long["offsets"], long["n_tokens"], bits, 64, 9000, 9003).tolist() == enc.encode_ordinary(texts[5])[9000:9003]
    assert tokenpack.packed_tokens(docs.limit(0)).count() == 0
