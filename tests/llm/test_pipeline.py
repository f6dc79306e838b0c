"""The pipeline against a plain version of each stage, and with rows of all kinds."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import langid, minhash, packing, pii, tokenpack
from test_dedup import groups, shingle_set
from test_mixing_packing import naive

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(5)
    alphabets = {"aa": "aeiourlnst", "bb": "kwxzqvyjgh"}
    word = lambda k: "".join(rng.choice(alphabets[k]) for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(80):
        lang = "aa" if i % 3 else "bb"
        ws = [word(lang) for _ in range(rng.randint(20, 120))]
        rows.append((i, " ".join(ws), lang, f"s{i % 4}"))
        if i % 5 == 0:
            ws[3] = word(lang)
            rows.append((100 + i, " ".join(ws), lang, "s0"))
        if i % 7 == 0:
            rows.append((200 + i, " ".join(ws) + " mail bob@example.org or +1 (017) 555-7713", lang, "s1"))
    rows += [(300, "...", "aa", "s2"), (301, None, "bb", "s2"), (302, "", None, None)]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def poisson(seed, doc_id, rate):
    u = int(hashlib.md5(f"{seed}|{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, term = 0, math.exp(-rate)
    cdf = term
    while cdf <= u:
        k, term = k + 1, term * rate / (k + 1)
        cdf += term
    return k


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    taught = langid.train(docs)
    classify = langid._classify(langid.Profiles(), taught)
    found = [(r, classify([r[1] or ""])) for r in rows]
    now = [(r[0], r[1], f[0][0], r[3]) for r, f in found if f[3][0]]
    assert {r[0] for r in rows} - {r[0] for r in now} == {300, 301, 302}
    sets = {r[0]: shingle_set(r[1], 3) for r in now}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= minhash.MinHash().threshold]
    root = groups(sets, pairs)
    now = [(r[0], pii.mask(r[1]), r[2], r[3]) for r in now if root[r[0]] == r[0]]
    assert 60 < len(now) < 90 and all("bob@" not in r[1] for r in now)
    chars = {}
    for r in now:
        chars[r[3]] = chars.get(r[3], 0) + len(r[1])
    rate = {s: sum(chars.values()) / len(chars) / c for s, c in chars.items()}
    copies = [(r, k) for r in now for k in range(1, poisson(42, r[0], rate[r[3]]) + 1)]
    enc = tokenpack.encoder(tokenpack.TOKENIZER)
    ids = {r[0]: [*enc.encode_ordinary(r[1]), tokenpack.END] for r in now}

    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    # every document and copy is there with all its ids
    got = {}
    for r in out.sort_values("start").itertuples():
        got.setdefault((r.doc_id, r.copy_no), []).extend(tokenpack.unpack(r.ids, 16, r.length).tolist())
    assert got == {(r[0], k): ids[r[0]] for r, k in copies}
    # the order within the only shard is that of the hashed ids, texts and copies
    packed = {r[0]: tokenpack.pack(np.array(ids[r[0]]), 16) for r in now}
    line = spark.createDataFrame([(r[0], bytearray(packed[r[0]]), k) for r, k in copies], "id long, data binary, copy int")
    line = line.select("id", "copy", F.xxhash64(F.lit(packing.Packing().seed), F.xxhash64("id", "data"), "copy").alias("h")).orderBy("h").collect()
    places = naive([len(ids[r["id"]]) for r in line], 8192, 64)
    assert sorted((r["id"], r["copy"], b, o) for r, (b, o) in zip(line, places)) == sorted(map(tuple, out[["doc_id", "copy_no", "bin_id", "bin_start"]].to_numpy().tolist()))


def test_stages_take_rows_of_all_kinds(spark, tmp_path):
    rows = documents()[:30]
    odd = [(None, None, None, None, None), (None, "tara nola", "aa", None, 9), (1, rows[1][1], "aa", "s1", None), (900, "x " * 50000, "aa", "s1", 5), (901, "", "", "", 0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumns({"id": F.lit("clash"), "_row": F.lit(1), "_copy": F.lit("c"), "key": F.lit(2), "root": F.lit(None).cast("string")})
    for data in (docs, docs.limit(0)):
        now = data
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == docs.columns and now.dtypes == docs.dtypes, name
                path = str(tmp_path / f"{k}-{data is docs}")
                now.write.parquet(path)
                now = spark.read.parquet(path)
        assert (now.count() > 0) == (data is docs)
