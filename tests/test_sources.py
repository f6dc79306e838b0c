import json
import math
import os

import pytest
from pyspark.sql import functions as F

from sieveline.operators import enrich, providers
from sieveline.plans import tools
from sieveline.sources import evalset, files
from sieveline.sources.caption_cache import CaptionCache, sha256_hex
from sieveline.sources.index import Index


def rows(spark, n, dim=2):
    return spark.createDataFrame([(f"text number {i}", "s", i, [float(i)] * dim) for i in range(n)], "content string, source string, page int, embedding array<float>")


def test_index_appends_all_or_nothing(spark, tmp_path):
    index = Index.open(spark, str(tmp_path / "ix"), dim=2, version="v1-test")
    assert index.append(rows(spark, 3), ["page"])["inserted"] == 3
    with pytest.raises(ValueError, match="without content"):
        index.append(rows(spark, 2).withColumn("content", F.lit(" ")), ["page"])
    with pytest.raises(ValueError):
        index.append(rows(spark, 2, dim=3), ["page"])
    assert index.append(rows(spark, 0), ["page"]) == {"inserted": 0, "duration_ms": 0}
    assert index.append(rows(spark, 2), ["page"])["inserted"] == 2
    again = Index.open(spark, str(tmp_path / "ix"), readonly=True)
    assert sorted(r["doc_id"] for r in again.table("docs").collect()) == [1, 2, 3, 4, 5] and again.version == "v1-test"
    assert again.table("vectors").count() == again.table("doc_stats").count() == 5
    q = spark.createDataFrame([(1, "number 2", [2.0, 2.0])], "qid long, query string, embedding array<float>")
    assert again.hybrid_search(q).orderBy("position").first()["page"] == 2
    assert again.fts_search(q, 3).count() == 3 and again.vec_search(q, 1).first()["distance"] == 0
    again.register_views()
    assert spark.sql("SELECT count(*) FROM postings WHERE term = 'number'").first()[0] == 5
    with pytest.raises(ValueError, match="reading"):
        again.append(rows(spark, 1), ["page"])
    again.close(), again.close()


def test_index_meta_rules(spark, tmp_path):
    path = str(tmp_path / "ix")
    with pytest.raises(FileNotFoundError):
        Index.open(spark, path, readonly=True)
    for bad in (0, 65536, 1.5):
        with pytest.raises(ValueError):
            Index.open(spark, path, dim=bad)
    index = Index.open(spark, path, dim=4)
    assert index.version.startswith("v1-")
    index.set_meta("embedding_model", "m"), index.set_meta("embedding_model", "m")
    with pytest.raises(ValueError, match="already"):
        index.set_meta("embedding_model", "other")
    with pytest.raises(ValueError, match="vectors of 4"):
        Index.open(spark, path, dim=8)
    assert Index.open(spark, path).version == index.version
    manifest = max((tmp_path / "ix").glob("manifest-*.json"))
    state = json.loads(manifest.read_text())
    manifest.write_text(json.dumps({**state, "meta": {**state["meta"], "embedding_dim": "x"}}))
    (tmp_path / "ix" / f".{manifest.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="corrupt"):
        Index.open(spark, path)


def test_a_broken_change_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    from sieveline.sources import index as module

    path = str(tmp_path / "ix")
    index = Index.open(spark, path, dim=2)
    index.append(rows(spark, 3), ["page"])

    def killed(self, name, text):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(module._Folder, "write", killed)
        with pytest.raises(KeyboardInterrupt):
            index.append(rows(spark, 2), ["page"])
    again = Index.open(spark, path)
    assert again.table("docs").count() == 3 and index.table("docs").count() == 3
    stale = Index.open(spark, path)
    assert again.append(rows(spark, 2), ["page"])["inserted"] == 2
    with pytest.raises(OSError, match="another writer"):
        stale.append(rows(spark, 1), ["page"])
    assert sorted(r["doc_id"] for r in Index.open(spark, path).table("docs").collect()) == [1, 2, 3, 4, 5]
    assert len(again.clean()) >= 4 and again.table("docs").count() == 5
    again.compact()
    assert len(again.manifest["parts"]["docs"]) == 1 and Index.open(spark, path, readonly=True).table("postings").count() == 15
    for f in (tmp_path / "ix").glob("manifest-*.json"):
        f.unlink()
    with pytest.raises(ValueError, match="made anew"):
        Index.open(spark, path)


EVAL = """
version: "1"
queries:
  # reason: first of all
  - query: a
    expected: [{source: s, page: 2}]
  - query: b
    reason: inline
    # reason: not this
    expected: [{source: s}]
    history: [{role: user, content: hi}]
  - query: c
    reason: " "
    # reason: old
    # reason: the comment
    expected:
      - source: t
    referenceAnswer: ref
"""


def test_evaluation_sets(spark, tmp_path):
    got = evalset.parse(EVAL)
    assert [q["reason"] for q in got["queries"]] == ["first of all", "inline", "the comment"]
    (tmp_path / "e.yml").write_text(EVAL)
    queries, expected = evalset.load(spark, str(tmp_path / "e.yml"))
    assert queries.count() == 3 and [tuple(r) for r in expected.orderBy("qid").collect()] == [(0, "s", 2), (1, "s", None), (2, "t", None)]
    for bad in ("[]", "version: ''\nqueries: [{query: a, expected: [{source: s}]}]", "version: '1'\nqueries: []", "version: '1'\nversion: '2'\nqueries: [{query: a, expected: [{source: s}]}]", "version: '1'\nqueries: [{query: a, expected: []}]", "version: '1'\nqueries: [{query: a, expected: [{source: s, page: 0}]}]", "version: '1'\nqueries: [{query: a, expected: [{source: s}], history: [{role: system, content: x}]}]"):
        with pytest.raises(ValueError):
            evalset.parse(bad)


def test_binary_files_and_integrity(spark, tmp_path):
    folder = tmp_path / "m"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.bin").write_bytes(b"one\ftwo")
    (folder / "sub" / "b.bin").write_bytes(b"xyz")
    pages = files.parse_files(spark, str(folder / "a.bin"), files.text_pages).orderBy("page").collect()
    assert [tuple(r) for r in pages] == [("a.bin", 1, "one"), ("a.bin", 2, "two")]
    good = [{"path": "a.bin", "bytes": 7, "sha256": sha256_hex(b"one\ftwo")}, {"path": "sub/b.bin", "bytes": 3, "sha256": sha256_hex("xyz")}, {"path": "none", "bytes": 1, "sha256": "0", "optional": True}]
    assert {r["path"]: r["status"] for r in files.verify_files(spark, str(folder), good).collect()} == {"a.bin": "ok", "sub/b.bin": "ok", "none": "missing"}
    with pytest.raises(files.HashMismatch):
        files.verify_files(spark, str(folder), [{**good[0], "sha256": "0"}])
    with pytest.raises(files.FileMissing):
        files.verify_files(spark, str(folder), [{**good[2], "optional": False}])
    assert files.verify_files(spark, str(folder), [{**good[0], "bytes": 8}], strict=False).first()["status"] == "size"
    os.symlink(folder / "a.bin", folder / "link")
    for path in ("../x", "/x", "a//b", "link"):
        with pytest.raises(ValueError):
            files.verify_files(spark, str(folder), [{**good[0], "path": path}])


def test_state_files(tmp_path):
    path = str(tmp_path / "d" / "s.json")
    assert files.read_state(path) is None
    files.write_state(path, {"a": 1})
    assert files.read_state(path) == {"a": 1}
    open(path, "w").write("[")
    with pytest.raises(ValueError, match="corrupt"):
        files.read_state(path)
    assert files.default_cache_dir("captions", {"SIEVELINE_CAPTIONS_DIR": "/x"}) == "/x"


OPTIONS = enrich.CaptionOptions("p", "m", retries=1)


def images(spark):
    return spark.createDataFrame([("a", 1, 0, bytearray(b"one")), ("a", 1, 1, bytearray(b"two")), ("b", 1, 0, bytearray(b"one"))], "source string, page int, image_ix int, image binary")


def test_captions_dedupe_and_cache(spark, tmp_path):
    cache = CaptionCache(spark, str(tmp_path / "c"))
    log = str(tmp_path / "log")

    def vision(image: bytes, prompt: str) -> str:
        with open(log, "a") as f:
            f.write(image.decode() + "\n")
        return f" about {image.decode()} "

    out = enrich.captioned(images(spark), vision, OPTIONS, cache).orderBy("source", "image_ix").collect()
    assert [(r["content"], r["section"]) for r in out] == [("about one", "[图片描述 #0]"), ("about two", "[图片描述 #1]"), ("about one", "[图片描述 #0]")]
    assert sorted(open(log).read().split()) == ["one", "two"]
    assert enrich.captioned(images(spark), vision, OPTIONS, cache).count() == 3
    assert sorted(open(log).read().split()) == ["one", "two"]
    assert cache.rows().count() == 2
    cache.close()
    with pytest.raises(ValueError, match="closed"):
        cache.rows()


def test_caption_failures(spark):
    def vision(image: bytes, prompt: str) -> str:
        if image == b"one":
            raise ValueError("unreadable")
        return "ok"

    assert [r["source"] for r in enrich.captioned(images(spark), vision, OPTIONS).collect()] == ["a"]
    with pytest.raises(enrich.VisionCaptionFailed):
        enrich.captioned(images(spark), vision, enrich.CaptionOptions("p", "m", retries=0, fail_index=True))
    calls = []

    def empty(image, prompt):
        calls.append(1)
        return " " if len(calls) < 2 else "late"

    assert enrich.caption(empty, b"x", OPTIONS, sleep=lambda s: calls.append(s)) == ("late", None) and calls == [1, 0.5, 1]
    for bad in ({"concurrency": 0}, {"retries": 11}, {"timeout_ms": 1}):
        with pytest.raises(ValueError):
            enrich.CaptionOptions("p", "m", **bad)


def test_page_captions_and_plugins(spark):
    pages = spark.createDataFrame([("a", 1, "short", bytearray(b"x")), ("a", 2, "long " * 50, bytearray(b"y"))], "source string, page int, text string, image binary")
    out = enrich.page_captions(pages, lambda i, p: "c", OPTIONS)
    assert [(r["page"], r["section"]) for r in out.collect()] == [(1, "[图片描述]")]
    chunks = spark.createDataFrame([("a", 1, None, "t")], "source string, page int, section string, content string")
    assert enrich.with_plugins(chunks, pages, [lambda p: enrich.page_captions(p, lambda i, q: "c", OPTIONS)]).count() == 2


def test_retryable_errors():
    class Status(Exception):
        status = 503

    class Abort(Exception):
        pass

    Abort.__name__ = "AbortError"
    wrapped = ValueError("x")
    wrapped.__cause__ = ConnectionResetError()
    assert all(map(providers.is_retryable, (Status(), Abort(), wrapped, enrich.EmptyAnswer()))) and not providers.is_retryable(ValueError())


def test_embedding_and_context(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, content string")
    out = enrich.embedded(df, enrich.hashing_embedder, dim=64).orderBy("doc_id").collect()
    assert all(abs(math.fsum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in out)
    with pytest.raises(Exception, match="blank"):
        enrich.embedded(df.withColumn("content", F.lit(" ")), enrich.hashing_embedder).collect()
    with pytest.raises(ValueError):
        enrich.embedded(df, enrich.hashing_embedder, batch=257)
    docs = spark.createDataFrame([(1, "whole one"), (2, "whole two")], "doc_id long, text string")
    got = enrich.contextualised(df, docs, lambda s, u, k: f" {s[-3:]} ", 10, 20).orderBy("doc_id").collect()
    assert [r["content"] for r in got] == ["one\n\na b", "two\n\nc"]
    with pytest.raises(ValueError):
        enrich.contextualised(df, docs, lambda s, u, k: "", 9, 20)
    size = spark.createDataFrame([(3136, 10), (100, 50)], "w int, h int").select(enrich.resized(F.col("w"), F.col("h")).alias("s")).collect()
    assert [tuple(r["s"]) for r in size] == [(1568, 5), (100, 50)]


def test_tools():
    calls = []

    def handler(args):
        calls.append(args)
        if args.get("q") == "bad":
            raise RuntimeError("secret")
        return {"content": [], "confidence": "low" if args.get("q") == "low" else "high"}

    registry = tools.Registry("v1")
    registry.add(tools.define_tool("search_docs", "Searches.", "For questions.", handler, ("q",), [("plain", {"q": "x"})]))
    assert [registry.call("search_docs", {"q": q})["_meta"]["cache"] for q in ("a", " a ", "low", "low")] == ["miss", "hit", "miss", "miss"]
    bad = registry.call("search_docs", {"q": "bad"})
    assert tools.is_error_result(bad) and "secret" not in json.dumps(bad)
    assert tools.is_error_result(registry.call("none", {})) and tools.is_error_result(registry.call("search_docs", {"z": 1}))
    for args in (("Bad", "d", "w"), ("ok", "", "w"), ("ok", "d" * 3000, "w")):
        with pytest.raises(ValueError):
            tools.define_tool(*args, handler)
    with pytest.raises(ValueError):
        registry.add(registry.tools["search_docs"])
    with pytest.raises(ValueError):
        tools.error_result("lower", "x")
    assert not tools.is_error_result({"isError": True, "content": [{"text": "{}"}]})
    loop: dict = {}
    loop["self"] = loop
    assert tools.is_error_result(tools.error_result("CODE", "m", details=object()))
    assert tools.with_lru_cache(handler, "t", "v", enabled=False) is handler


def test_cache_expiry_and_bounds():
    now = [0.0]
    run = tools.with_lru_cache(lambda a: {}, "t", "v", most=2, ttl_ms=1000, clock=lambda: now[0])
    status = lambda q: run({"q": q})["_meta"]["cache"]
    assert [status(q) for q in "abacb"] == ["miss", "miss", "hit", "miss", "miss"]
    now[0] = 2
    assert status("c") == "miss"


def test_hooks_and_resources():
    seen = []

    def broken(*a):
        raise OSError

    run = tools.with_hooks(lambda a: 1 / a["x"], tools.Hooks(broken, lambda a, r, ms: seen.append(r), lambda a, e, ms: seen.append(type(e))))
    assert run({"x": 2}) == 0.5
    with pytest.raises(ZeroDivisionError):
        run({"x": 0})
    assert seen == [0.5, ZeroDivisionError]
    r = tools.Resources("doc", lambda: [{"uri": "doc://a/b.md"}], lambda u: {"text": u})
    assert r.list() and r.read("doc://a/b.md")["text"]
    for bad in ("doc://a/..", "other://a/b", "doc://A/b"):
        with pytest.raises(ValueError):
            r.read(bad)


def test_latency():
    assert abs(tools.percentile([5, 3, 4, 1, 2], 0.95) - 4.8) < 1e-12
    for bad in (([], 0.5), ([1], 2), ([float("nan")], 0.5)):
        with pytest.raises(ValueError):
            tools.percentile(*bad)
    now = tools.measure(lambda i: None, 2, 5)
    assert tools.compare(now, now) == [] and tools.compare({**now, "p95": 300}, None)[0].startswith("p95 300")
    assert "worse" in tools.compare({**now, "p95": 100}, {**now, "p95": 10})[0] and "better" in tools.compare({**now, "p95": 1}, {**now, "p95": 50})[0]
    assert "another" in tools.compare(now, {**now, "environment": {}})[0]


def test_streaming_ingest(spark, tmp_path):
    from sieveline.streaming.ingest import ingest

    spark.createDataFrame([("a", "# T\nbody"), ("b", " ")], "source string, text string").write.parquet(str(tmp_path / "in"))
    index = Index.open(spark, str(tmp_path / "ix"), dim=64)
    stream = spark.readStream.schema("source string, text string").parquet(str(tmp_path / "in"))
    ingest(stream, index, enrich.hashing_embedder, str(tmp_path / "cp")).awaitTermination()
    assert [(r["source"], r["section"], r["content"]) for r in Index.open(spark, str(tmp_path / "ix")).table("docs").collect()] == [("a", "T", "body")]


def test_python_gets_few_large_rows_at_once(spark):
    """What hands documents to Python asks for smaller batches, unless the session has set its own."""
    from sieveline.sources import shared

    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    ask = lambda: enrich.contextualised(docs.withColumnRenamed("text", "content"), docs, lambda system, user, key: "x")
    before = {name: spark.conf.get(name) for name in shared.BATCH}
    try:
        for name in shared.BATCH:
            spark.conf.unset(name)
        assert [spark.conf.get(n) for n in shared.BATCH] == [old for old, _ in shared.BATCH.values()]
        assert ask().count() == 3
        assert [spark.conf.get(n) for n in shared.BATCH] == [new for _, new in shared.BATCH.values()]
        for name in shared.BATCH:
            spark.conf.set(name, "77")
        ask()
        assert [spark.conf.get(n).rstrip("b") for n in shared.BATCH] == ["77", "77"]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
