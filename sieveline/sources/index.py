"""The stored index: docs, postings, doc_stats, vectors and meta as Parquet, in versions that a manifest names."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import is_blank
from ..operators import search

DIM, MOST_DIM = 1024, 65535
MANIFEST = re.compile(r"manifest-([0-9]{12})\.json")
#: Manifests that stay, the one in force among them.
KEPT = 10
DOCS = "doc_id long, content string, source string, page int, section string, indexed_at timestamp"
TABLES = {"docs": DOCS, "postings": "term string, doc_id long, tf long", "doc_stats": "doc_id long, dl int", "vectors": "doc_id long, embedding array<float>"}
#: Meta values that are set once; another value for a set one is an error.
GUARDED = ("embedding_model", "tokenizer_version", "reranker_model")


def _base36(n: int) -> str:
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    while n:
        n, r = divmod(n, 36)
        out = digits[r] + out
    return out or "0"


class _Folder:
    """Small files of a folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.at(""))] if self.fs.exists(self.at("")) else []

    def write(self, name: str, text: str) -> None:
        """Written aside, then moved to a name that nothing has, so a reader sees the whole file or none."""
        aside = self.at(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(aside, self.at(name)):
            self.fs.delete(aside, False)
            raise OSError(f"{name} in {self.path} is there already: another writer was faster")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _manifests(folder: _Folder) -> list[str]:
    """The manifests of a folder, the newest first."""
    return sorted((n for n in folder.names() if MANIFEST.fullmatch(n)), reverse=True)


@dataclass
class Index:
    """A handle on an index folder. Each change writes a manifest of the next number, and the greatest number counts:
    a change that breaks off before leaves the one before in force, and of two writers at a time one fails. Readers
    keep the version that they opened; KEPT manifests stay."""

    spark: SparkSession
    path: str
    readonly: bool
    manifest: dict
    closed: bool = False
    at: int = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int | None = None, readonly: bool = False, version: str | None = None) -> Index:
        """Opens or, unless readonly, creates the index. Another dim than the stored one is an error."""
        if dim is not None and (isinstance(dim, bool) or not isinstance(dim, int) or not 1 <= dim <= MOST_DIM):
            raise ValueError(f"dim must be a whole number from 1 to {MOST_DIM}")
        folder = _Folder(spark, path)
        known = _manifests(folder)
        if not known:
            if readonly:
                raise FileNotFoundError(f"{path} is no index: it has no manifest")
            if any(n.startswith(tuple(f"{t}-" for t in TABLES)) for n in folder.names()):
                raise ValueError(f"{path} has parts of an index but no manifest; it isn't made anew over them")
            meta = {"index_version": version or f"v1-{_base36(int(time.time() * 1000))}", "embedding_dim": str(dim or DIM), **dict.fromkeys(GUARDED, "")}
            index = cls(spark, path, False, {"meta": meta, "parts": {t: [] for t in TABLES}, "next_id": 1})
            index._save()
            return index
        manifest = json.loads(folder.read(known[0]))
        missing = [t for t in TABLES if t not in manifest.get("parts", {})]
        if missing:
            raise ValueError(f"{path} lacks {', '.join(missing)}")
        stored = manifest["meta"].get("embedding_dim", "")
        if not stored.isdigit() or not 1 <= int(stored) <= MOST_DIM:
            raise ValueError(f"the stored embedding_dim {stored!r} is corrupt")
        if dim is not None and dim != int(stored):
            raise ValueError(f"the index has vectors of {stored} numbers, not {dim}")
        return cls(spark, path, readonly, manifest, at=int(MANIFEST.fullmatch(known[0])[1]))

    def _save(self, **changes) -> None:
        """The manifest with changes, in force and in hand once its file is there."""
        after = {**self.manifest, **changes}
        folder = _Folder(self.spark, self.path)
        folder.write(f"manifest-{self.at + 1:012d}.json", json.dumps(after))
        self.manifest, self.at = after, self.at + 1
        for old in _manifests(folder)[KEPT:]:
            folder.delete(old)

    def _writable(self) -> None:
        if self.closed or self.readonly:
            raise ValueError("the index is " + ("closed" if self.closed else "open for reading only"))

    @property
    def dim(self) -> int:
        return int(self.manifest["meta"]["embedding_dim"])

    @property
    def version(self) -> str:
        if not (v := self.manifest["meta"].get("index_version")):
            raise ValueError("the index has no version")
        return v

    def set_meta(self, key: str, value: str) -> None:
        """Sets one of GUARDED once; the same value again is fine, another one or an empty one is an error."""
        self._writable()
        if key not in GUARDED or not value:
            raise ValueError(f"key must be one of {GUARDED}, value not empty")
        held = self.manifest["meta"].get(key, "")
        if held and held != value:
            raise ValueError(f"{key} is {held!r} already, not {value!r}")
        self._save(meta={**self.manifest["meta"], key: value})

    def table(self, name: str) -> DataFrame:
        parts = [f"{self.path}/{p}" for p in self.manifest["parts"][name]]
        return self.spark.read.schema(TABLES[name]).parquet(*parts) if parts else self.spark.createDataFrame([], TABLES[name])

    def meta(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.manifest["meta"].items()), "key string, value string")

    def register_views(self) -> None:
        """docs, postings, doc_stats, vectors and meta as temporary views for spark.sql."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)
        self.meta().createOrReplaceTempView("meta")

    def append(self, chunks: DataFrame, order: list[str]) -> dict[str, float]:
        """Adds chunks (content, embedding[, source, page, section]) in the given order, all or none: {inserted,
        duration_ms}. Empty content, another dim or a number that isn't finite refuses the whole batch. Ids go on
        from the last; the manifest names the new parts only once all are written."""
        self._writable()
        began = time.time()
        for c, kind in (("source", "string"), ("page", "int"), ("section", "string")):
            if c not in chunks.columns:
                chunks = chunks.withColumn(c, F.lit(None).cast(kind))
        bad = chunks.agg(F.count("*").alias("n"), F.sum(is_blank("content").cast("int")).alias("blank"), F.sum((~vectors.valid(vectors.doubles("embedding"), self.dim)).cast("int")).alias("vectors")).first()
        if bad["n"] == 0:
            return {"inserted": 0, "duration_ms": 0}
        if bad["blank"] or bad["vectors"]:
            raise ValueError(f"{bad['blank']} chunks without content, {bad['vectors']} without {self.dim} finite numbers")
        first, batch = self.manifest["next_id"], uuid.uuid4().hex
        now = F.lit(time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())).cast("timestamp")
        # a range sort numbers the rows of each partition by itself; how many come before a partition is added after
        numbered = chunks.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
        staged = f"{self.path}/staged-{batch}"
        numbered.select("_at", "content", "source", F.col("page").cast("int").alias("page"), "section", now.alias("indexed_at"), F.col("embedding").cast("array<float>").alias("embedding")).write.parquet(staged)
        part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
        held = self.spark.read.parquet(staged).withColumn("_part", part)
        sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
        before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
        rows = held.join(before, "_part").withColumn("doc_id", F.lit(first) + F.col("_before") + place).drop("_part", "_before", "_at")
        each = search.doc_terms(rows, "doc_id", "content")
        tf = search.postings(rows, "doc_id", "content")
        out = {"docs": rows.select("doc_id", "content", "source", "page", "section", "indexed_at"), "doc_stats": each.select("doc_id", "dl"), "vectors": rows.select("doc_id", "embedding"), "postings": tf.repartition("term").sortWithinPartitions("term", "doc_id")}
        folder = _Folder(self.spark, self.path)
        try:
            for name, df in out.items():
                df.write.parquet(f"{self.path}/{name}-{batch}")
        except BaseException:
            for name in out:
                folder.delete(f"{name}-{batch}")
            raise
        finally:
            folder.delete(f"staged-{batch}")
        self._save(parts={t: [*held, f"{t}-{batch}"] for t, held in self.manifest["parts"].items()}, next_id=first + bad["n"])
        return {"inserted": bad["n"], "duration_ms": (time.time() - began) * 1000}

    def compact(self) -> None:
        """Rewrites the parts of all batches as one of each table, postings sorted by term; old parts stay until
        clean(), so readers of the version before go on."""
        self._writable()
        batch, sort = uuid.uuid4().hex, {"postings": ["term", "doc_id"]}
        for name in TABLES:
            df = self.table(name)
            df = df.repartition(sort[name][0]).sortWithinPartitions(*sort[name]) if name in sort else df
            df.write.parquet(f"{self.path}/{name}-{batch}")
        self._save(parts={t: [f"{t}-{batch}"] for t in TABLES})

    def clean(self) -> list[str]:
        """Deletes and names the parts that no kept manifest has: of batches that broke off, and from before
        compact() once KEPT changes have followed."""
        self._writable()
        folder = _Folder(self.spark, self.path)
        used = {p for m in _manifests(folder) for parts in json.loads(folder.read(m))["parts"].values() for p in parts}
        gone = [n for n in folder.names() if n.startswith(("staged-", *(f"{t}-" for t in TABLES))) and n not in used]
        for n in gone:
            folder.delete(n)
        return gone

    def fts_search(self, queries: DataFrame, k: int = search.SOURCE_TOP_K) -> DataFrame:
        return search.bm25_topk(self.table("postings"), self.table("doc_stats"), queries, k)

    def vec_search(self, queries: DataFrame, k: int = search.SOURCE_TOP_K) -> DataFrame:
        return search.knn_topk(self.table("vectors"), queries, self.dim, k)

    def hybrid_search(self, queries: DataFrame, options: search.HybridOptions = search.HybridOptions()) -> DataFrame:
        hits = search.hybrid_search(self.table("postings"), self.table("doc_stats"), self.table("vectors"), queries, self.dim, options)
        return hits.join(self.table("docs").drop("indexed_at"), "doc_id")

    def close(self) -> None:
        """Drops the views; closing twice does nothing."""
        if not self.closed:
            for name in (*TABLES, "meta"):
                self.spark.catalog.dropTempView(name)
            self.closed = True
