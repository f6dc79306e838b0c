"""Pages of binary files through a pluggable parser, integrity of model files, and JSON state files."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "source string, page int, text string"


class FileMissing(ValueError):
    """A file that a manifest lists isn't there."""


class HashMismatch(ValueError):
    """A file has another size or hash than its manifest says."""


def parse_files(spark: SparkSession, path: str, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """PAGES of each binary file under path: parser gives a file's page texts in order, pages count from 1. What the
    parser raises fails the job. There is no PDF parser here; any library's fits in."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(os.path.basename(p), i, t) for p, c in zip(pdf["path"], pdf["content"]) for i, t in enumerate(parser(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PAGES)


def text_pages(content: bytes) -> list[str]:
    """A parser for text files whose pages form feeds part."""
    return content.decode("utf-8", "replace").split("\f")


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of text or Markdown files, each as a whole."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("text"))


def verify_files(spark: SparkSession, folder: str, manifest: list[dict], strict: bool = True) -> DataFrame:
    """(path, bytes, sha256, status) for each manifest entry {path, bytes, sha256, optional}: ok, missing, size or
    hash. Hashes are computed on the executors. Unsafe paths and symbolic links are errors; strict makes a failed
    entry that isn't optional one too."""
    for e in manifest:
        parts = e["path"].split("/")
        if e["path"].startswith("/") or "\\" in e["path"] or any(p in ("", ".", "..") for p in parts):
            raise ValueError(f"unsafe path {e['path']!r}")
        if any(Path(folder, *parts[: i + 1]).is_symlink() for i in range(len(parts))):
            raise ValueError(f"{e['path']!r} is a symbolic link")
    wanted = spark.createDataFrame([(e["path"], int(e["bytes"]), e["sha256"].lower(), bool(e.get("optional"))) for e in manifest], "path string, bytes long, sha256 string, optional boolean")
    base = os.path.realpath(folder)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})")
    got = there.select(relative.alias("path"), F.length("content").cast("long").alias("_n"), F.sha2("content", 256).alias("_h"))
    status = F.when(F.col("_h").isNull(), "missing").when(F.col("_n") != F.col("bytes"), "size").when(F.col("_h") != F.col("sha256"), "hash").otherwise("ok")
    out = wanted.join(got, "path", "left").withColumn("status", status)
    if strict:
        for r in out.where("status <> 'ok' and not (optional and status = 'missing')").collect():
            raise (FileMissing if r["status"] == "missing" else HashMismatch)(f"{r['path']}: {r['status']}")
    return out.select("path", "bytes", "sha256", "status")


def default_cache_dir(kind: str, env: dict[str, str] | None = None) -> str:
    """The folder of the environment's SIEVELINE_<KIND>_DIR, else one in the user's cache."""
    env = dict(os.environ) if env is None else env
    return env.get(f"SIEVELINE_{kind.upper()}_DIR") or str(Path(env.get("XDG_CACHE_HOME") or Path.home() / ".cache", "sieveline", kind))


def read_state(path: str) -> dict | None:
    """A JSON object; None if there is no such file; a corrupt one is an error."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except FileNotFoundError:
        return None
    try:
        got = json.loads(text)
    except ValueError as e:
        raise ValueError(f"{path} is corrupt: {e}") from e
    if not isinstance(got, dict):
        raise ValueError(f"{path} is corrupt: no object")
    return got


def write_state(path: str, state: dict) -> None:
    """Replaces a JSON file at once."""
    folder = Path(path).resolve().parent
    folder.mkdir(parents=True, exist_ok=True)
    fd, aside = tempfile.mkstemp(dir=folder, prefix=".state")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(state, f, ensure_ascii=False, indent=2)
    os.replace(aside, path)


def plain_name(text: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9_.-]+", text)) and ".." not in text
