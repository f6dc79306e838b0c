"""What surrounds the tools: choice of a transport, JSON-RPC over lines, and the files of a new project."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any, TextIO

from .tools import Registry, Resources

TRANSPORTS = ("stdio", "http")
TRANSPORT_VARIABLE = "SIEVELINE_TRANSPORT"
#: Bytes of a request that a server reads; a longer one is answered with an error.
MOST_BYTES = 4 << 20
TOKEN = re.compile(r"\{\{([A-Za-z_][A-Za-z0-9_]*)\}\}")


def select_transport(explicit: str | None = None, env: Mapping[str, str] | None = None) -> str:
    """The transport asked for, else the one that the environment names, else stdio; an unknown one is an error."""
    chosen = explicit if explicit is not None else (os.environ if env is None else env).get(TRANSPORT_VARIABLE, "").strip() or "stdio"
    if chosen not in TRANSPORTS:
        raise ValueError(f"transport must be one of {', '.join(TRANSPORTS)}, not {chosen!r}")
    return chosen


def answer(registry: Registry, resources: Resources | None, line: str) -> dict[str, Any] | None:
    """The reply to a JSON-RPC request; None to a notification."""

    def failed(code: int, message: str) -> dict[str, Any]:
        return {"jsonrpc": "2.0", "id": call.get("id") if isinstance(call, dict) else None, "error": {"code": code, "message": message}}

    call: Any = None
    if len(line.encode()) > MOST_BYTES:
        return failed(-32600, f"a request has {MOST_BYTES} bytes at most")
    try:
        call = json.loads(line)
    except ValueError:
        return failed(-32700, "no JSON")
    if not isinstance(call, dict) or not isinstance(call.get("method"), str):
        return failed(-32600, "no request")
    params = call.get("params") or {}
    if "id" not in call:
        return None
    try:
        match call["method"]:
            case "tools/list":
                result: dict[str, Any] = {"tools": [{"name": t.name, "description": t.description, "inputSchema": {"type": "object", "properties": {p: {} for p in t.params}}} for t in registry.tools.values()]}
            case "tools/call":
                result = registry.call(params["name"], params.get("arguments") or {})
            case "resources/list" if resources is not None:
                result = {"resources": resources.list()}
            case "resources/read" if resources is not None:
                result = {"contents": [resources.read(params["uri"])]}
            case "ping":
                result = {}
            case other:
                return failed(-32601, f"there is no method {other}")
    except (KeyError, TypeError, ValueError) as e:
        return failed(-32602, f"unusable parameters: {e}")
    return {"jsonrpc": "2.0", "id": call["id"], "result": result}


def serve_lines(registry: Registry, lines: Iterable[str], out: TextIO, resources: Resources | None = None) -> int:
    """Answers a request a line until the lines end; how many were answered."""
    n = 0
    for line in lines:
        if line.strip() and (reply := answer(registry, resources, line)) is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()
            n += 1
    return n


def replace_tokens(text: str, values: Mapping[str, str]) -> str:
    """text with {{NAME}} replaced by the value of NAME; a name without value is an error, a value isn't looked into."""
    missing = sorted({m[1] for m in TOKEN.finditer(text)} - set(values))
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    return TOKEN.sub(lambda m: values[m[1]], text)


FILES = {
    "README.md": "# {{NAME}}\n\nRun `python build.py`, then `python -m sieveline eval --index index --set eval.yml`.\n",
    "data/sample.md": "# {{NAME}}\n\n## Leave\n\nEveryone has twenty-five days of leave a year.\n\n## Travel\n\nTickets are refunded within a month.\n",
    "eval.yml": "version: '1'\nqueries:\n  - query: days of leave a year\n    category: leave\n    expected: [{source: sample.md}]\n  - query: when are tickets refunded\n    category: travel\n    expected: [{source: sample.md}]\n",
    "build.py": '''"""Chunks the files of data/ into the index of {{NAME}}."""

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from sieveline.operators.chunking import chunked
from sieveline.sources.index import Index

spark = SparkSession.builder.appName("{{NAME}}").getOrCreate()
docs = spark.createDataFrame([(p.name, p.read_text()) for p in sorted(Path("data").glob("*.md"))], "source string, text string")
chunks = chunked(docs, id_col="source").withColumn("embedding", F.array(F.lit(0.0)))
Index.open(spark, "index", dim=1).append(chunks, ["source", "chunk_ix"])
''',
}


def new_project(folder: str, name: str | None = None) -> list[str]:
    """Writes a small project, a document, an evaluation set and what builds its index, to a new or empty folder."""
    at = Path(folder)
    name = name or at.name
    if not re.fullmatch(r"[a-z0-9][a-z0-9._-]{0,213}", name):
        raise ValueError(f"{name!r} is no name for a project: small letters, digits, . _ - are")
    if at.exists() and (not at.is_dir() or any(at.iterdir())):
        raise ValueError(f"{folder} isn't empty")
    for path, text in FILES.items():
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_text(replace_tokens(text, {"NAME": name}), encoding="utf-8")
    return [str(at / p) for p in FILES]
