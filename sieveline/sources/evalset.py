"""Evaluation sets in YAML."""

from __future__ import annotations

import re
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

QUERIES = "qid long, query string, category string, reason string, reference_answer string, history array<struct<role:string,content:string>>"
EXPECTED = "qid long, source string, page int"


class _Unique(yaml.SafeLoader):
    """A loader that refuses a key twice in one mapping."""

    def construct_mapping(self, node: yaml.MappingNode, deep: bool = False) -> dict:
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        for k in keys:
            if keys.count(k) > 1:
                raise ValueError(f"key {k!r} occurs twice")
        return super().construct_mapping(node, deep)


def _comment_reasons(text: str) -> dict[int, str]:
    """The last '# reason:' comment above or within each item of queries, by the item's place."""
    node = yaml.compose(text, Loader=yaml.SafeLoader)
    items = next((v for k, v in getattr(node, "value", []) if k.value == "queries"), None)
    if not isinstance(items, yaml.SequenceNode) or items.flow_style:
        return {}
    starts = [n.start_mark.line for n in items.value]
    lines = text.split("\n")
    key_line = next(k.start_mark.line for k, _ in node.value if k.value == "queries")
    found: dict[int, str] = {}
    for at in range(key_line + 1, len(lines)):
        m = re.match(r"\s*#\s*reason:\s*(.*?)\s*$", lines[at])
        if m and m[1]:
            # comments right above an item are that item's, those further up the one before's
            below = at + 1
            while below < len(lines) and (not lines[below].strip() or lines[below].lstrip().startswith("#")):
                below += 1
            own = [i for i, s in enumerate(starts) if s == below] or [i for i, s in enumerate(starts) if s <= at][-1:] or [0]
            found[own[0]] = m[1]
    return found


def _text(value: Any, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} must be a text that isn't blank")
    return value


def parse(text: str) -> dict[str, Any]:
    """{version, description, queries}, validated; inline reasons win over comments unless blank."""
    raw = yaml.load(text, Loader=_Unique)
    if not isinstance(raw, dict):
        raise ValueError("an evaluation set is a mapping")
    version = _text(str(raw["version"]) if isinstance(raw.get("version"), (int, float)) else raw.get("version"), "version")
    items = raw.get("queries")
    if not isinstance(items, list) or not items:
        raise ValueError("queries must be a list that isn't empty")
    reasons = _comment_reasons(text)
    queries = []
    for i, q in enumerate(items):
        at = f"queries[{i}]"
        if not isinstance(q, dict):
            raise ValueError(f"{at} must be a mapping")
        expected = q.get("expected")
        if not isinstance(expected, list) or not expected:
            raise ValueError(f"{at}.expected must have an element")
        wanted = []
        for j, e in enumerate(expected):
            page = e.get("page") if isinstance(e, dict) else None
            if page is not None and (isinstance(page, bool) or not isinstance(page, int) or page < 1):
                raise ValueError(f"{at}.expected[{j}].page must be a whole number from 1")
            wanted.append({"source": _text(e.get("source") if isinstance(e, dict) else None, f"{at}.expected[{j}].source"), "page": page})
        history = q.get("history") or []
        for t in history:
            if not isinstance(t, dict) or t.get("role") not in ("user", "assistant") or not isinstance(t.get("content"), str):
                raise ValueError(f"{at}.history needs turns of role user or assistant with content")
        inline = q.get("reason")
        reason = inline if isinstance(inline, str) and inline.strip() else reasons.get(i)
        queries.append({"query": _text(q.get("query"), f"{at}.query"), "expected": wanted, "category": q.get("category"), "reason": reason, "reference_answer": q.get("referenceAnswer"), "history": history})
    return {"version": version, "description": raw.get("description"), "queries": queries}


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, expected) of a YAML file; qid counts from 0."""
    with open(path, encoding="utf-8") as f:
        got = parse(f.read())
    rows = [(i, q["query"], q["category"], q["reason"], q["reference_answer"], [(t["role"], t["content"]) for t in q["history"]]) for i, q in enumerate(got["queries"])]
    wanted = [(i, e["source"], e["page"]) for i, q in enumerate(got["queries"]) for e in q["expected"]]
    return spark.createDataFrame(rows, QUERIES), spark.createDataFrame(wanted, EXPECTED)
