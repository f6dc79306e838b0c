"""Canonical JSON, cache keys and the rules of what is cached."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_BLANK

#: Arguments that never enter a cache key.
NOT_IN_KEY = frozenset({"env"})


def _number(x: float) -> str:
    """A number as ECMAScript prints it."""
    if not math.isfinite(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(float(x)).partition("e")
    if not exponent:
        return mantissa
    power = int(exponent)
    digits = mantissa.replace(".", "").replace("-", "")
    sign = "-" if x < 0 else ""
    if -7 < power < 0:
        return f"{sign}0.{'0' * (-power - 1)}{digits}"
    return f"{mantissa.removesuffix('.0')}e{'+' if power > 0 else '-'}{abs(power)}"


def canonical_json(value: Any) -> str:
    """JSON with sorted keys, integer-like keys first by number, the rest by UTF-16 units; texts trimmed, their
    ideographic spaces made plain; whole numbers without a point."""
    if isinstance(value, dict):

        def order(k: str) -> tuple:
            index = k.isascii() and k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1
            return (0, int(k), b"") if index else (1, 0, k.encode("utf-16-be", "surrogatepass"))

        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value, key=order)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, str):
        return json.dumps(value.strip(PY_BLANK).replace("　", " "), ensure_ascii=False)
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return _number(value)
    raise TypeError(f"{type(value).__name__} has no canonical form")


def cache_key(tool: str, index_version: str, args: dict[str, Any]) -> str:
    kept = {k: v for k, v in args.items() if k not in NOT_IN_KEY}
    return hashlib.sha256(f"{tool}:{index_version}:{canonical_json(kept)}".encode()).hexdigest()


def judge_key(model: str, prompt_version: str, prompt: str) -> str:
    return hashlib.sha256(f"{model}:{prompt_version}:{canonical_json(prompt)}".encode()).hexdigest()


def key_column(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def canonical_column(c: Column) -> Column:
    """canonical_json() of a column of JSON texts, in Arrow batches; null for what is none."""

    def canonical(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else canonical_json(json.loads(text))
            except ValueError:
                return None

        return texts.map(one)

    return F.pandas_udf(canonical, "string")(c)


def call_key_column(tool: Column, index_version: Column, args: Column) -> Column:
    """cache_key() of columns, the arguments as JSON objects; null for what is none."""

    def keyed(tools: pd.Series, versions: pd.Series, texts: pd.Series) -> pd.Series:
        def one(name: str | None, version: str | None, text: str | None) -> str | None:
            try:
                held = None if text is None else json.loads(text)
            except ValueError:
                return None
            return cache_key(name, version, held) if isinstance(held, dict) else None

        return pd.Series([one(*row) for row in zip(tools, versions, texts)], dtype=object)

    return F.pandas_udf(keyed, "string")(tool, index_version, args)


def skip_write(args: dict[str, Any], result: dict[str, Any]) -> bool:
    """Whether a result isn't worth caching: an error, one of low confidence, or one for another environment than dev."""
    if result.get("isError") is True:
        return True
    meta = result.get("_meta") if isinstance(result.get("_meta"), dict) else {}
    for holder in (result, result.get("structuredContent"), meta):
        level = holder.get("confidence") if isinstance(holder, dict) else None
        if isinstance(level, str) and level.strip(PY_BLANK).lower() == "low":
            return True
    env = args.get("env")
    return isinstance(env, str) and env != "" and env != "dev"


def skip_write_column(is_error: Column, confidence: Column, env: Column) -> Column:
    """skip_write() over columns; nulls are absent values."""
    low = F.lower(F.trim(confidence)) == "low"
    other = (env != "") & (env != "dev")
    return F.coalesce(is_error, F.lit(False)) | F.coalesce(low, F.lit(False)) | F.coalesce(other, F.lit(False))


def with_cache_meta(result: Any, status: str) -> Any:
    """result with _meta.cache = status; the result itself isn't changed. A list gets it in its first object."""
    if isinstance(result, list):
        return [with_cache_meta(result[0], status), *result[1:]] if result and isinstance(result[0], dict) else result
    if not isinstance(result, dict):
        return result
    meta = result.get("_meta")
    return {**result, "_meta": {**(meta if isinstance(meta, dict) else {}), "cache": status}}
