"""Tools over DataFrames: definitions, results, errors, hooks, the result cache, and latency snapshots."""

from __future__ import annotations

import json
import math
import platform
import re
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from ..functions.keys import cache_key, skip_write, with_cache_meta

Handler = Callable[[dict[str, Any]], dict[str, Any]]
DESCRIPTION_CHARS = 2048
CACHE_MAX, CACHE_TTL_MS = 500, 3_600_000
INTERNAL, TIMEOUT, INVALID, ABORTED = "INTERNAL_ERROR", "TIMEOUT", "INVALID_INPUT", "ABORTED"


def error_result(code: str, message: str, retryable: bool = False, **extra: Any) -> dict[str, Any]:
    """An error envelope; details that JSON can't hold become a text."""
    if not re.fullmatch(r"[A-Z][A-Z0-9_]*", code):
        raise ValueError(f"{code!r} is no error code")
    payload = {"error": code, "message": message, "retryable": retryable, **{k: v for k, v in extra.items() if v is not None}}
    try:
        text = json.dumps(payload, ensure_ascii=False)
    except (TypeError, ValueError):
        text = json.dumps({**payload, "details": "[not serialisable]"}, ensure_ascii=False, default=str)
    return {"isError": True, "content": [{"type": "text", "text": text}]}


def is_error_result(result: Any) -> bool:
    """Whether a result is an envelope with a payload of the right shape."""
    if not isinstance(result, dict) or result.get("isError") is not True or not isinstance(result.get("content"), list):
        return False
    for part in result["content"]:
        try:
            p = json.loads(part["text"])
        except (TypeError, KeyError, ValueError):
            continue
        if isinstance(p, dict) and isinstance(p.get("error"), str) and isinstance(p.get("message"), str) and isinstance(p.get("retryable"), bool):
            return True
    return False


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    params: tuple[str, ...]
    handler: Handler


def define_tool(name: str, description: str, when_to_use: str, handler: Handler, params: Iterable[str] = (), examples: Iterable[tuple[str, dict]] = ()) -> Tool:
    """A tool of snake_case name and camelCase parameters, its description composed and bounded."""
    if not re.fullmatch(r"[a-z][a-z0-9]*(?:_[a-z0-9]+)*", name):
        raise ValueError(f"{name!r} isn't snake_case")
    for p in params:
        if not re.fullmatch(r"[a-z][a-zA-Z0-9]*", p):
            raise ValueError(f"{p!r} isn't camelCase")
    lines = [description.strip(), "", f"When to use: {when_to_use.strip()}"]
    for i, (title, args) in enumerate(examples, 1):
        lines.append(f"Example {i}: {title}: {json.dumps(args, ensure_ascii=False)}")
    text = "\n".join(lines)
    if not description.strip() or not when_to_use.strip() or len(text) > DESCRIPTION_CHARS:
        raise ValueError(f"a description needs both parts and at most {DESCRIPTION_CHARS} characters")
    return Tool(name, text, tuple(params), handler)


@dataclass
class Hooks:
    """Called around a handler; what they raise is ignored, what the handler raises goes on."""

    before: Callable[[dict], None] | None = None
    after: Callable[[dict, dict, float], None] | None = None
    error: Callable[[dict, BaseException, float], None] | None = None


def with_hooks(handler: Handler, hooks: Hooks) -> Handler:
    def quietly(hook: Callable | None, *args: Any) -> None:
        try:
            if hook:
                hook(*args)
        except Exception:
            pass

    def run(args: dict[str, Any]) -> dict[str, Any]:
        began = time.monotonic()
        quietly(hooks.before, args)
        try:
            result = handler(args)
        except BaseException as e:
            quietly(hooks.error, args, e, (time.monotonic() - began) * 1000)
            raise
        quietly(hooks.after, args, result, (time.monotonic() - began) * 1000)
        return result

    return run


def with_lru_cache(handler: Handler, tool: str, index_version: str, most: int = CACHE_MAX, ttl_ms: float = CACHE_TTL_MS, enabled: bool = True, clock: Callable[[], float] = time.monotonic) -> Handler:
    """handler with its last results by canonical arguments and index version. Each answer says hit or miss; errors,
    results of low confidence and those for other environments aren't kept."""
    if not enabled:
        return handler
    held: OrderedDict[str, tuple[float, dict]] = OrderedDict()

    def run(args: dict[str, Any]) -> dict[str, Any]:
        key = cache_key(tool, index_version, args)
        if key in held and (clock() - held[key][0]) * 1000 < ttl_ms:
            held.move_to_end(key)
            return with_cache_meta(held[key][1], "hit")
        held.pop(key, None)
        result = handler(args)
        if not skip_write(args, result):
            held[key] = (clock(), result)
            while len(held) > most:
                held.popitem(last=False)
        return with_cache_meta(result, "miss")

    return run


@dataclass
class Registry:
    """Named tools; whatever a handler raises becomes an envelope, with the trace's text only outside production."""

    index_version: str = ""
    cache: bool = True
    production: bool = True
    tools: dict[str, Tool] = field(default_factory=dict)
    handlers: dict[str, Handler] = field(default_factory=dict)

    def add(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"{tool.name} is registered already")
        self.tools[tool.name] = tool
        self.handlers[tool.name] = with_lru_cache(tool.handler, tool.name, self.index_version, enabled=self.cache)

    def call(self, name: str, args: dict[str, Any]) -> dict[str, Any]:
        if name not in self.handlers:
            return error_result(INVALID, f"there is no tool {name}")
        unknown = set(args) - set(self.tools[name].params)
        if self.tools[name].params and unknown:
            return error_result(INVALID, f"unknown parameters: {', '.join(sorted(unknown))}")
        try:
            return self.handlers[name](args)
        except Exception as e:
            return error_result(INTERNAL, "the tool failed" if self.production else repr(e))


@dataclass(frozen=True)
class Resources:
    """Listed and readable resources of one scheme; every URI that goes in or out has to be plain."""

    scheme: str
    listing: Callable[[], list[dict]]
    reading: Callable[[str], dict]

    def _check(self, uri: str) -> str:
        if not re.fullmatch(rf"{re.escape(self.scheme)}://[a-z][-_0-9a-z]*/[-._0-9A-Za-z]+", uri) or ".." in uri:
            raise ValueError(f"{uri!r} is no URI of {self.scheme}")
        return uri

    def list(self) -> list[dict]:
        out = self.listing()
        for r in out:
            self._check(r["uri"])
        return out

    def read(self, uri: str) -> dict:
        return self.reading(self._check(uri))


def percentile(samples: list[float], p: float) -> float:
    """Linear interpolation between order statistics (type 7)."""
    if not samples or not all(map(math.isfinite, samples)) or not 0 <= p <= 1:
        raise ValueError("finite samples and p from 0 to 1 are needed")
    s = sorted(samples)
    h = (len(s) - 1) * p
    low = math.floor(h)
    return s[low] + (h - low) * (s[min(low + 1, len(s) - 1)] - s[low])


def snapshot(samples: list[float], cold_ms: float | None = None) -> dict[str, Any]:
    out = {f"p{int(p * 100)}": percentile(samples, p) for p in (0.5, 0.95, 0.99)}
    return {**out, "mean": sum(samples) / len(samples), "min": min(samples), "max": max(samples), "cold": cold_ms, "environment": {"python": platform.python_version(), "machine": platform.machine(), "system": platform.system()}}


def measure(run: Callable[[int], Any], warmup: int = 5, runs: int = 100) -> dict[str, Any]:
    """A snapshot of run's milliseconds after the warm-up calls; what it raises ends the measurement."""

    def timed(i: int) -> float:
        began = time.perf_counter()
        run(i)
        return (time.perf_counter() - began) * 1000

    cold = timed(0)
    for i in range(1, warmup):
        timed(i)
    return snapshot([timed(i) for i in range(runs)], cold)


def compare(now: dict[str, Any], baseline: dict[str, Any] | None, ceiling: float = 200, worse: float = 50, better: float = 20) -> list[str]:
    """Remarks: p95 over the ceiling; p95 worse or better than a baseline of the same environment, or that it differs."""
    out = [f"p95 {now['p95']:.1f} ms is over {ceiling:g} ms"] if now["p95"] >= ceiling else []
    if baseline:
        if baseline.get("environment") != now.get("environment"):
            return [*out, "the baseline is of another environment"]
        drift = now["p95"] - baseline["p95"]
        if drift > worse:
            out.append(f"p95 is {drift:.1f} ms worse")
        elif drift < -better:
            out.append(f"p95 is {-drift:.1f} ms better")
    return out
