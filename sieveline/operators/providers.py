"""Injected models: their shapes, and calls with time limits whose failures are values."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, TimeoutError as FutureTimeout
from typing import Any, Protocol, TypeVar

from ..functions.text import PY_BLANK

T = TypeVar("T")
MOST_MS = 2**31 - 1
JUDGE_TIMEOUT_MS, REWRITE_TIMEOUT_MS = 30_000, 10_000
CONTENT_MISSING, INVALID_INPUT = "EVAL_CONTENT_MISSING", "EVAL_INVALID_METRIC_INPUT"
JUDGE_TIMEOUT, JUDGE_MALFORMED = "EVAL_JUDGE_TIMEOUT", "EVAL_JUDGE_MALFORMED_OUTPUT"


class Generate(Protocol):
    def __call__(self, prompt: str) -> str: ...


class Embed(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Score(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Vision(Protocol):
    def __call__(self, image: bytes, prompt: str) -> str: ...


class EvaluationError(Exception):
    """A coded failure; retryable says whether another attempt may help."""

    def __init__(self, code: str, message: str, retryable: bool = False) -> None:
        super().__init__(message)
        self.code, self.retryable = code, retryable

    def payload(self) -> dict[str, Any]:
        return {"error": self.code, "message": str(self), "retryable": self.retryable}


def timeout_of(requested: float | None, default: int) -> float:
    """A positive finite request, 2^31 - 1 ms at most; else the default."""
    ok = isinstance(requested, (int, float)) and not isinstance(requested, bool) and 0 < requested < float("inf")
    return min(requested, MOST_MS) if ok else default


def call(model: Generate, prompt: str, parse: Callable[[str], T], timeout_ms: float | None = None, default: int = JUDGE_TIMEOUT_MS) -> dict[str, Any]:
    """{ok: True, value} or {ok: False, error}: a timeout may be retried, output that parse refuses is malformed.
    What the model itself raises goes on to the caller."""
    pool = ThreadPoolExecutor(1)
    try:
        raw = pool.submit(model, prompt).result(timeout_of(timeout_ms, default) / 1000)
    except FutureTimeout:
        return {"ok": False, "error": EvaluationError(JUDGE_TIMEOUT, "the model took too long", True).payload()}
    finally:
        pool.shutdown(wait=False)
    try:
        return {"ok": True, "value": parse(raw)}
    except Exception as e:  # whatever parse dislikes is malformed output
        return {"ok": False, "error": EvaluationError(JUDGE_MALFORMED, f"unusable model output: {e}").payload()}


NETWORK = {"ECONNRESET", "ECONNREFUSED", "ETIMEDOUT", "ENOTFOUND", "EAI_AGAIN", "EPIPE", "ECONNABORTED"}


def is_network_error(error: BaseException | None, depth: int = 5) -> bool:
    """Whether an error, or one of its causes down to depth, is one of the network."""
    while error is not None and depth >= 0:
        if isinstance(error, (ConnectionError, TimeoutError)) or getattr(error, "code", None) in NETWORK:
            return True
        error, depth = error.__cause__ or error.__context__, depth - 1
    return False


def is_retryable(error: BaseException) -> bool:
    """Aborts, network faults, status 429 and 5xx, and empty answers."""
    status = getattr(error, "status", None) or getattr(error, "status_code", None)
    if isinstance(status, int) and (status == 429 or 500 <= status < 600):
        return True
    return type(error).__name__ in ("AbortError", "EmptyAnswer") or is_network_error(error)


def backoff_ms(attempt: int, hint_ms: float | None = None) -> int:
    """The provider's hint, or 500, 1500, 4500, ...; 30 s at most."""
    if hint_ms is not None and hint_ms >= 0:
        return int(min(hint_ms, 30_000))
    return min(30_000, 500 * 3**attempt)


def strip(text: str) -> str:
    return text.strip(PY_BLANK)


def one_space(text: str) -> str:
    """Runs of white space as single spaces, none between two Han characters."""
    text = strip(re.sub(f"[{re.escape(PY_BLANK)}]+", " ", text))
    han = "\u2e80-\u2fdf\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
    return re.sub(f"(?<=[{han}]) (?=[{han}])", "", text)
