"""Weighted URL vocabulary: one strict term, or several distinct soft ones of enough weight, reject a URL."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type

#: Columns term, host, path, kind.
DEFAULT = Path(__file__).with_name("url_terms.csv")
#: Terms that a vocabulary may have, as each task holds all.
MOST_TERMS = 1_000_000
#: The host of a URL, with what stands before it; the scheme may lack.
HOST = r"^(?:(?:[a-z][a-z0-9+.-]*:)?//)?(?:[^/?#]*@)?([^/?#:]*)"
_HOST = re.compile(HOST)


@dataclass(frozen=True)
class Term:
    """What it weighs in the host and in the rest of the URL. It counts where no letter or digit touches it or, if
    inside, anywhere in the host."""

    term: str
    host: float
    path: float
    inside: bool = False


@dataclass(frozen=True)
class Vocabulary:
    """A term that weighs 1 or more where it stands is strict there, any other soft. Shields are words in which no term
    is sought. soft_needed distinct soft terms whose weights make 1 reject a URL."""

    terms: tuple[Term, ...]
    shields: tuple[str, ...] = ()
    soft_needed: int = 2

    def __post_init__(self) -> None:
        words = [t.term for t in self.terms] + list(self.shields)
        if self.soft_needed < 1 or not all(w and w == w.lower() for w in words) or len(words) > MOST_TERMS:
            raise ValueError(f"soft_needed must be 1 or more, words lower case and not empty, {MOST_TERMS} at most")
        if len(set(words)) < len(words) or not all(t.host >= 0 and t.path >= 0 for t in self.terms):
            raise ValueError("words must be different, weights 0 or more")


@lru_cache(maxsize=4)
def load(path: str = str(DEFAULT), soft_needed: int = 2) -> Vocabulary:
    """The vocabulary of a file with the columns of DEFAULT; kind is inside, shield or empty."""
    with open(path, newline="", encoding="utf-8") as f:
        return _vocabulary([(r["term"], r["host"], r["path"], r["kind"]) for r in csv.DictReader(f)], soft_needed)


def from_table(table: DataFrame, soft_needed: int = 2) -> Vocabulary:
    """The vocabulary of a table with the columns of DEFAULT, of at most MOST_TERMS rows; rows of null terms are none."""
    rows = table.where("term is not null").select("term", "host", "path", "kind").limit(MOST_TERMS + 1).collect()
    return _vocabulary([tuple(r) for r in rows], soft_needed)


def _vocabulary(rows: list[tuple], soft_needed: int) -> Vocabulary:
    kinds = [(str(t).strip(), float(h or 0), float(p or 0), k or "") for t, h, p, k in rows]
    return Vocabulary(tuple(Term(t, h, p, k == "inside") for t, h, p, k in kinds if k != "shield"), tuple(t for t, _, _, k in kinds if k == "shield"), soft_needed)


@lru_cache(maxsize=4)
def automaton(v: Vocabulary):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in v.terms:
        found.add_word(t.term, t)
    for word in v.shields:
        found.add_word(word, None)
    found.make_automaton()
    return found


def _held(part: str, v: Vocabulary, host: bool) -> set[Term]:
    """The terms that count in a part of a URL."""
    spans = [(end + 1 - len(t.term), end + 1, t) for end, t in automaton(v).iter(part) if t is not None]
    if not spans:
        return set()
    for word in sorted(v.shields, key=lambda w: (-len(w), w)):
        part = part.replace(word, "\0" * len(word))
    edge = lambda s, e: not (s and part[s - 1].isalnum()) and not part[e : e + 1].isalnum()
    return {t for s, e, t in spans if part.startswith(t.term, s) and (host and t.inside or edge(s, e))}


def hits(url: str, v: Vocabulary) -> tuple[list[str], list[str], float]:
    """The distinct strict and soft terms in url, each sorted, and the sum of their weights, where a term weighs what
    it does in its heavier place."""
    url = unquote(url, errors="replace").lower()
    if not len(automaton(v)):
        return [], [], 0.0
    at = _HOST.match(url).end(1) if _HOST.match(url) else 0
    host = url[_HOST.match(url).start(1) : at]
    weights: dict[str, float] = {}
    for t in _held(host, v, True):
        weights[t.term] = t.host
    for t in _held(url[at:], v, False):
        weights[t.term] = max(weights.get(t.term, 0.0), t.path)
    weights = {t: w for t, w in weights.items() if w > 0}
    return sorted(t for t, w in weights.items() if w >= 1), sorted(t for t, w in weights.items() if w < 1), sum(weights.values())


def _judge(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hits(u or "", v) for u in batch.column("url").to_pylist()]
            reject = [bool(a) or len(b) >= v.soft_needed and w >= 1 for a, b, w in found]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), *lists, pa.array([f[2] for f in found], pa.float64()), pa.array(reject, pa.bool_())], ["id", "url", "strict", "soft", "weight", "rejected"])

    return run


def judged(pages: DataFrame, v: Vocabulary | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, url, strict, soft, weight, rejected) of each row, by default with the vocabulary of DEFAULT. Matching
    ignores case and undoes percent escapes. A null or empty URL has no hits and isn't rejected; null and repeated
    ids, numbers or strings, are carried along, row by row."""
    v = load() if v is None else v
    schema = f"id {id_type(pages, id_col)}, url string, strict array<string>, soft array<string>, weight double, rejected boolean"
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    return rows.mapInArrow(_judge(v), schema).withColumnRenamed("id", id_col)
