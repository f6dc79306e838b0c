"""Markdown sections and overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PY_BLANK, is_blank

SIZE, OVERLAP, LEAST, MOST = 1000, 200, 100, 4000
HEADING = re.compile(r"(?P<marks>#{1,4})\s+(?P<title>.+?)\s*\Z")
SEPARATORS = ("\n\n", "\n", " ", "")


def check(size: int, overlap: int) -> None:
    for name, value in (("size", size), ("overlap", overlap)):
        if isinstance(value, bool) or not isinstance(value, int):
            raise ValueError(f"{name} must be a whole number")
    if not LEAST <= size <= MOST or not 0 <= overlap < size:
        raise ValueError(f"size must be from {LEAST} to {MOST}, overlap from 0 to below size")


def sections(text: str) -> list[tuple[str | None, str]]:
    """(titles, body) of the regions between headings of level 1 to 4, blank ones left out.

    titles joins the headings in force with ' > '; None before the first. Lines within ``` or ~~~ fences are body;
    a fence ends at the next line that begins with three of its sign.
    """
    found: list[tuple[str | None, str]] = []
    stack: list[tuple[int, str]] = []
    body: list[str] = []
    fence = ""

    def close() -> None:
        content = "\n".join(body).strip(PY_BLANK)
        if content:
            found.append((" > ".join(t for _, t in stack) or None, content))
        body.clear()

    for line in text.split("\n"):
        mark = line[:3]
        if fence:
            fence = "" if mark == fence else fence
        elif mark in ("```", "~~~"):
            fence = mark
        elif m := HEADING.match(line):
            close()
            level = len(m["marks"])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, m["title"]))
            continue
        body.append(line)
    close()
    return found


def split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters: broken at paragraphs, else lines, spaces or anywhere, packed greedily; each
    begins with up to overlap characters of whole parts that end the piece before."""
    if len(text) <= size:
        return [text.strip(PY_BLANK)] if text.strip(PY_BLANK) else []
    sep, rest = next((s, separators[i + 1 :]) for i, s in enumerate(separators) if not s or s in text)
    if not sep:
        step = size - overlap
        return [p for i in range(0, max(1, len(text) - overlap), step) if (p := text[i : i + size].strip(PY_BLANK))]
    pieces: list[str] = []
    held: list[str] = []
    total = 0

    def flush() -> None:
        joined = sep.join(held).strip(PY_BLANK)
        if joined:
            pieces.append(joined)

    for part in text.split(sep):
        if len(part) > size:
            flush()
            held, total = [], 0
            pieces += split(part, size, overlap, rest)
            continue
        if held and total + len(sep) + len(part) > size:
            flush()
            while held and (total > overlap or total + len(sep) + len(part) > size):
                total -= len(held.pop(0)) + (len(sep) if held else 0)
            total = max(0, total)
        total += len(part) + (len(sep) if held else 0)
        held.append(part)
    flush()
    return pieces


def chunk(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str | None, str]]:
    """(section, content) of the chunks of a Markdown text."""
    check(size, overlap)
    return [(title, piece) for title, body in sections(text) for piece in split(body, size, overlap)]


def chunked(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, chunk_ix, section, content) of each text's chunks, chunk_ix from 0. Null and blank texts have
    none. In Arrow batches, as the heading stack is sequential."""
    check(size, overlap)
    kinds = dict(docs.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(*row[:-1], i, title, content) for row in pdf.itertuples(index=False, name=None) if isinstance(row[-1], str) for i, (title, content) in enumerate(chunk(row[-1], size, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, *keep, "chunk_ix", "section", "content"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (id_col, *keep)] + ["chunk_ix int", "section string", "content string"])
    return docs.where(~is_blank(text_col)).select(id_col, *keep, F.col(text_col).alias("_text")).mapInPandas(run, schema)


def sectioned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, section_ix, section, content) of the sections of each text, section_ix from 0."""
    kinds = dict(docs.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, k, title, body) for i, text in pdf.itertuples(index=False, name=None) if isinstance(text, str) for k, (title, body) in enumerate(sections(text))]
            yield pd.DataFrame(rows, columns=[id_col, "section_ix", "section", "content"])

    schema = f"`{id_col}` {kinds[id_col]}, section_ix int, section string, content string"
    return docs.where(~is_blank(text_col)).select(id_col, F.col(text_col).alias("_text")).mapInPandas(run, schema)


def page_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(source, page, chunk_ix, section, content) of pages (source, page, text). Each page starts without headings."""
    return chunked(pages, size, overlap, id_col="source", keep=("page",))


def window_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, chunk_ix, content): windows of size characters, each overlap into the one before; all in the JVM."""
    check(size, overlap)
    step = size - overlap
    n = F.length(text_col)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(step))
    held = docs.where(n > 0).select(id_col, F.col(text_col).alias("_text"), F.posexplode(starts).alias("chunk_ix", "_at"))
    return held.select(id_col, "chunk_ix", F.col("_text").substr(F.col("_at") + 1, F.lit(size)).alias("content"))


def stitched(prefix: Column, content: Column) -> Column:
    """The prefix, an empty line and the content; the content alone for an empty or null prefix."""
    return F.when(F.coalesce(prefix, F.lit("")) == "", content).otherwise(F.concat(prefix, F.lit("\n\n"), content))


def caption_pages(pages: DataFrame, text_col: str = "text", least_chars: int = 90, wanted: Column | None = None) -> DataFrame:
    """The pages to caption: those with fewer than least_chars trimmed characters, or those that wanted holds for."""
    from ..functions.text import trim

    return pages.where(wanted if wanted is not None else F.coalesce(F.length(trim(text_col)), F.lit(0)) < least_chars)
