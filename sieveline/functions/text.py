"""Text expressions that stay in the JVM, and their few Python counterparts."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Lower-case letters that decompose into one base letter and marks, and these base letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if chr(code).islower() and len(base) == 1 and base[0] != chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
#: What trims at the ends of a text: all Unicode white space and the byte-order mark.
BLANK = r"[\s\u0085\p{Z}\x{FEFF}]"
PY_BLANK = "\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(col(c)), ACCENTED, PLAIN)


_HAN = r"\p{IsHan}"
_OTHER = r"[\p{L}\p{N}&&[^\p{IsHan}]]"
#: At the place of each term, the term: a run of other letters and digits, two Han letters, or one that stands alone.
_MIXED = f"(?=((?<!{_OTHER}){_OTHER}+|{_HAN}{{2}}|(?<!{_HAN}){_HAN}(?!{_HAN})))"


def terms(c: Column | str) -> Column:
    """Index terms: folded runs of letters and digits, of Han letters each two that follow one another; null for null."""
    folded = fold(c)
    plain = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.when(folded.rlike(_HAN), F.regexp_extract_all(folded, F.lit(_MIXED), F.lit(1))).otherwise(plain)


def strip_controls(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def trim(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{BLANK}+|{BLANK}+$", "")


def canonical(c: Column | str) -> Column:
    """Trimmed, ideographic spaces as plain ones."""
    return F.translate(trim(c), "　", " ")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(trim(c) == "", F.lit(True))


FNV_BASIS, FNV_PRIME = 2166136261, 16777619
#: UTF-16 units that one numpy step hashes; a longer text takes several.
FENCE_UNITS = 1 << 16


def _fnv(units: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The states of FNV-1a that texts of size[i] > 0 units, one after the other, lead to from state[i].

    The low k bits of a state depend on nothing above them, and the bit above is the exclusive or of the unit's bit and
    of what the lower ones carry, so each bit of all states is one running sum. Once the bits that units reach are
    known, what a unit adds to the state is a number, and the rest is a sum with powers of the prime."""
    starts = np.cumsum(size) - size
    low, carried = np.zeros(len(units), np.uint16), np.zeros(len(units), np.uint16)
    bit = np.zeros(len(units), np.uint8)
    for k in range(int(units.max()).bit_length()):
        bit[1:] = (carried ^ units)[:-1] >> np.uint16(k) & 1
        bit[starts] = 0
        run = np.bitwise_xor.accumulate(bit)
        # what ran over from the text before, and the text's first state
        run ^= np.repeat(run[starts] ^ (state >> np.uint32(k) & 1).astype(np.uint8), size)
        low |= run.astype(np.uint16) << np.uint16(k)
        carried = (low ^ (units & np.uint16((2 << k) - 1))) * np.uint16(FNV_PRIME & 0xFFFF)
        # bit k + 1 of the product is what this one and those below carry
    grown = (low ^ units).astype(np.uint32) - low
    # the bits of low that no unit reaches are 0 in both
    power = np.multiply.accumulate(np.concatenate([[1], np.full(int(size.max()), FNV_PRIME)]).astype(np.uint32), dtype=np.uint32)
    left = np.repeat(starts + size, size) - np.arange(len(units))
    return power[size] * state + np.add.reduceat(grown * power[left], starts, dtype=np.uint32)


def _base36(h: int) -> str:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    while h or not out:
        h, r = divmod(h, 36)
        out = digits[r] + out
    return out


def fence_tokens_py(texts: list[str | None]) -> list[str | None]:
    """fence_token_py() of each text, null for null, many at once: for one short text the loop is faster."""
    raw = [b"" if t is None else t.encode("utf-16-le", "surrogatepass") for t in texts]
    state = np.full(len(raw), FNV_BASIS, np.uint32)
    size = np.array([len(r) // 2 for r in raw], np.int64)
    done = np.zeros(len(raw), np.int64)
    left, at = np.flatnonzero(size), 0
    while at < len(left):
        # as many whole texts as fit, or a piece of one
        fit = max(1, int(np.searchsorted(np.cumsum((size - done)[left[at : at + FENCE_UNITS]]), FENCE_UNITS, "right")))
        some = left[at : at + fit]
        take = np.minimum((size - done)[some], FENCE_UNITS)
        units = np.frombuffer(b"".join(raw[i][2 * d : 2 * (d + n)] for i, d, n in zip(some.tolist(), done[some].tolist(), take.tolist())), np.dtype("<u2")).astype(np.uint16)
        state[some] = _fnv(units, take, state[some])
        done[some] += take
        at += fit if done[some[-1]] == size[some[-1]] else 0
    return [None if t is None else _base36(h) for t, h in zip(texts, state.tolist())]


def fence_token(c: Column | str) -> Column:
    """FNV-1a over the UTF-16 units of a text, in base 36."""

    @F.pandas_udf("string")
    def tokens(part: pd.Series) -> pd.Series:
        return pd.Series(fence_tokens_py(part.tolist()), dtype=object)

    return tokens(col(c))


def fence_token_py(text: str) -> str:
    h = FNV_BASIS
    raw = text.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2])) * FNV_PRIME) & 0xFFFFFFFF
    return _base36(h)


def untrusted_block(preface: Column, text: Column | str) -> Column:
    """A preface, then the text between two fences that its own hash names."""
    fence = F.concat(F.lit("⟦DATA-"), fence_token(text), F.lit("⟧"))
    return F.concat_ws("\n", preface, fence, col(text), fence)


def untrusted_block_py(preface: str, text: str) -> str:
    fence = f"⟦DATA-{fence_token_py(text)}⟧"
    return "\n".join((preface, fence, text, fence))


def truncated(c: Column | str, most: int) -> Column:
    """The first code points of an excerpt."""
    return F.substring(col(c), 1, most)


def escape_cell(c: Column | str) -> Column:
    """A Markdown table cell: backslash, bar and backtick escaped, line breaks as spaces."""
    out = F.regexp_replace(col(c), r"\\", r"\\\\")
    out = F.regexp_replace(F.regexp_replace(out, r"\|", r"\\|"), "`", r"\\`")
    return F.regexp_replace(out, r"[\r\n]+", " ")


def escape_cell_py(text: str) -> str:
    out = text.replace("\\", "\\\\").replace("|", "\\|").replace("`", "\\`")
    return re.sub(r"[\r\n]+", " ", out)


def origin_allowed(url: Column | str, allowed: list[str]) -> Column:
    """Whether scheme://host[:port] of a URL is one of allowed, or its scheme is allowed as scheme://*."""
    origin = F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    ok = F.lit(False)
    for rule in allowed:
        if rule.endswith("://*"):
            ok = ok | (origin.startswith(rule[:-1]) & (F.length(origin) > len(rule) - 1))
        else:
            ok = ok | (origin == rule)
    return ok


def host_allowed(url: Column | str, hosts: list[str]) -> Column:
    """Whether the host of a URL, without port and case, is one of hosts."""
    host = F.lower(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    return host.isin([h.lower() for h in hosts]) if hosts else F.lit(False)


def resource_uri(c: Column | str) -> Column:
    """Whether a text is scheme://kind/name with plain names and no parent steps."""
    text = F.coalesce(col(c), F.lit(""))
    return text.rlike(r"\A[a-z][a-z0-9+.-]*://[a-z][-_0-9a-z]*/[-._0-9A-Za-z]+\z") & ~text.contains("..")
