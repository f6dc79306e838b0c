"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_type, light_batches, with_id


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


#: Letters and digits of an IBAN by country.
IBAN_LENGTH = {"AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26}


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@dataclass(frozen=True)
class Rules:
    """Scores of confirmed spans by kind; a word of the kind's context within `window` characters adds `boost`, a word
    of the contrary context takes it away. Spans of `threshold` and more count."""

    scores: dict[str, float] = field(default_factory=lambda: {"EMAIL": 0.9, "CARD": 0.7, "IBAN": 0.9, "PHONE": 0.6, "IP": 0.6, "SSN": 0.45, "SECRET": 0.8})
    threshold: float = 0.5
    window: int = 40
    boost: float = 0.2


CONTEXT = {
    "EMAIL": re.compile(r"\b(?:e-?mail|mail|contact|courriel|correo|kontakt)\b"),
    "CARD": re.compile(r"\b(?:card|visa|credit|debit|mastercard|amex|carte|karte|tarjeta|payment|pay)\b"),
    "IBAN": re.compile(r"\b(?:iban|bank|account|konto|compte|cuenta)\b"),
    "PHONE": re.compile(r"\b(?:phone|call|tel|telephone|mobile|cell|fax|téléphone|telefon|teléfono|contact)\b"),
    "IP": re.compile(r"\b(?:ip|address|host|server|login|adresse|dirección)\b"),
    "SSN": re.compile(r"\b(?:ssn|social security|social|sozialversicherung|sécurité sociale|seguridad social)\b"),
    "SECRET": re.compile(r"\b(?:token|secret|password|passwd|api[ _-]?key|key|bearer|credential)\b"),
}
CONTRARY = {
    "CARD": re.compile(r"\b(?:order|isbn|tracking|invoice|serial|sku)\b"),
    "PHONE": re.compile(r"\b(?:order|isbn|tracking|invoice|serial|sku|version)\b"),
    "IP": re.compile(r"\b(?:version|section|release|chapter)\b"),
    "SSN": re.compile(r"\b(?:order|isbn|part|serial|sku|version)\b"),
    "SECRET": re.compile(r"\b(?:commit|checksum|sha1|sha256|md5|digest)\b"),
}
#: Signs of the local part of an address, other than letters and digits; it can't begin with those of EDGE.
LOCAL = frozenset("!#$%&'*+/=?^_`{|}~.-")
EDGE = frozenset(".-'/{}|`=?^!#$%&*~")
DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
#: Runs of digits and the signs that may part them.
NUMBERS = re.compile(r"[0-9][0-9 ().\- ]{5,}[0-9]")
CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])")
IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])")
_GROUPS = r"(?:(?:[ -][0-9]{2,4}){1,4}|(?:\.[0-9]{2,4}){1,4})(?![0-9]|[.-][0-9])"
PHONE = re.compile(rf"\+[0-9]{{1,3}}(?:[ .-]?\([0-9]{{1,4}}\)[ .-]?|[ .-])[0-9]{{1,4}}{_GROUPS}|\+[0-9]{{8,15}}(?![0-9])|\([0-9]{{2,4}}\)[ .-]?[0-9]{{2,4}}{_GROUPS}|[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}(?![0-9]|[.-][0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SECRET = re.compile(r"[=:][ \t]*[\"']?([A-Za-z0-9_/+.~-]{16,})")
#: What may stand before the sign of an assignment; no longer than NAMED, so that many signs before it are enough.
WORD = re.compile(r"(?:token|secret|passw(?:or)?d|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer|credentials?)[\"']?\Z", re.I)
NAMED = 16
#: Keys that their own prefix betrays.
KEY = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}|glpat-[0-9A-Za-z_-]{20,})(?![0-9A-Za-z])")
KEY_SIGNS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk_live_", "glpat-")
BEGIN = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
END = re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
HEX = frozenset("0123456789abcdefABCDEF:.")


def issued(digits: str) -> bool:
    """Whether a card number of that many digits begins like this."""
    n, two, three, four = len(digits), int(digits[:2]), int(digits[:3]), int(digits[:4])
    return (
        digits[0] == "4" and n in (13, 16, 19)
        or (51 <= two <= 55 or 2221 <= four <= 2720) and n == 16
        or two in (34, 37) and n == 15
        or (300 <= three <= 305 or three == 309 or two in (36, 38, 39)) and n in (14, 16, 19)
        or (four == 6011 or two in (62, 65) or 644 <= three <= 649 or 3528 <= four <= 3589) and 16 <= n <= 19
        or four in (5018, 5020, 5038, 5893, 6304, 6759, 6761, 6762, 6763) and 13 <= n <= 19
    )


def _local(text: str, at: int) -> int:
    """Where the local part of the address begins whose @ is at at; at if there is none. No sign is read twice for
    two addresses, as @ itself isn't part of it."""
    start = at
    while start and ((c := text[start - 1]) in LOCAL or c.isalnum() and c < "\u0250"):
        start -= 1
    while start < at and text[start] in EDGE:
        start += 1
    return start if start < at and (text[at - 1].isalnum() or text[at - 1] in "_+-") else at


def _assigned(text: str, at: int) -> bool:
    """Whether the sign at at follows a word for a secret, with white space between or not."""
    while at and text[at - 1].isspace():
        at -= 1
    return WORD.search(text, max(0, at - NAMED), at) is not None


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what looks like personal data and passes the checks of its kind."""
    at = text.find("@")
    while at >= 0:
        start, domain = _local(text, at), DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield "EMAIL", start, domain.end()
        at = text.find("@", at + 1)
    for run in NUMBERS.finditer(text):
        start, end = run.span()
        for m in CARD.finditer(text, start, end):
            digits = re.sub(r"\D", "", m[0])
            if luhn(digits) and len(set(digits)) > 1 and issued(digits):
                yield "CARD", *m.span()
        for m in IP.finditer(text, start, end):
            try:
                ipaddress.IPv4Address(m[0])
            except ValueError:
                continue
            yield "IP", *m.span()
        for m in SSN.finditer(text, start, end):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                yield "SSN", *m.span()
        # a country code or bracket may stand before the first digit
        before = start
        while before and text[before - 1] in "+(":
            before -= 1
        for m in PHONE.finditer(text, before, end):
            n = sum(c.isdigit() for c in m[0])
            outside = not (m.start() and text[m.start() - 1].isalnum()) and not text[m.end() : m.end() + 1].isalnum()
            if 7 <= n <= 15 and outside:
                yield "PHONE", *m.span()
    for m in IBAN.finditer(text):
        compact, n = m[0].replace(" ", ""), IBAN_LENGTH.get(m[0][:2], 0)
        if n and len(compact) >= n and mod97(compact[:n]):
            end, seen = m.start(), 0
            while seen < n:
                seen += text[end] != " "
                end += 1
            if not text[end : end + 1].isalnum():
                yield "IBAN", m.start(), end
    for m in SECRET.finditer(text):
        value = m[1]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and _assigned(text, m.start()):
            yield "SECRET", m.start(1), m.end(1)
    if any(sign in text for sign in KEY_SIGNS):
        for m in KEY.finditer(text):
            yield "SECRET", *m.span()
    block = BEGIN.search(text)
    while block:
        end = END.search(text, block.end())
        yield "SECRET", block.start(), end.end() if end else block.end()
        block = BEGIN.search(text, end.end()) if end else None
    done = 0
    for m in COLONS.finditer(text):
        if m.start() < done:
            continue
        start, done = m.start(), m.end()
        while start and text[start - 1] in HEX:
            start -= 1
        while done < len(text) and text[done] in HEX:
            done += 1
        value = text[start:done].rstrip(".") if text[done - 1 : done] == "." else text[start:done]
        outside = not (start and text[start - 1].isalnum()) and not text[done : done + 1].isalnum()
        if outside and sum(map(bool, value.split(":"))) >= 3 and any(c.isdigit() for c in value):
            try:
                ipaddress.IPv6Address(value)
            except ValueError:
                continue
            yield "IP", start, start + len(value)


def spans(text: str, rules: Rules = Rules()) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in order, none over another: of such the higher score, then the longer, then the
    earlier stays. Places count code points."""
    scored = []
    for kind, start, end in set(proposals(text)):
        score = rules.scores.get(kind, 0.0)
        around = (text[max(0, start - rules.window) : start] + " " + text[end : end + rules.window]).lower()
        if CONTEXT[kind].search(around):
            score += rules.boost
        if kind in CONTRARY and CONTRARY[kind].search(around):
            score -= rules.boost
        score = round(min(1.0, max(0.0, score)), 6)
        if score >= rules.threshold:
            scored.append((kind, start, end, score))
    kept: list[tuple[int, int, str, float]] = []
    for kind, start, end, score in sorted(scored, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        # those kept don't overlap, so only the two next to a span can be in its way
        at = bisect_left(kept, (start,))
        if (at == len(kept) or end <= kept[at][0]) and (not at or kept[at - 1][1] <= start):
            kept.insert(at, (start, end, kind, score))
    return [(kind, start, end, score) for start, end, kind, score in kept]


def mask(text: str, rules: Rules = Rules()) -> str:
    """text with [KIND] in place of each span."""
    out, at = [], 0
    for kind, start, end, _ in spans(text, rules):
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]]) if at else text


def _find(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            ids, out = [], []
            for i, t in zip(batch.column("id").to_pylist(), texts):
                for kind, start, end, score in spans(t, rules):
                    ids.append(i), out.append((kind, start, end, t[start:end], score))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), *[pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]], ["id", "kind", "start", "stop", "value", "score"])

    return run


def found(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, kind, start, stop, value, score) of each span in each whole text; places count code points from 0.
    Null and empty texts have none; null and repeated ids, numbers or strings, go row by row; no documents, no rows."""
    schema = f"id {id_type(docs, id_col)}, kind string, start int, stop int, value string, score double"
    return with_id(docs, id_col, text_col).mapInArrow(_find(rules), schema).withColumnRenamed("id", id_col)


def masked(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with [KIND] for each span in text_col and, if there is such a column, its new length in length_col where
    that isn't null. No row goes; null texts stay null; other columns are as they were."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([t if t is None else mask(t, rules) for t in texts.to_pylist()], pa.string())

    light_batches(docs.sparkSession)
    out = docs.withColumn(text_col, clean(F.col(f"`{text_col}`").cast("string")))
    if length_col in docs.columns:
        kind = dict(docs.dtypes)[length_col]
        old = F.col(f"`{length_col}`")
        out = out.withColumn(length_col, F.when(old.isNotNull(), F.coalesce(F.length(F.col(f"`{text_col}`")), old)).cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
