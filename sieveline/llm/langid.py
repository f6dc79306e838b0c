"""Language ID with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, id_type, light_batches, small, with_id

#: Class 0 is all that is no letter, 1 to 26 the ASCII letters; other letters share the rest by their code, so that
#: those of one alphabet, which follow one another, have classes of their own.
CLASSES = 128
#: Prototypes that the driver gathers and each task holds.
MOST_LANGUAGES = 2000
#: Trigrams whose vectors one matrix product has.
BLOCK = 4096
#: Bundles are added up in this fraction of 1.
SCALE = float(1 << 40)
#: Text that one matrix product handles; less would make the trigrams' vectors too often.
CHUNK_BYTES = 1 << 20


@dataclass(frozen=True)
class Profiles:
    """Random letter vectors of `dim` signs. Prototypes come from at most `train_rows` labelled documents of each
    language, those of least hash. A document is recognised if its best cosine is at least min_cosine and exceeds
    the second by min_margin: above what random letters, hex dumps and other languages reach with 1,024 signs (0.16),
    below all but about one in a thousand labelled documents that weren't taught (0.20)."""

    dim: int = 1024
    train_rows: int = 1000
    min_cosine: float = 0.18
    min_margin: float = 0.05
    seed: int = 42

    def __post_init__(self) -> None:
        if self.dim < 1 or self.train_rows < 1:
            raise ValueError("dim and train_rows must be 1 or more")


@lru_cache(maxsize=2)
def letters(dim: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each class's vector of signs as it is, permuted once and permuted twice: rotation by one place."""
    signs = np.random.default_rng(seed).integers(0, 2, (CLASSES, dim), dtype=np.int8) * 2 - 1
    return signs, np.roll(signs, 1, axis=1), np.roll(signs, 2, axis=1)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all letter trigrams of each text and the text of each; a run of other signs counts as one."""
    lower = ["\n" + t.lower() + "\n" for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
    kind = np.zeros(len(codes), np.int64)
    ascii_letter = (codes >= 97) & (codes <= 122)
    kind[ascii_letter] = codes[ascii_letter] - 96
    other = codes >= 0xAA
    if other.any():
        found, back = np.unique(codes[other], return_inverse=True)
        kind[other] = np.array([27 + c % (CLASSES - 27) if chr(c).isalpha() else 0 for c in found.tolist()])[back]
    keep = kind > 0
    keep[1:] |= kind[:-1] > 0
    kind, owner = kind[keep], owner[keep]
    if len(kind) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # every text begins after a sign that is no letter, so a trigram never needs the text before
    first = np.concatenate([[0], kind[:-2]])
    middle, last = kind[:-1], kind[1:]
    first[np.concatenate([[True], owner[1:-1] != owner[:-2]])] = 0
    ok = (owner[1:] == owner[:-1]) & (middle > 0)
    return ((first * CLASSES + middle) * CLASSES + last)[ok], owner[:-1][ok]


def vectors(texts: list[str], p: Profiles) -> np.ndarray:
    """Each text's bundle: the sum, over all its trigrams, of the product of the letters' permuted vectors."""
    code, owner = trigrams(texts)
    if not len(code):
        return np.zeros((len(texts), p.dim), np.float32)
    place = np.zeros(CLASSES**3, np.int32)
    place[code] = 1
    held = np.flatnonzero(place)
    place[held] = np.arange(len(held))
    at = place[code]
    plain, once, twice = letters(p.dim, p.seed)
    out = np.zeros((len(texts), p.dim), np.float32)
    for low in range(0, len(held), BLOCK):
        some = held[low : low + BLOCK]
        mine = (at >= low) & (at < low + BLOCK)
        counts = np.bincount(owner[mine] * len(some) + (at[mine] - low), minlength=len(texts) * len(some)).reshape(len(texts), len(some)).astype(np.float32)
        grams = twice[some // CLASSES**2] * once[some // CLASSES % CLASSES] * plain[some % CLASSES]
        out += counts @ grams.astype(np.float32)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _bundles(p: Profiles):
    """The sum of each language's unit bundles, one row for each of its numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, texts in chunks(batches, limit=CHUNK_BYTES):
            each = unit(vectors(texts, p).astype(np.float64))
            for lang, v in zip(batch.column("lang").to_pylist(), each):
                sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            # whole numbers add up to the same in any order
            yield pa.RecordBatch.from_arrays([pa.array([lang] * p.dim, pa.string()), pa.array(range(p.dim), pa.int32()), pa.array(np.rint(v * SCALE).astype(np.int64))], ["lang", "k", "part"])

    return run


def train(docs: DataFrame, p: Profiles = Profiles(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A unit prototype for each language that lang_col names; the executors add up the bundles. Null or blank labels,
    null ids and null texts aren't learned from; rows that repeat an id and label come or stay out together; ids may
    be numbers or strings; no labelled rows, no prototypes. More than MOST_LANGUAGES labels are a ValueError."""
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.trim(F.col(f"`{lang_col}`").cast("string")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null and lang <> '' and text is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(p.seed), "id"), "id")
    chosen = named.select("id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= p.train_rows).select("id", "lang").distinct()
    n, langs = chosen.agg(F.count("*"), F.count_distinct("lang")).first()
    if langs > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has {langs} different labels, more than {MOST_LANGUAGES}")
    parts = named.join(small(chosen, n, 64), ["id", "lang"]).mapInArrow(_bundles(p), "lang string, k int, part long")
    sums = parts.groupBy("lang", "k").agg(F.sum("part").alias("part")).toPandas().sort_values(["lang", "k"])
    return {k: unit(g.to_numpy().astype(np.float64)).astype(np.float32) for k, g in sums.groupby("lang")["part"]}


def _classify(p: Profiles, prototypes: dict[str, np.ndarray]):
    """A function from texts to their languages, cosines, margins and whether these are enough."""
    names = sorted(prototypes)
    table = np.stack([prototypes[n] for n in names]).T if names else np.zeros((p.dim, 0), np.float32)

    def classify(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        scores = unit(vectors(texts, p)) @ table
        scores = np.concatenate([scores, np.zeros((len(texts), max(0, 2 - len(names))), np.float32)], axis=1)
        best = scores.argmax(axis=1)
        top = np.sort(scores, axis=1)[:, -2:].astype(np.float64)
        known = (top[:, 1] > 0) & (best < len(names))
        cosine, margin = np.where(known, top[:, 1], 0.0), np.where(known, top[:, 1] - top[:, 0], 0.0)
        langs = [names[i] if k else "und" for i, k in zip(best, known)]
        return langs, cosine, margin, known & (cosine >= p.min_cosine) & (margin >= p.min_margin)

    return classify


def _identify(p: Profiles, prototypes: dict[str, np.ndarray]):
    classify = _classify(p, prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, limit=CHUNK_BYTES):
            langs, cosine, margin, accepted = classify(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(cosine), pa.array(margin), pa.array(accepted)], ["id", "lang", "cosine", "margin", "accepted"])

    return run


def identified(docs: DataFrame, p: Profiles = Profiles(), prototypes: dict[str, np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, lang, cosine, margin, accepted) of each row, from its whole text.

    Without prototypes they are trained on docs. Null texts, empty ones and those without letters are of language
    und with cosine 0 and not accepted; equal cosines leave no margin. Null and repeated ids, numbers or strings, go row by row.
    """
    prototypes = train(docs, p, id_col, text_col, lang_col) if prototypes is None else prototypes
    schema = f"id {id_type(docs, id_col)}, lang string, cosine double, margin double, accepted boolean"
    return with_id(docs, id_col, text_col).mapInArrow(_identify(p, prototypes), schema).withColumnRenamed("id", id_col)


def recognised(docs: DataFrame, p: Profiles = Profiles(), prototypes: dict[str, np.ndarray] | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose language is accepted, lang_col being the language found; other columns as they were."""
    prototypes = train(docs, p, id_col, text_col, lang_col) if prototypes is None else prototypes
    light_batches(docs.sparkSession)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    judged = _judge(p, prototypes)
    out = held.withColumn("_lang", judged(F.col("_text"))).where("_lang is not null")
    kinds = dict(docs.dtypes)
    return out.select(*[F.col("_lang").cast(kinds[c]).alias(c) if c == lang_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


def _judge(p: Profiles, prototypes: dict[str, np.ndarray]):
    """An Arrow UDF: the accepted language of a text, or null. Only the text travels to Python and back."""
    from pyspark.sql.functions import arrow_udf

    classify = _classify(p, prototypes)

    @arrow_udf("string")
    def judged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            batch = pa.RecordBatch.from_arrays([texts], ["text"])
            langs: list[str | None] = []
            for _, some in chunks([batch], limit=CHUNK_BYTES):
                found, _, _, accepted = classify(some)
                langs += [x if a else None for x, a in zip(found, accepted)]
            yield pa.array(langs, pa.string())

    # Spark would push the filter on the result below it, and so judge each text twice
    return judged.asNondeterministic()
