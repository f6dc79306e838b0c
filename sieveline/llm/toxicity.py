"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, U, chunks, id_type, lists, mix, span_hashes, with_id, words

#: Terms of a document up to which a round takes its whole rate.
USUAL_TERMS = 10
#: Parts of the labelled documents that are held out in turn.
FOLDS = 5
#: Leading bytes of a word that make a term of their own, so that words of one stem share one.
STEM = 5


@dataclass(frozen=True)
class Machine:
    """A term is a word, or the first STEM bytes of a longer one, hashed to `bits`. Learned from at most train_rows
    labelled documents, those of least hash, each held out once to choose the rounds and the threshold.

    Terms in at least min_docs of them have weights if their own log odds are min_z standard errors from 0, or if the
    presence of some other term shifts theirs by min_pair_z of them; pairs are tried of all terms in pair_docs of the
    documents and more, where so strong an evidence can occur at all. So a term that is harmless alone is kept for the
    company in which it isn't. Fitting ends after `rounds`, or when 10 of them lower the loss by less than
    `tolerance` of it."""

    bits: int = 22
    factors: int = 8
    train_rows: int = 10_000
    min_docs: int = 3
    min_z: float = 2.5
    pair_docs: float = 0.01
    min_pair_z: float = 6.0
    rounds: int = 300
    tolerance: float = 1e-3
    rate: float = 0.1
    decay: float = 0.5
    seed: int = 42

    def __post_init__(self) -> None:
        if not 1 <= self.bits <= 24 or min(self.factors, self.train_rows, self.min_docs, self.rounds) < 1:
            raise ValueError("bits must be in 1..24; factors, train_rows, min_docs and rounds 1 or more")


@dataclass(frozen=True)
class Model:
    terms: np.ndarray
    bias: float
    linear: np.ndarray
    pairs: np.ndarray
    threshold: float
    bits: int
    losses: tuple[float, ...] = ()

    def score(self, term: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """The probability of each of n documents from its distinct places in terms, given with their documents."""
        first = np.full(n, self.bias) + np.bincount(owner, self.linear[term], n)
        v = self.pairs[term]
        sums = np.stack([np.bincount(owner, v[:, f], n) for f in range(v.shape[1])], axis=1)
        squares = np.bincount(owner, (v * v).sum(axis=1), n)
        return 1 / (1 + np.exp(-np.clip(first + 0.5 * ((sums * sums).sum(axis=1) - squares), -60, 60)))


def terms(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed terms of each text, and the text of each."""
    data, starts, ends, owner = words(texts)
    long = ends - starts > STEM
    stems = span_hashes(data, starts[long], starts[long] + STEM)
    hashed = np.concatenate([span_hashes(data, starts, ends), mix(stems + U(1))]) >> U(64 - bits)
    both = np.unique((np.concatenate([owner, owner[long]]).astype(U) << U(32)) | hashed)
    return (both & U(0xFFFFFFFF)).astype(np.int64), (both >> U(32)).astype(np.int64)


def _terms(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            term, owner = terms(texts, bits)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), lists(pa.array(term.astype(np.int32)), np.bincount(owner, minlength=len(texts)))], ["id", "y", "terms"])

    return run


def _errors(toxic: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log odds of toxic out of held documents, half a document added to either kind, and their variance."""
    a, b = np.maximum(toxic, 0) + 0.5, np.maximum(held - toxic, 0) + 0.5
    return np.log(a / b), 1 / a + 1 / b


def _counted(owner: np.ndarray, term: np.ndarray, y: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the documents in train: each entry's document and place among the kinds of terms, these, how many documents
    have each, how many toxic ones, and the truth."""
    seen = train[owner]
    kinds, place = np.unique(term[seen], return_inverse=True)
    owner, truth = (np.cumsum(train) - 1)[owner[seen]], y[train]
    return owner, place, kinds, np.bincount(place).astype(np.float64), np.bincount(place, truth[owner]), truth


def telling_alone(owner: np.ndarray, term: np.ndarray, y: np.ndarray, train: np.ndarray, p: Machine) -> np.ndarray:
    """The terms whose own log odds tell, by the documents in train: see Machine."""
    _, _, kinds, with_term, toxic, truth = _counted(owner, term, y, train)
    (odds, var), (other, other_var) = _errors(toxic, with_term), _errors(truth.sum() - toxic, len(truth) - with_term)
    return kinds[(with_term >= p.min_docs) & (np.abs(odds - other) >= p.min_z * np.sqrt(var + other_var))]


def telling_together(owner: np.ndarray, term: np.ndarray, y: np.ndarray, p: Machine, step: int = 512) -> np.ndarray:
    """The terms that tell in the company of some other: see Machine. Pairs are counted by matrix products of step
    terms each."""
    owner, place, kinds, with_term, toxic, truth = _counted(owner, term, y, np.ones(len(y), bool))
    n, t = float(len(truth)), float(truth.sum())
    keep = np.zeros(len(kinds), bool)
    # a term that nearly all documents have, or lack, can't be told from its absence
    usual = np.flatnonzero((with_term >= p.min_docs) & (np.minimum(with_term, n - with_term) >= p.pair_docs * n))
    at = np.full(len(kinds), -1)
    at[usual] = np.arange(len(usual))
    held = at[place] >= 0
    order = np.argsort(at[place[held]], kind="stable")
    column, row = at[place[held]][order], owner[held][order]
    bounds = np.searchsorted(column, np.arange(0, len(usual) + step, step))
    bad = np.flatnonzero(truth > 0)

    def block(k: int) -> np.ndarray:
        out = np.zeros((len(truth), min(step, len(usual) - k * step)), np.float32)
        out[row[bounds[k] : bounds[k + 1]], column[bounds[k] : bounds[k + 1]] - k * step] = 1
        return out

    for i in range(len(bounds) - 1):
        x = block(i)
        a = usual[i * step : i * step + x.shape[1]]
        for j in range(i, len(bounds) - 1):
            z = x if i == j else block(j)
            b = usual[j * step : j * step + z.shape[1]]
            both, both_toxic = x.T @ z, x[bad].T @ z[bad]
            first, second, first_toxic, second_toxic = with_term[a][:, None], with_term[b][None], toxic[a][:, None], toxic[b][None]
            cells = [_errors(both_toxic, both), _errors(first_toxic - both_toxic, first - both), _errors(second_toxic - both_toxic, second - both), _errors(t - first_toxic - second_toxic + both_toxic, n - first - second + both)]
            shift = cells[0][0] - cells[1][0] - cells[2][0] + cells[3][0]
            strong = np.abs(shift) >= p.min_pair_z * np.sqrt(sum(v for _, v in cells))
            if i == j:
                np.fill_diagonal(strong, False)
            keep[a] |= strong.any(axis=1)
            keep[b] |= strong.any(axis=0)
    return kinds[keep]


def _runs(key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """other in the order of key, where each run of equal keys starts, and those keys."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    return other[order], starts, key[order][starts]


def _added(rows: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """For each of n keys the sum of the rows that its run names."""
    named, starts, keys = runs
    out = np.zeros((n, rows.shape[1]))
    if len(named):
        out[keys] = np.add.reduceat(rows[named], starts, axis=0)
    return out


def gradients(state: dict[str, np.ndarray], x: np.ndarray, o: np.ndarray, target: np.ndarray, decay: float, runs: tuple | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """The mean log loss over documents with the terms x of documents o, with half the sum of the squared weights by
    decay, shared out over the documents: the loss of weights that are normal with variance 1 / decay before anything
    is known. And its gradient by bias, linear and pair weights. runs, of x by o and of o by x, saves sorting again."""
    by_document, by_term = runs or (_runs(o, x), _runs(x, o))
    m, n, v = len(target), len(state["w"]), state["v"]
    whole = _added(np.column_stack([state["w"], (v * v).sum(axis=1), v]), by_document, m)
    sums = whole[:, 2:]
    logit = state["b"][0] + whole[:, 0] + 0.5 * ((sums * sums).sum(axis=1) - whole[:, 1])
    loss = np.logaddexp(0, np.where(target > 0, -logit, logit)).mean() + 0.5 * decay * ((state["w"] ** 2).sum() + (v**2).sum()) / m
    error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - target) / m
    back = _added(np.column_stack([error, error[:, None] * sums]), by_term, n)
    return float(loss), {"b": np.array([error.sum()]), "w": back[:, 0] + decay * state["w"] / m, "v": back[:, 1:] - back[:, :1] * v + decay * v / m}


def _model(kinds: np.ndarray, state: dict[str, np.ndarray], p: Machine) -> Model:
    return Model(kinds, float(state["b"][0]), state["w"], state["v"], 0.5, p.bits)


def _descend(kinds: np.ndarray, owner: np.ndarray, term: np.ndarray, y: np.ndarray, train: np.ndarray, p: Machine, rounds: int) -> tuple[Model, int, np.ndarray]:
    """The model after so many rounds over the documents in train, or after the one of least log loss over the others
    if there are any; which round that was; and the others' scores."""
    at = np.minimum(np.searchsorted(kinds, term), len(kinds) - 1)
    known = kinds[at] == term
    owner, term = owner[known], at[known]
    seen, held = train[owner], ~train[owner]
    x, o, target, truth = term[seen], (np.cumsum(train) - 1)[owner[seen]], y[train], y[~train] > 0
    aside = (term[held], (np.cumsum(~train) - 1)[owner[held]], len(truth))
    state = {"b": np.array([np.log(target.mean() / (1 - target.mean()))]), "w": np.zeros(len(kinds)), "v": np.random.default_rng(p.seed).normal(0, 0.01, (len(kinds), p.factors))}
    moments = {k: (np.zeros_like(s), np.zeros_like(s)) for k, s in state.items()}
    # each round moves all weights by about as much, and a document's score by that for each of its terms
    rate = p.rate / max(1.0, len(x) / len(target) / USUAL_TERMS)
    losses: list[float] = []
    runs = _runs(o, x), _runs(x, o)
    best = (np.inf, rounds, state)
    for step in range(1, rounds + 1):
        loss, grads = gradients(state, x, o, target, p.decay, runs)
        losses.append(loss)
        if len(truth):
            score = np.clip(_model(kinds, state, p).score(*aside), 1e-9, 1 - 1e-9)
            best = min(best, (-np.log(np.where(truth, score, 1 - score)).mean(), step, state), key=lambda b: b[0])
            if step > 20 and min(losses[:-10]) - min(losses[-10:]) < p.tolerance * min(losses[:-10]):
                break
        for k, g in grads.items():
            first, second = moments[k]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            state = {**state, k: state[k] - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)}
    model = replace(_model(kinds, best[2] if len(truth) else state, p), losses=tuple(losses))
    return model, best[1], model.score(*aside)


def fit(rows: list[np.ndarray], y: np.ndarray, p: Machine = Machine()) -> Model:
    """A model from each document's distinct terms and whether it is toxic; without both kinds nothing is toxic.

    Each of FOLDS parts of the documents is held out once. The threshold is the one of best F1 over the scores that
    documents get while held out; all are then learned in as many rounds as gave the least log loss over those held
    out, in the median part. losses is the loss of the others, round by round, the first time.
    """
    empty = Model(np.zeros(0, np.int64), -60.0, np.zeros(0), np.zeros((0, p.factors)), 0.5, p.bits)
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return empty
    owner, term = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)
    everyone, part = np.ones(len(y), bool), np.random.default_rng(p.seed).integers(0, FOLDS, len(y))
    together = telling_together(owner, term, y, p)
    kinds = np.union1d(telling_alone(owner, term, y, everyone, p), together)
    if not len(kinds):
        return empty
    score, rounds, losses = np.full(len(y), np.nan), [], ()
    for k in range(FOLDS):
        train = part != k
        some = np.union1d(telling_alone(owner, term, y, train, p), together)
        if not train.all() and len(some) and y[train].min() < y[train].max():
            model, best, score[~train] = _descend(some, owner, term, y, train, p, p.rounds)
            rounds, losses = [*rounds, best], losses or model.losses
    model = _descend(kinds, owner, term, y, everyone, p, int(np.median(rounds)) if rounds else p.rounds)[0]
    toxic, most, threshold = y > 0, 0.0, 0.5
    for cut in np.arange(0.05, 0.96, 0.05) if rounds else ():
        f1 = 2 * (toxic & (score >= cut)).sum() / max(1, toxic[~np.isnan(score)].sum() + (score >= cut).sum())
        if f1 > most + 1e-9:
            most, threshold = f1, float(round(cut, 2))
    return replace(model, threshold=threshold, losses=losses or model.losses)


def train(docs: DataFrame, labels: DataFrame, p: Machine = Machine(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labels (id_col, label_col 0 or 1). Null ids, labels and texts aren't learned from; the greatest of
    several labels of an id counts, and of several texts of it one."""
    y = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    y = y.orderBy(F.xxhash64(F.lit(p.seed), "id"), "id").limit(p.train_rows)
    if p.train_rows * 24 <= BROADCAST_BYTES:
        y = F.broadcast(y)
    rows = with_id(docs, id_col, text_col).where("text is not null").join(y, "id")
    got = rows.mapInArrow(_terms(p.bits), f"id {id_type(docs, id_col)}, y int, terms array<int>").toArrow()
    table = got.sort_by("id") if got.num_rows else got
    ids, column = np.array(table.column("id").to_pylist()), table.column("terms").combine_chunks()
    if not len(ids):
        return fit([], np.zeros(0), p)
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return fit([values[offsets[i] : offsets[i + 1]] for i in first], table.column("y").to_numpy()[first] > 0, p)


def _score(model: Model, all_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << model.bits, np.int32)
        known[model.terms] = np.arange(1, len(model.terms) + 1)
        for batch, texts in chunks(batches):
            data, starts, ends, owner = words(texts)
            long = ends - starts > STEM
            stems = span_hashes(data, starts[long], starts[long] + STEM)
            hashed = (np.concatenate([span_hashes(data, starts, ends), mix(stems + U(1))]) >> U(64 - model.bits)).astype(np.int64)
            place = known[hashed].astype(np.int64)
            hit = place > 0
            both = np.unique((np.concatenate([owner, owner[long]])[hit] << 32) | (place[hit] - 1))
            score = model.score(both & 0xFFFFFFFF, both >> 32, len(texts))
            flag = score >= model.threshold
            pick = pa.array(np.ones(len(texts), bool) if all_rows else flag)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pick), pa.array(score).filter(pick), pa.array(flag).filter(pick)], ["id", "score", "toxic"])

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, toxic) of each row from its whole text; null and empty texts have no terms and the score of
    the bias alone; null and repeated ids go row by row."""
    return with_id(docs, id_col, text_col).mapInArrow(_score(model, True), f"id {id_type(docs, id_col)}, score double, toxic boolean").withColumnRenamed("id", id_col)


def flagged(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of scored() that are toxic."""
    return with_id(docs, id_col, text_col).mapInArrow(_score(model, False), f"id {id_type(docs, id_col)}, score double, toxic boolean").withColumnRenamed("id", id_col)
