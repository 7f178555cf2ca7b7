"""Convolutional text classifier for toxicity: hashed word embeddings, several filter widths, max pooling.

A word's embedding is the sum of three of a fixed number of rows, which hashes of the word, of its first bytes and of its
last bytes pick, so that a rare word is known by its parts. Filters of several widths run over consecutive words, each
filter's largest response in the text is kept, and a logistic layer turns those into a probability. All is trained in
numpy on a bounded sample of labelled rows of any length, in which the labels' shares are not those of all labelled rows:
the intercept is shifted and the calibration weighted by the true shares. A threshold is then calibrated for each
language, as guessed from the text's own function words (texts without any are a group of their own), and the score is
shifted so that 0.7 is that threshold for every language. Thresholds of few rows are drawn to the common one, and that to
what the network itself expects, by a fixed number of rows; no number of rows switches anything on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import Words, hash_spans, mapped, slices

DECISION = 0.7
PRIOR = 20  # rows by which a threshold is drawn to the one of a larger group
_WORDS, _EDGES = 18, 16  # bits of the slots of whole words, and of their beginnings and ends
_EDGE = 6  # bytes of a beginning or end
# fixed values: common function words, to guess a text's language for calibration
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as on are this be by at from or an",
    "fr": "le la les de des du et en un une est que qui dans pour pas sur au avec par ce",
    "de": "der die das und in zu den mit von ist nicht ein eine auf dem sich im für als auch bei",
    "es": "el la los las de y en que un una es por con para del se su al no lo como",
}


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token of each word (its three slots in one number), offsets of the texts in them, and each text's guessed language."""
    words = Words(texts)
    order = np.argsort(_FUNCTION)
    at = np.minimum(np.searchsorted(_FUNCTION[order], words.hashes), len(order) - 1)
    known = _FUNCTION[order][at] == words.hashes
    owner = np.repeat(np.arange(len(words)), np.diff(words.offsets))[known]
    votes = [np.bincount(owner, _VOTES[order][at[known], k], minlength=len(words)) for k in range(len(_NAMES))]
    first = hash_spans(words.low, words.starts, np.minimum(words.starts + _EDGE, words.ends))
    last = hash_spans(words.low, np.maximum(words.ends - _EDGE, words.starts), words.ends)
    low = lambda h, bits: h & np.uint64((1 << bits) - 1)
    tokens = low(words.hashes, _WORDS) << np.uint64(2 * _EDGES) | low(first, _EDGES) << np.uint64(_EDGES) | low(last, _EDGES)
    votes.append(np.full(len(words), 1e-6))  # more than no vote: texts of no known language
    return tokens, words.offsets, np.argmax(np.stack(votes, axis=1), axis=1)


def _rows(tokens: np.ndarray) -> np.ndarray:
    """Rows of the embedding that each token is the sum of: the word's, its beginning's and its end's."""
    edge = np.uint64((1 << _EDGES) - 1)
    parts = tokens >> np.uint64(2 * _EDGES), (tokens >> np.uint64(_EDGES) & edge) + np.uint64(1 << _WORDS), (tokens & edge) + np.uint64((1 << _WORDS) + (1 << _EDGES))
    return np.stack(parts, axis=1).astype(np.int64)


_NAMES = list(FUNCTION_WORDS)
_VOCABULARY = sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})
_FUNCTION = Words(pa.array([" ".join(_VOCABULARY)])).hashes
_VOTES = np.asarray([[w in FUNCTION_WORDS[name].split() for name in _NAMES] for w in _VOCABULARY], np.float32)
_VOTES /= np.maximum(_VOTES.sum(1, keepdims=True), 1)


@dataclass
class Network:
    """Trained weights; a word's embedding is the sum of three rows of ``embedding``."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray

    def vectors(self, tokens: np.ndarray) -> np.ndarray:
        return self.embedding[_rows(tokens)].sum(1)


def _pooled(net: Network, x: np.ndarray, which: np.ndarray, offsets: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's largest response of each filter, at least 0; and, if asked for, where it is.

    The texts' words are ``x[which]``. What a filter adds beyond a text's last word is nothing.
    """
    n = len(offsets) - 1
    parts, places = [], []
    full = np.flatnonzero(np.diff(offsets) > 0)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    for w, f in net.filters.items():
        response = (x @ f[0])[which]
        for j in range(1, min(w, len(which))):
            inside = owner[:-j] == owner[j:]
            response[:-j] += (x @ f[j])[which[j:]] * inside[:, None]
        top = np.zeros((n, response.shape[1]), np.float32)
        if len(full):
            top[full] = np.maximum.reduceat(response, offsets[:-1][full])
        if where:
            at, k = np.nonzero(response == top[owner])
            place = np.full(top.shape, -1)
            place[owner[at][::-1], k[::-1]] = at[::-1]
            places.append(place)
        parts.append(np.maximum(top + net.bias[w], 0))
    return np.concatenate(parts, axis=1), places


def _logit(net: Network, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    one, which = np.unique(tokens, return_inverse=True)
    return _pooled(net, net.vectors(one), which, offsets)[0] @ net.out + net.out_bias


class _Adam:
    """Adam for one array; ``rows`` restricts a step to those rows."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.steps = value, rate, 0
        self.m, self.v = np.zeros_like(value), np.zeros_like(value)

    def step(self, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.steps += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * gradient
        self.v[rows] = 0.999 * self.v[rows] + 0.001 * gradient * gradient
        scale = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        self.value[rows] -= scale * self.m[rows] / (np.sqrt(self.v[rows]) + 1e-8)


def _log_odds(words: list[np.ndarray], y: np.ndarray, size: int, least: int) -> np.ndarray:
    """How much oftener texts with label 1 hold each slot, as a logarithm; 0 for slots in fewer than ``least`` texts."""
    seen = np.zeros((2, size), np.int64)
    for own, label in zip(words, y.astype(int).tolist()):
        seen[label, np.unique(_rows(own))] += 1
    n = np.bincount(y.astype(int), minlength=2)
    odds = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
    return np.where(seen.sum(0) >= least, odds, 0.0)


def encode(rows: DataFrame) -> DataFrame:
    """(text, y, order) -> y, order, language and tokens (8 bytes a word): what leaves a task for learning instead of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                tokens, offsets, language = _tokens(part.column("text"))
                lists = [tokens[a:z].tobytes() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("y"), part.column("order"), pa.array(language), pa.array(lists, pa.binary())], ["y", "order", "language", "tokens"])

    source = rows.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("y").cast("int").alias("y"), F.col("order").cast("long").alias("order"))
    return source.mapInArrow(run, "y int, order long, language long, tokens binary")


def train(rows: DataFrame, totals: tuple[int, int] | None = None, **options: object) -> Network:
    """Learn from ``rows`` (text, y, order), a bounded sample of labelled rows (see :func:`docloom.llm.labelled.sample`).

    Words are hashed in tasks; the driver gets 8 bytes for each. ``totals`` counts the labels 0 and 1 in all that the
    rows are a sample of (default: the rows themselves). ``options`` are those of :func:`learn`.
    """
    found = encode(rows.filter("y in (0, 1)")).toArrow().sort_by("order")
    words = [np.frombuffer(t.as_buffer() or b"", np.uint64) for t in found.column("tokens")]
    return learn(words, found.column("y").to_numpy().astype(np.float32), found.column("language").to_numpy(), totals, **options)


def learn(words: list[np.ndarray], y: np.ndarray, language: np.ndarray, totals: tuple[int, int] | None = None, widths: tuple[int, ...] = (1, 2, 3), filters: int = 8, size: int = 8, epochs: int = 4, least: int = 4, seed: int = 7) -> Network:
    """Fit by Adam on the logistic loss; a fifth of the rows only calibrates the thresholds.

    An embedding's first number begins as the slot's log-odds in the rows fitted to, the others at random; slots that the
    rows don't hold stay 0.
    """
    rng = np.random.default_rng(seed)
    slots = (1 << _WORDS) + (2 << _EDGES)
    order = rng.permutation(len(y))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    net = Network(
        np.zeros((slots, size), np.float32),
        {w: rng.normal(0, 0.3 / np.sqrt(w), (w, size, filters)).astype(np.float32) for w in widths},
        {w: np.zeros(filters, np.float32) for w in widths},
        np.abs(rng.normal(0, 0.3, filters * len(widths))).astype(np.float32),
        -1.0,
        np.zeros(len(_NAMES) + 1, np.float32),
    )
    if len(set(y[fit].tolist())) < 2:
        net.out[:], net.out_bias = 0, 4.0 if len(y) and y.mean() > 0.5 else -4.0
        return net
    held_slots = np.zeros(slots, bool)
    for i in fit:
        held_slots[_rows(words[i])] = True
    known = np.flatnonzero(held_slots)
    net.embedding[known] = rng.normal(0, 0.02, (len(known), size))
    net.embedding[:, 0] += _log_odds([words[i] for i in fit], y[fit], slots, least) / 4
    for f in net.filters.values():
        f[:, 0] = np.abs(f[:, 0])  # to begin with, filters answer to words of the label
    base = np.asarray([net.out_bias], np.float32)
    embedding, bias, out = _Adam(net.embedding, 0.005), {w: _Adam(net.bias[w], 0.02) for w in widths}, _Adam(net.out, 0.02)
    shape, floor = {w: _Adam(net.filters[w], 0.02) for w in widths}, _Adam(base, 0.02)
    size_of_batch = max(16, min(128, len(fit) // 16))
    for _ in range(max(epochs, 300 * size_of_batch // len(fit))):  # a small sample is passed more often
        rng.shuffle(fit)
        for batch in np.array_split(fit, max(1, len(fit) // size_of_batch)):
            sub = _rows(np.concatenate([words[i] for i in batch]))
            at = np.concatenate([[0], np.cumsum([len(words[i]) for i in batch])])
            shown = (rng.random(len(sub)) >= 0.1).astype(np.float32)  # some words are hidden, so that no text is learned by heart
            x = net.embedding[sub].sum(1) * shown[:, None]
            pooled, places = _pooled(net, x, np.arange(len(x)), at, where=True)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + base[0], -30, 30)))
            g = ((p - y[batch]) / len(batch)).astype(np.float32)
            d_pool = g[:, None] * net.out * (pooled > 0)
            touched, grads = [], []
            for k, (w, place) in enumerate(zip(widths, places)):
                own = d_pool[:, k * filters : (k + 1) * filters]
                text, f = np.nonzero((place >= 0) & (own != 0))
                spot, grad = place[text, f], own[text, f]
                d_filter = np.zeros_like(net.filters[w])
                for j in range(w):
                    ok = spot + j < at[text + 1]
                    word = spot[ok] + j
                    np.add.at(d_filter, (j, slice(None), f[ok]), grad[ok, None] * x[word])
                    touched.append(word)
                    grads.append(grad[ok, None] * net.filters[w][j][:, f[ok]].T * shown[word, None])
                shape[w].step(d_filter)
                bias[w].step(own.sum(0))
            out.step(pooled.T @ g + 1e-4 * net.out)
            floor.step(g.sum(keepdims=True))
            touched_rows, which = np.unique(sub[np.concatenate(touched)].ravel(), return_inverse=True)
            total = np.zeros((len(touched_rows), size), np.float32)
            np.add.at(total, which.ravel(), np.repeat(np.concatenate(grads), 3, axis=0))
            embedding.step(total + 1e-5 * net.embedding[touched_rows], touched_rows)
    odds = _odds(y, totals)
    net.out_bias = float(base[0] + np.log(odds))
    z = np.zeros(len(held), np.float32)
    for a in range(0, len(held), 256):
        own = held[a : a + 256]
        z[a : a + 256] = _logit(net, np.concatenate([words[i] for i in own]), np.concatenate([[0], np.cumsum([len(words[i]) for i in own])]))
    expected = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # shares of label 1 among all rows, by the network
    ones = np.where(y[held] == 1, odds, 0.0)
    zeros = np.where(y[held] == 1, 0.0, 1.0)
    drawn = PRIOR / max(len(held), 1) * (ones + zeros)
    ones, zeros, both = np.concatenate([ones, drawn * expected]), np.concatenate([zeros, drawn * (1 - expected)]), np.concatenate([z, z])
    for k in range(len(net.thresholds)):
        own = np.concatenate([language[held] == k, np.zeros(len(held), bool)])
        weight = own + PRIOR / max(len(held) + PRIOR, 1)
        net.thresholds[k] = _best(both, weight * ones, weight * zeros)
    return net


def _odds(y: np.ndarray, totals: tuple[int, int] | None) -> float:
    """How many rows of ``totals`` a row with label 1 stands for, over how many one with label 0 does."""
    if not totals or not all(totals):
        return 1.0
    ones = (y == 1).sum()
    return float(totals[1] / ones / (totals[0] / (len(y) - ones)))


def _threshold(z: np.ndarray, y: np.ndarray, odds: float = 1.0) -> float:
    """The logit with the best F1, a row with label 1 counting ``odds`` times as much as one with label 0."""
    return _best(z, np.where(y == 1, odds, 0.0), np.where(y == 1, 0.0, 1.0))


def _best(z: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float:
    """The logit with the best F1, in the middle of its gap, by the masses of both labels at each; 0 if label 1 has none."""
    if not ones.sum():
        return 0.0
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(ones[order])
    f1 = 2 * hits / (np.cumsum((ones + zeros)[order]) + hits[-1])
    f1[:-1][z[order][:-1] == z[order][1:]] = 0
    k = int(np.argmax(f1))
    return float((z[order][k] + z[order][min(k + 1, len(z) - 1)]) / 2)


def scores(net: Network, texts: pa.Array) -> np.ndarray:
    """Calibrated scores; an empty text's is that of no response."""
    tokens, offsets, language = _tokens(texts)
    shifted = _logit(net, tokens, offsets) - net.thresholds[language] + np.log(DECISION / (1 - DECISION))
    return 1 / (1 + np.exp(-np.clip(shifted.astype(np.float64), -30, 30)))


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: more likely toxic) and ``predicted`` (1 from 0.7 on).

    Null texts score as empty ones. Whole texts are read, of any length. An empty table gives none; repeated rows get the
    same score each. Columns named score or predicted are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                found = scores(net, part.column("__text"))
                columns = [part.column(c) for c in part.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], [*[c for c in part.schema.names if c != "__text"], "score"])

    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    return mapped(source, run, "score double").withColumn("predicted", (F.col("score") >= DECISION).cast("int"))
