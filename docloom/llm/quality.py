"""Compression classifier for text quality.

Two zstandard dictionaries are built from pieces of labelled good and bad texts, spread over each text by a hash. A text
is compressed whole with each, a block at a time, so that the dictionary and not the text's own beginning is what a block
is told by; the difference of the two sizes, normalised by the text's length and by the sizes, says which dictionary
knows it better. A logistic function of these differences, whose slope and intercept depend on the text's length, turns
them into a calibrated score. It is fitted on other labelled texts than those in the dictionaries, each label weighted to
its share of all labelled rows, since a bounded sample and the dictionaries take other shares of the two labels.

Dictionaries are built where the rows are: pieces, at most a fixed number of bytes of each text, go to the driver, and so
do the two sizes of the texts that the function is fitted to, but never whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import mapped, slices

DECISION = 0.3
_LEVEL = 3
_DICTIONARY = 1 << 18
_BLOCK = 1024  # bytes compressed at a time
_LEAST = 1024  # bytes to train on
_PIECE, _PIECES = 300, 12  # bytes of a piece, pieces of a text in a dictionary


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray


class _Sizes:
    """Compressed sizes of whole texts with each dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = []
        for data in (good, bad):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=_LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=_LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Rows of length, size with the good dictionary, size with the bad one."""
        one = lambda pack, t: sum(len(pack(t[i : i + _BLOCK])) for i in range(0, max(len(t), 1), _BLOCK))
        return np.asarray([(len(t), *(one(pack, t) for pack in self.packers)) for t in texts], float).reshape(-1, 3)


def features(sizes: np.ndarray) -> np.ndarray:
    """Normalised differences, the same by the logarithm of the length, that logarithm and a constant."""
    n, good, bad = np.maximum(sizes[:, 0], 1), sizes[:, 1], sizes[:, 2]
    per_byte, relative, size = 10 * (bad - good) / n, 10 * (bad - good) / (bad + good), np.log(n) / 5
    return np.stack([per_byte, relative, per_byte * size, relative * size, size, np.ones(len(n))], axis=1)


def pieces(text: bytes) -> list[bytes]:
    """Some pieces of a text, all if it has few; which ones is decided by hashes of their places, so they spread over it."""
    places = range(0, len(text), _PIECE)
    chosen = sorted(places, key=lambda i: (zlib.crc32(b"%d %d" % (i, len(text))), i))[:_PIECES] if len(places) > _PIECES else places
    return [text[i : i + _PIECE] for i in sorted(chosen)]


def _dictionary(parts: list[bytes]) -> bytes:
    if sum(map(len, parts)) < _LEAST:  # the trainer divides by zero on some texts of a few bytes
        return b"\n".join(parts) or b"\n" * 8
    try:
        return zstandard.train_dictionary(_DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"\n".join(parts)[:_DICTIONARY] or b"\n" * 8


def fit(sizes: np.ndarray, labels: np.ndarray, totals: tuple[int, int]) -> np.ndarray:
    """Weights of the logistic function; ``totals`` counts the labels 0 and 1 in all that the rows are a sample of."""
    x, y = features(sizes), np.asarray(labels, float)
    weights = np.zeros(x.shape[1])
    if not (y == 1).any() or not (y == 0).any():  # one label only: a score that says so
        weights[-1] = 4.0 if totals[1] >= totals[0] else -4.0
        return weights
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    weight *= len(y) / weight.sum()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.005 * w @ w)

    for _ in range(100):  # Newton's method; a step that does not help is halved
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(weights))
        step, now = np.linalg.solve(curve, x.T @ (weight * (y - p)) - 1e-2 * weights), loss(weights)
        while loss(weights + step) > now and np.abs(step).max() > 1e-6:
            step = step / 2
        if np.abs(step).max() <= 1e-6:
            break
        weights = weights + step
    return weights


def train(rows: DataFrame, totals: tuple[int, int] | None = None, in_dictionary: int = 1000) -> Model:
    """Learn from ``rows`` (text, y, order), a bounded sample of labelled rows (see :func:`docloom.llm.labelled.sample`).

    Both dictionaries are built from at most ``in_dictionary`` and half of the rows of each label, those of the least
    ``order``; the others are fitted to. Rows without text count as empty texts. ``totals`` counts the labels 0 and 1 in
    all that the rows are a sample of (default: the rows themselves).
    """
    sample = rows.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("y").cast("int").alias("y"), F.col("order").cast("long").alias("order")).filter("y in (0, 1)")
    places = sample.select("y", "order").toPandas()
    own = {y: np.sort(places["order"].to_numpy()[places["y"] == y]) for y in (0, 1)}
    share = {y: min(in_dictionary, (len(o) + 1) // 2) for y, o in own.items()}
    known = [(F.col("y") == y) & (F.col("order") <= int(own[y][n - 1])) for y, n in share.items() if n]
    known = reduce(Column.__or__, known, F.lit(False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [pieces(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("order"), pa.array(lists, pa.list_(pa.binary()))], ["y", "order", "pieces"])

    found: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(sample.filter(known).mapInArrow(cut, "y int, order long, pieces array<binary>").collect(), key=lambda r: (r["order"], r["pieces"])):
        found[r["y"]].extend(bytes(p) for p in r["pieces"])
    good, bad = _dictionary(found[1]), _dictionary(found[0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(good, bad)
        for batch in batches:
            for part in slices(batch, "text"):
                got = sizes(part.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("y"), *map(pa.array, got.T)], ["y", "n", "good", "bad"])

    rest = sample.filter(~known).select("y", "text").mapInArrow(measure, "y int, n double, good double, bad double").toPandas()
    totals = totals or (len(own[0]), len(own[1]))
    return Model(good, bad, fit(rest[["n", "good", "bad"]].to_numpy(float), rest["y"].to_numpy(), totals))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 from 0.3 on).

    Null and empty texts score as texts of no length. Whole texts are read, of any length. An empty table gives none;
    repeated rows get the same score each. Columns named score or predicted are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(model.good, model.bad)
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = [t or b"" for t in part.column("__text").cast(pa.binary()).to_pylist()]
                found = 1 / (1 + np.exp(-np.clip(features(sizes(texts)) @ model.weights, -30, 30)))
                names = [c for c in part.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(found)], [*names, "score"])

    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    return mapped(source, run, "score double").withColumn("predicted", (F.col("score") >= DECISION).cast("int"))
