"""Approximate nearest vectors by a stored index: inverted lists around centroids, residuals in product-quantised codes.

A search reads the lists whose centroids are nearest to a query, ranks their rows by codes, and scores the best of those
exactly. How many lists and how many exact scores are needed is measured when the index is made, so that data with groups
are searched in few lists and data without any in many, always towards the same recall.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import search
from docloom.sources import shared

SAMPLE = 1 << 16  # vectors that centroids and codes are learned from, at most
SAMPLE_BYTES = 1 << 26  # and what they take on the driver
LISTS = 4096  # at most
TARGET = 0.95  # recall of the ten nearest that the numbers of lists and of exact scores are chosen for
TRIED = 64  # vectors that are searched exactly to measure it
HELD = 1 << 26  # bytes of a block's best scores by codes that a task holds
SUBSPACE = 4  # dimensions that share a byte of the code
ROUNDS = 12


@dataclass(frozen=True)
class Model:
    """Of a fixed size: LISTS centroids at most, 256 codes for each four dimensions."""

    centroids: np.ndarray
    codebooks: np.ndarray
    probes: int
    rescored: int  # exact scores for each wanted neighbour
    kind: str  # of the keys

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centroids=self.centroids, codebooks=self.codebooks, numbers=np.asarray([self.probes, self.rescored]), kind=np.asarray(self.kind))
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Model:
        data = np.load(io.BytesIO(blob))
        return cls(data["centroids"], data["codebooks"], *map(int, data["numbers"]), str(data["kind"]))

    def list_of(self, unit: np.ndarray) -> np.ndarray:
        return np.argmax(unit @ self.centroids.T, axis=1)

    def codes(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """A byte for each subspace: the nearest code of the residual."""
        parts = _subspaces(unit - self.centroids[lists])
        return np.stack([_nearest(parts[:, j], book) for j, book in enumerate(self.codebooks)], axis=1).astype(np.uint8)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """What each code of each subspace adds to a query's score: (queries, subspaces, codes)."""
        return np.einsum("qjd,jcd->qjc", _subspaces(unit), self.codebooks)


def _subspaces(x: np.ndarray) -> np.ndarray:
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % SUBSPACE)))
    return x.reshape(len(x), -1, SUBSPACE)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres * centres).sum(1) / 2, axis=1)


def _centres(x: np.ndarray, k: int, unit: bool, rng: np.random.Generator) -> np.ndarray:
    """``k`` means, of length 1 if ``unit``; one without members keeps its place."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.argmax(x @ centres.T, axis=1) if unit else _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        some = n > 0
        centres[some] = sums[some] / n[some, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def train(sample: np.ndarray, n: int, kind: str, seed: int = 7) -> Model:
    """From unit vectors, a sample of ``n``; all lists are probed until :func:`calibrate` knows better."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(LISTS, int(np.sqrt(n)), len(sample) // 8))
    centroids = _centres(sample, lists, True, rng)
    parts = _subspaces(sample - centroids[np.argmax(sample @ centroids.T, axis=1)])
    codebooks = np.stack([_centres(parts[:, j], min(256, len(sample)), False, rng) for j in range(parts.shape[1])])
    return Model(centroids, codebooks, lists, 1, kind)


def calibrate(own: DataFrame, path: str, model: Model, target: float, k: int = 10) -> Model:
    """The model with the fewest lists and exact scores that reach ``target`` over all rows, their own vectors left out.

    TRIED vectors are searched exactly. Where the lists of what they find stand in a query's order tells how many to probe;
    how many rows of these lists the codes put before it, counted in the index, tells how many to score. Half of what may be
    missed is left to each. None of this depends on how rows lie in tasks.
    """
    spark = own.sparkSession
    tried = shared.table(own.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(TRIED).select(F.col("key").alias("query_id"), "v"), "tried")
    near = search.batch_top_k(own, tried, k + 1, "v", "key").filter("key != query_id")
    pairs = near.join(F.broadcast(tried.withColumnRenamed("v", "q")), "query_id").join(own, "key").orderBy("query_id", "rank").select("q", "v").toArrow()  # k for each tried
    if not len(pairs):
        return model
    unit, found = (search._unit(search._matrix(pairs.column(c).combine_chunks()).astype(np.float64)) for c in ("q", "v"))
    lists = model.list_of(found)
    order = np.argsort(np.argsort(-(unit @ model.centroids.T), axis=1, kind="stable"), axis=1)
    probes = _holding(order[np.arange(len(found)), lists] + 1, (1 + target) / 2)
    own_codes = model.codes(found, lists)
    floor = np.asarray([_rough(model, unit[i : i + 1], n, own_codes[i : i + 1])[0, 0] for i, n in enumerate(lists.tolist())])

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros(len(unit), np.int64)
        for batch in batches:
            number = batch.column("list").to_numpy()
            for n in np.unique(number).tolist():
                asking = np.flatnonzero(order[:, n] < probes)
                codes = np.frombuffer(b"".join(batch.column("code").filter(pa.array(number == n)).to_pylist()), np.uint8).reshape(-1, own_codes.shape[1])
                for at in range(0, len(asking), 64):
                    some = asking[at : at + 64]
                    before[some] += (_rough(model, unit[some], n, codes) > floor[some, None] + 1e-6).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(before)), pa.int32()), pa.array(before)], ["i", "n"])

    counted = _rows(spark, path, model).select("list", "code").mapInArrow(ahead, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    places = np.asarray([r["n"] for r in counted]) + 2  # its own place, and the query's own row
    return Model(model.centroids, model.codebooks, probes, -(-_holding(places, (1 + target) / 2) // k), model.kind)


def _holding(places: np.ndarray, share: float) -> int:
    """The smallest number of places, from 1, that holds ``share`` of those given."""
    return int(np.sort(places)[max(0, int(np.ceil(share * len(places))) - 1)])


def _rough(model: Model, unit: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
    """Scores by codes of rows of one list: (queries, rows)."""
    return ((unit @ model.centroids[number])[:, None] + model.tables(unit)[:, np.arange(codes.shape[1]), codes].sum(2)).astype(np.float32)


def _rows(spark: SparkSession, path: str, model: Model) -> DataFrame:
    return spark.read.schema(f"key {model.kind}, code binary, v array<float>, list int").parquet(f"{path}/rows")


def build(docs: DataFrame, path: str, vector: str = "embedding", key: str = "id", target: float = TARGET) -> None:
    """Write the index of all vectors to a new folder: ``model`` and, by list, ``rows`` (key, code, v).

    Null, empty and zero vectors, those with null or non-finite entries, and null keys have no row. All others have one length.
    A list may have most of the rows (copies do); ranges of list and key spread it over tasks.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<float>").alias("v")).filter("key is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(v, x -> x != 0)")
    kind = own.schema["key"].dataType.simpleString()
    n, dims = own.agg(F.count("*"), F.max(F.size("v"))).first()
    most = min(SAMPLE, SAMPLE_BYTES // (4 * (dims or 1)))
    rows = own.withColumn("h", F.xxhash64("key")).orderBy("h", "key").limit(most).select("v").toArrow()
    model = train(search._unit(search._matrix(rows.column("v").combine_chunks()).astype(np.float32)), n, kind) if n else Model(np.zeros((1, 1), np.float32), np.zeros((1, 1, SUBSPACE), np.float32), 1, 1, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                unit = search._unit(search._matrix(part.column("v")).astype(np.float32))
                lists = model.list_of(unit)
                codes = [c.tobytes() for c in model.codes(unit, lists)]
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), part.column("key"), pa.array(codes, pa.binary()), part.column("v")], ["list", "key", "code", "v"])

    placed = own.mapInArrow(run, f"list int, key {kind}, code binary, v array<float>")
    placed.repartitionByRange(F.col("list"), F.xxhash64("key")).write.partitionBy("list").parquet(f"{path}/rows")
    if n:
        model = calibrate(own, path, model, target)
    spark.createDataFrame([(model.dump(),)], "model binary").coalesce(1).write.parquet(f"{path}/model")


@lru_cache(8)
def _model(path: str) -> Model:
    """Read once; a folder's index never changes."""
    return Model.load(bytes(SparkSession.active().read.schema("model binary").parquet(f"{path}/model").first()["model"]))


class Prober:
    """The best ``k`` rows of each query of a block, from the lists that it probes; counts what it visits and scores."""

    def __init__(self, model: Model, unit: np.ndarray, k: int, probes: int):
        self.model, self.unit, self.k = model, unit, k
        near = np.argsort(-(unit @ model.centroids.T), axis=1, kind="stable")[:, :probes]
        self.asking = [np.flatnonzero((near == n).any(1)) for n in range(len(model.centroids))]
        self.rough = np.full((len(unit), model.rescored * k), -np.inf, np.float32)  # best scores by codes, ascending
        self.best: dict[int, list[tuple[float, object]]] = {}
        self.visited = self.scored = 0

    def add(self, number: int, keys: list, codes: np.ndarray, vectors: np.ndarray) -> None:
        """Rows of one list."""
        asking = self.asking[number]
        for at in range(0, len(asking), 64):
            some = asking[at : at + 64]
            scores = _rough(self.model, self.unit[some], number, codes)
            self.visited += scores.size
            for q, row in zip(some.tolist(), scores):
                worth = np.flatnonzero(row > self.rough[q, 0])
                if len(worth) > self.rough.shape[1]:
                    worth = worth[np.argsort(-row[worth], kind="stable")[: self.rough.shape[1]]]
                if not len(worth):
                    continue
                self.rough[q] = np.sort(np.concatenate([self.rough[q], row[worth]]))[-self.rough.shape[1] :]
                self.scored += len(worth)
                exact = np.round(search._unit(vectors[worth].astype(np.float64)) @ self.unit[q], 12)
                found = self.best.get(q, []) + list(zip((-exact).tolist(), [keys[i] for i in worth.tolist()]))
                self.best[q] = sorted(found)[: self.k]


def top_k(spark: SparkSession, path: str, queries: DataFrame, key: str = "id", k: int = search.DEFAULT_K, vector: str = "embedding", query_key: str = "query_id", probes: int | None = None, block_bytes: int = search.BLOCK_BYTES) -> DataFrame:
    """Like :func:`search.batch_top_k`, from an index: query_id, id, score (cosine), rank. ``probes`` overrides the measured number of lists.

    A query's best scores by codes take more room in large indexes, so a block then has fewer queries.
    """
    model = _model(path)
    block_bytes = max(1, min(block_bytes, HELD // (4 * model.rescored * k) * 8 * model.centroids.shape[1]))
    probes = probes or model.probes
    rows = _rows(spark, path, model)
    key_kind, kind = model.kind, queries.schema[query_key].dataType.simpleString()

    def compared(block: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, object]:
        names, unit = block[0], search._unit(block[1])
        names, unit = names[np.isfinite(unit).all(1)], unit[np.isfinite(unit).all(1)]
        if unit.shape[1] != model.centroids.shape[1]:  # no vector of an index has another length
            names, unit = names[:0], np.zeros((0, model.centroids.shape[1]))
        wanted = [n for n, asking in enumerate(Prober(model, unit, k, probes).asking) if len(asking)]
        sent = spark.sparkContext.broadcast((model, names, unit))  # a block of bounded size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, names, unit = sent.value
            prober = Prober(model, unit, k, probes)
            for batch in batches:
                lists = batch.column("list").to_numpy()
                for number in np.unique(lists).tolist():
                    part = batch.take(pa.array(np.flatnonzero(lists == number)))
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    prober.add(number, part.column("key").to_pylist(), codes, search._matrix(part.column("v")))
            found = [(names[q], name, -s) for q, best in prober.best.items() for s, name in best]
            if found:
                q, names_, scores = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(names_), pa.array(scores)], [query_key, key, "score"])

        chosen = rows.filter(F.col("list").isin(wanted)) if len(wanted) < len(model.centroids) else rows
        return chosen.select("list", "key", "code", "v").mapInArrow(run, f"`{query_key}` {kind}, `{key}` {key_kind}, score double"), sent

    found = search.in_blocks(search._query_blocks(queries, vector, query_key, block_bytes), compared)
    if found is None:
        return spark.createDataFrame([], f"`{query_key}` {kind}, `{key}` {key_kind}, score double, rank int")
    return search._first_k(found, k, key, query_key)


def approximate_top_k(docs: DataFrame, queries: DataFrame, k: int = search.DEFAULT_K, vector: str = "embedding", key: str = "id", query_key: str = "query_id") -> DataFrame:
    """:func:`top_k` of documents that have no stored index, by one that is built for these queries."""
    path = shared.new_path(docs.sparkSession, "vectors")
    build(docs, path, vector, key)
    return top_k(docs.sparkSession, path, queries, key, k, vector, query_key)
