"""Whitening of embeddings by shifted CholeskyQR.

Entries are taken on a grid, so equal vectors are one row of the fit list, found by one grouping of short codes. A Gram
pass over the centred rows gives a triangular factor; the rows, solved against the factors so far, are passed over again
until they are orthonormal. The composed factor R has the covariance R'R / n, and its singular values and right vectors
are the components. A pass reads the fit list where it lies: a task hands on one matrix, and matrices are added in a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.types import DoubleType as Double

from docloom.llm import scratch

SCALE, ORIGIN = 64.0, 1_000_000  # fixed by the contract: x = floor(64 c) + 1000000
MOST = 16
PASSES = 8
SUMMING = 8  # tasks that add the matrices of all others, and so matrices that reach the driver
_DIRECTION_FLOOR = 1e-13  # share of the largest eigenvalue under which a direction has no variance
_WIDTHS = (np.dtype("<i1"), np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))


@dataclass(frozen=True)
class Whitening:
    """What is sent to every task: some numbers for each dimension, and its share of each component."""

    n: int
    sums: np.ndarray  # of x - ORIGIN in each dimension, as Python integers
    components: np.ndarray  # (dimensions, components), of length 1
    eigenvalues: np.ndarray
    total: float
    identity_error: float

    @property
    def dims(self) -> int:
        return len(self.sums)


def _valid(lists: pa.Array, dims: int | None = None) -> np.ndarray:
    """Which lists have entries (``dims`` of them, if given), all of them finite numbers."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ok = sizes > 0 if dims is None else sizes == dims
    values = lists.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ok[owner[~np.isfinite(values)]] = False
    return ok


def _grid(values: np.ndarray) -> np.ndarray:
    """x - ORIGIN of entries; what is beyond 62 bits stands at its bound."""
    return np.clip(np.floor(values * SCALE), -(2.0**62), 2.0**62).astype(np.int64)


def _encode(grid: np.ndarray) -> list[bytes]:
    """Rows in the narrowest integers that hold them, after a byte with their width; equal rows have equal codes."""
    if not grid.size:
        return []
    width = np.zeros(len(grid), np.int64)
    for i, kind in enumerate(_WIDTHS[:-1]):
        width[(grid.min(1) < np.iinfo(kind).min) | (grid.max(1) > np.iinfo(kind).max)] = i + 1
    out: list[bytes] = [b""] * len(grid)
    for i, kind in enumerate(_WIDTHS):
        head = bytes([kind.itemsize])
        for at in np.flatnonzero(width == i).tolist():
            out[at] = head + grid[at].astype(kind).tobytes()
    return out


def _decode(codes: pa.Array, dims: int) -> np.ndarray:
    rows = codes.to_pylist()
    out = np.zeros((len(rows), dims), np.int64)
    sizes = np.asarray([r[0] for r in rows])
    for kind in _WIDTHS:
        at = np.flatnonzero(sizes == kind.itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i][1:] for i in at.tolist()), kind).reshape(len(at), dims)
    return out


def fit_list(vectors: DataFrame, vector: str) -> DataFrame:
    """(dims, code): each distinct valid vector on the grid once, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v").filter(pa.array(_valid(batch.column("v"))))
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = _grid(lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum(sizes)
            dims, codes = [], []
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                dims += [d] * len(at)
                codes += _encode(values[(ends[at] - d)[:, None] + np.arange(d)])
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(codes, pa.binary())], ["dims", "code"])

    source = vectors.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return scratch.table(source.mapInArrow(run, "dims int, code binary").distinct(), "fitlist")


def _solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``r``, a column after the other."""
    out = np.empty_like(rows)
    for j in range(r.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _centred(grid: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows minus their mean in doubles, rounded once where n times an entry is a 63-bit integer."""
    if len(grid) and float(np.abs(grid).max()) * n < 2.0**62:
        return (grid * n - sums.astype(np.int64)).astype(np.float64) / n
    return grid - np.asarray([float(s) / n for s in sums])


def _gram(codes: DataFrame, dims: int, rows: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the fit list of the products of all pairs of a row's entries, a row being ``rows`` of it and then 1."""
    size = width + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = rows(_decode(batch.column("code").slice(at, 4096), dims))
                part = np.hstack([part, np.ones((len(part), 1))])
                total += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size)
        for batch in batches:
            for m in batch.column("m"):
                total += np.frombuffer(m.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    found = codes.mapInArrow(products, "m binary").repartition(SUMMING).mapInArrow(added, "m binary").collect()
    return sum((np.frombuffer(r["m"], np.float64) for r in found), np.zeros(size * size)).reshape(size, size)


def _sums(codes: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of rows of the fit list and exact sums of its entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dims, 0
        for batch in batches:
            grid = _decode(batch.column("code"), dims)
            n += len(grid)
            high, low = grid >> 32, grid & 0xFFFFFFFF  # neither sum can overflow
            total = [t + (h << 32) + w for t, h, w in zip(total, high.sum(0).tolist(), low.sum(0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([str(t) for t in (n, *total)])], ["i", "s"])

    rows = codes.mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["i"]: int(r["s"]) for r in rows}
    return found.get(-1, 0), np.asarray([found.get(i, 0) for i in range(dims)], object)


def factor(codes: DataFrame, dims: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R with R'R the Gram matrix of the centred rows.

    The first Cholesky factor is of a shifted Gram matrix, which always exists; a later one is shifted only if rows depend
    on each other. Passes end when the rows that went in were orthonormal but for 1e-8 (what the last factor then corrects),
    where directions without variance don't count.
    """
    spread = _gram(codes, dims, lambda g: _centred(g, n, sums), dims)[:-1, :-1]
    shift = 11 * (n * dims + dims * (dims + 1)) * np.finfo(float).eps / 2 * max(np.trace(spread), 1.0)
    r = np.linalg.cholesky(spread + shift * np.eye(dims)).T
    for _ in range(PASSES):
        again = _gram(codes, dims, lambda g, r=r: _solve(_centred(g, n, sums), r), dims)[:-1, :-1]
        size = np.linalg.eigvalsh(again)
        flat = size < 1e-9
        small = np.eye(dims) * (dims * np.finfo(float).eps) if flat.any() else 0.0
        try:
            step = np.linalg.cholesky(again + small).T
        except np.linalg.LinAlgError:
            step = np.linalg.cholesky(again + np.eye(dims) * 1e-13).T
        r = step @ r
        if np.all(flat | (np.abs(size - 1) < 1e-8)):
            break
    return r


def fit(vectors: DataFrame, vector: str = "embedding", most: int = MOST) -> Whitening | None:
    """The first ``most`` components of all distinct vectors; None if no vector is valid.

    The dimension is the one that most distinct vectors have (of equally many, the larger).
    """
    listed = fit_list(vectors, vector)
    top = listed.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if top is None:
        return None
    dims = top["dims"]
    codes = listed.filter(F.col("dims") == dims).select("code")
    n, sums = _sums(codes, dims)
    r = factor(codes, dims, n, sums)
    _, size, across = np.linalg.svd(r)
    values = size * size / n
    k = int(np.sum(values[:most] > max(values[0] * _DIRECTION_FLOOR, 0.0))) if values[0] > 1e-12 else 0
    components = across[:k].T
    whiten = components / np.sqrt(values[:k])
    seen = _gram(codes, dims, lambda g: _centred(g, n, sums) @ whiten, k) / n
    error = float(np.abs(seen[:k, :k] - np.outer(seen[k, :k], seen[k, :k]) - np.eye(k)).max()) if k else 0.0
    scratch.drop(listed)
    return Whitening(n, sums, components, values[:k], float(values.sum()), error)


def _deviations(grid: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond 63 bits."""
    span = float(np.abs(grid).max(initial=0)) * n + max(abs(float(s)) for s in sums)
    if span * span * len(sums) < 2.0**62:
        apart = grid * n - sums.astype(np.int64)
        return (apart * apart).sum(1).tolist()
    out = [sum((n * x - s) ** 2 for x, s in zip(row, sums)) for row in grid.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = MOST) -> DataFrame:
    """A row for each valid vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, hold a null or non-finite entry, or have another dimension than most are left out.
    Repeated rows and null keys come back as often as they occur, but count once in the fit. Components without variance are
    left out, so copies of one vector, like an empty table, give no rows. ``deviation`` is null where it exceeds a long.
    Other columns are not read. Of eigenvectors with equal eigenvalues any basis may come out, the same for all rows.
    """
    source = vectors.select(F.col(f"`{key}`"), F.col(f"`{vector}`").cast("array<double>").alias("__v"))
    fields = [("component", IntegerType()), ("n", LongType()), ("deviation", LongType()), ("whitened", Double()), ("explained", Double()), ("identity_error", Double())]
    schema = StructType([StructField(key, source.schema[0].dataType), *[StructField(f, t) for f, t in fields]])
    model = fit(vectors, vector, most)
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    k, matrix = len(model.eigenvalues), model.components / np.sqrt(model.eigenvalues)
    share = model.eigenvalues / model.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                batch = batch.filter(pa.array(_valid(batch.column(1), model.dims)))
                m = batch.num_rows
                grid = _grid(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(m, model.dims)
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), pa.array(_deviations(grid, model.n, model.sums), pa.int64()).take(each),
                    pa.array((_centred(grid, model.n, model.sums) @ matrix).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)
