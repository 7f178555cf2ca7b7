"""Near-equal embeddings by lattice hashing.

Every table projects the vectors to twice eight random directions, scales them and decodes either eight to the nearest
point of the lattice E8, the densest packing of that many dimensions. Vectors with the same two points are candidates; a
vector also visits the neighbouring points that it is closest to. Candidates are narrowed by sketches of random signs, and within the
candidates' components all pairs' cosines are computed in double precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import linking, scratch, skew
from docloom.llm.words import mix

COSINE = 0.95
TABLES = 16
PROBES = 1
SCALE = 0.6
LANES = 256


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: neighbours of a lattice point, relative to it."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-1, 1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.asarray(s) / 2 for s in itertools.product((-1, 1), repeat=8) if s.count(-1) % 2 == 0]
    return np.asarray(out, float)


ROOTS = _roots()


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    if len(odd):
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(1)
        at = np.arange(len(odd))
        near[odd, worst] += np.where(off[at, worst] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of those with whole and those with half coordinates."""
    whole, half = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


def _points(x: np.ndarray, probes: int) -> np.ndarray:
    """Hashes of the nearest lattice point of each row and of the ``probes`` next ones, by column."""
    own = decode_e8(x)
    gain = (x - own) @ ROOTS.T
    nearest = gain.argmax(1)[:, None] if probes == 1 else np.argsort(-gain, axis=1, kind="stable")[:, :probes]
    out = np.zeros((len(x), 1 + probes), np.uint64)
    for p in range(1 + probes):
        point = own if p == 0 else own + ROOTS[nearest[:, p - 1]]
        for c in (2 * point).astype(np.int64).view(np.uint64).T:
            out[:, p] = mix(out[:, p] + c) + np.uint64(1)
    return out


def cells(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 8) -> np.ndarray:
    """Hashes of the cells of each unit vector in each table; a cell is a pair of lattice points.

    With its own point and ``probes`` neighbours in either lattice, a vector is in ``(1 + probes) ** 2`` cells a table.
    """
    n, d = vectors.shape
    rng = np.random.default_rng(seed)
    out = []
    for t in range(tables):
        one = _points(vectors @ rng.normal(0, scale, (d, 8)), probes)
        two = _points(vectors @ rng.normal(0, scale, (d, 8)), probes)
        both = mix(one[:, :, None] * np.uint64(0x2545F4914F6CDD1D) + two[:, None, :] + np.uint64(t))
        out.append(both.reshape(n, -1))
    return np.concatenate(out, axis=1)


class _Lists:
    """A column of lists of doubles as one flat buffer; nulls within lists are NaN there."""

    def __init__(self, column: pa.Array):
        self.offsets = column.offsets.to_numpy().astype(np.int64)
        values = column.values
        self.flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) if len(values) else np.zeros(0)
        self.lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(self.offsets), 0)

    def rows(self, at: np.ndarray, length: int) -> np.ndarray:
        """The lists at ``at``, all of ``length``, as a matrix."""
        return self.flat[self.offsets[at][:, None] + np.arange(length)]

    def good(self) -> np.ndarray:
        """Which lists are not empty, finite throughout and not all zero."""
        ok = np.zeros(len(self.lengths), bool)
        full = np.flatnonzero(self.lengths)
        for d in np.unique(self.lengths[full]).tolist():
            at = full[self.lengths[full] == d]
            x = self.rows(at, d)
            ok[at] = np.isfinite(x).all(1) & (x != 0).any(1)
        return ok


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def link_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", block: int = 512) -> DataFrame:
    """One row for each row: key, n_links, component_id, kept.

    Two vectors of equal length are linked if their cosine, in double precision, is at least 0.95. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. ``component_id`` is the smallest key reachable
    by links, the own one included; ``kept`` tells whether it is the own one. Equal vectors are one thing with a weight
    on the way, so repeated rows cost no pairs. An empty table gives none. Other columns are not read, so that none can
    clash with the result's.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _Lists(batch.column("v"))
            good = lists.good()
            n = len(good)
            f1, f2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
            width = TABLES * (1 + PROBES) ** 2
            keys, signs = np.zeros((n, width), np.int64), np.zeros((n, LANES // 8), np.uint8)
            for d in np.unique(lists.lengths[good]).tolist():
                at = np.flatnonzero(good & (lists.lengths == d))
                x = lists.rows(at, d)
                bits = np.ascontiguousarray((x + 0.0).view(np.uint64).T)
                a = b = np.full(len(at), d, np.uint64)
                for c in bits:
                    a, b = mix(a + c) + np.uint64(1), mix(b ^ c) + np.uint64(7)
                f1[at], f2[at] = a.view(np.int64), b.view(np.int64)
                unit = _unit(x)
                keys[at] = cells(unit).view(np.int64)
                signs[at] = np.packbits((unit @ np.random.default_rng(d).normal(0, 1, (d, LANES)) > 0).astype(np.uint8), axis=1)
            keys.sort(axis=1)
            new = np.repeat(good[:, None], width, axis=1)
            new[:, 1:] &= keys[:, 1:] != keys[:, :-1]  # cells that several probes lead to count once
            buckets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new.sum(1))]), pa.int32()), pa.array(keys[new]))
            sketch = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * (LANES // 8)).astype(np.int32)), pa.py_buffer(signs.tobytes())])
            names = ["k", "good", "f1", "f2", "buckets", "sketch", "v"]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(good), pa.array(f1), pa.array(f2), buckets, sketch, batch.column("v")], names)

    source = vectors.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    signed = scratch.table(source.mapInArrow(sign, "k long, good boolean, f1 long, f2 long, buckets array<long>, sketch binary, v array<double>"), "vectors")
    classes = signed.filter("good").groupBy("f1", "f2").agg(F.min("k").alias("first"), F.count("*").alias("copies"), F.any_value("buckets").alias("buckets"), F.any_value("sketch").alias("sketch"), F.any_value("v").alias("v"))
    classes = scratch.table(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = classes.select(F.explode("buckets").alias("bucket"), "id", "sketch")
    angle = np.arccos(COSINE) / np.pi
    agree = 1 - angle - 4.5 * np.sqrt(angle * (1 - angle) / LANES)  # of two sketches at the threshold, less 4.5 standard deviations
    near = linking.connected(linking.candidate_edges(rows, float(agree)))
    members = classes.join(near, "id").select(F.col("root").alias("group"), "id", "first", F.col("copies").alias("weight"), F.size("v").cast("long").alias("size"), "v")
    counts, edges = linking.verified(members, ["v"], _cosine, block)
    roots = linking.connected(edges).select("id.id", F.col("root").alias("r"))
    found = classes.select("id", "f1", "f2", "first", "copies").join(roots, "id", "left").join(counts, "id", "left")
    least = F.when(F.col("r").isNull(), F.col("first")).otherwise(F.col("r.first")).alias("component_id")
    per_class = scratch.table(found.select("f1", "f2", "copies", least, (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "per-class")
    linked = skew.joined_with_classes(signed.filter("good").select("k", "f1", "f2"), per_class, ["f1", "f2"], "copies").select("k", "n_links", "component_id")
    alone = signed.filter("not good").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("k").alias(key), "n_links", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


def _cosine(table: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    lists = _Lists(table.column("v").combine_chunks())

    def near(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(p), len(q)), bool)
        for d in np.unique(lists.lengths[p]).tolist():
            a, b = np.flatnonzero(lists.lengths[p] == d), np.flatnonzero(lists.lengths[q] == d)
            if len(a) and len(b):
                out[np.ix_(a, b)] = _unit(lists.rows(p[a], d)) @ _unit(lists.rows(q[b], d)).T >= COSINE
        return out

    return near
