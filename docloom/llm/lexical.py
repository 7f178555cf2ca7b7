"""Ranked lexical search with posting lists in geometric blocks.

Documents are indexed in shards of a bounded size. In a shard each term has a posting list, cut into blocks of documents
that are similar (by a sketch of their weighted terms), and each block has a summary: for every term the largest value
that any of its documents has. A query's terms weighted by the summary bound the scores of the block's documents exactly
from above, so a block is opened only if its bound reaches the lowest score that still counts, and a list only if it and
all rarer promises together do. What a task has found in earlier shards raises that score for the next.

A score is a sum over terms of a weight, the same for all documents, times a value of document and term, all integers.
Terms are compared by 64-bit hashes. The index covers the terms of the questions at hand, a bounded number at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from docloom.llm import scratch
from docloom.llm.words import Words, slices

K = 10
BLOCK = 128  # documents of a block, about; twice as many at most
SHARD_DOCS, SHARD_TERMS = 4096, 1 << 19  # documents of a shard, and their terms unless one document has more
GROUP_TERMS = 1 << 20  # terms of the questions that are answered in one pass over the documents
_SKETCH = 32
_BILLION = 1_000_000_000


@dataclass(frozen=True)
class Questions:
    """A group of questions of bounded size: the sorted hashes of their terms, and each one's terms as places therein."""

    names: list
    hashes: np.ndarray
    terms: list[np.ndarray]


@dataclass(frozen=True)
class Totals:
    """N, L and the weight of each term."""

    n: int
    length: int
    weights: np.ndarray


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each of ``starts`` on, ``sizes`` of them, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _question_groups(questions: DataFrame, key: str, text: str, most: int) -> Iterator[Questions]:
    """All questions with a key, each once, in groups of at most ``most`` terms (or one question).

    Rows of one key are one question. What is read is a stated set of questions; a group of it is in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                w = Words(part.column("t"))
                found = [np.unique(w.hashes[a:z]).view(np.int64) for a, z in zip(w.offsets[:-1], w.offsets[1:])]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(found, pa.list_(pa.int64()))], ["k", "h"])

    source = questions.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).filter("k is not null")
    schema = StructType([source.schema["k"], *StructType.fromDDL("h array<bigint>")])
    rows = source.mapInArrow(run, schema).groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("h"))).alias("h")).filter(F.size("h") > 0)
    names, terms, held = [], [], 0
    for row in rows.orderBy("k").toLocalIterator():
        own = np.asarray(row["h"], np.int64).view(np.uint64)
        if names and held + len(own) > most:
            yield _grouped(names, terms)
            names, terms, held = [], [], 0
        names.append(row["k"])
        terms.append(own)
        held += len(own)
    if names:
        yield _grouped(names, terms)


def _grouped(names: list, terms: list[np.ndarray]) -> Questions:
    hashes = np.unique(np.concatenate(terms))
    return Questions(names, hashes, [np.searchsorted(hashes, np.sort(t)).astype(np.int32) for t in terms])


def term_counts(docs: DataFrame, hashes: np.ndarray, key: str, text: str) -> DataFrame:
    """(key, n, terms, counts) of each text with words: how many it has, and which of ``hashes`` how often, as a table.

    ``terms`` (places, 32 bits) and ``counts`` (64 bits) are packed arrays.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hashes)  # GROUP_TERMS, or those of one question

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sent.value
        for batch in batches:
            for part in slices(batch, "__text"):
                w = Words(part.column("__text"))
                n = np.diff(w.offsets)
                at = np.minimum(np.searchsorted(hashes, w.hashes), len(hashes) - 1)
                own = hashes[at] == w.hashes
                pair = np.repeat(np.arange(len(n)), n)[own] * len(hashes) + at[own]
                pair, count = np.unique(pair, return_counts=True)
                term, edge = (pair % len(hashes)).astype("<i4"), np.searchsorted(pair, np.arange(len(n) + 1) * len(hashes))
                count = count.astype("<i8")
                some = np.flatnonzero(n)
                packed = [[x[edge[i] : edge[i + 1]].tobytes() for i in some.tolist()] for x in (term, count)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(n[some], pa.int64()), *[pa.array(p, pa.binary()) for p in packed]], [key, "__n", "__terms", "__counts"])

    source = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = StructType([source.schema[0], StructField("__n", LongType()), StructField("__terms", BinaryType()), StructField("__counts", BinaryType())])
    return scratch.table(source.mapInArrow(run, schema), "terms")


def totals(counts: DataFrame, n_terms: int) -> Totals:
    """Over all rows of :func:`term_counts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("__terms").to_pylist()), "<i4"), minlength=n_terms)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(df[seen])], ["t", "df"])

    n, length = counts.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0))).first()
    rows = counts.select("__terms").mapInArrow(run, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()  # a row for each term at most
    df = np.zeros(n_terms, np.int64)
    df[rows.column("t").to_numpy()] = rows.column("df").to_numpy()
    return Totals(n, length, np.asarray([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64))


class Shard:
    """Documents with their terms, posting lists in blocks, and the blocks' summaries; all arrays.

    ``doc_edges``, ``terms``, ``values``: the terms and values of each document. ``list_terms``, ``list_edges``: the terms of
    the shard and where the blocks of each begin. ``block_edges``, ``members``: the documents of each block.
    ``summary_edges``, ``summary_terms``, ``summary_values``: what the documents of a block have at most.
    """

    FIELDS = ("doc_edges", "terms", "values", "list_terms", "list_edges", "block_edges", "members", "summary_edges", "summary_terms", "summary_values")
    WIDE = ("doc_edges", "block_edges", "list_edges", "summary_edges")  # 64 bits; a value is below a million

    def __init__(self, keys: list, arrays: dict[str, np.ndarray]):
        self.keys = keys
        self.__dict__.update(arrays)
        self.largest = np.zeros(len(self.list_terms), np.int64)  # value of each term
        np.maximum.at(self.largest, np.searchsorted(self.list_terms, self.terms), self.values)

    @classmethod
    def build(cls, keys: list, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray, block: int) -> Shard:
        edges = np.concatenate([[0], np.cumsum(sizes)])
        own, local = np.unique(terms, return_inverse=True)
        sketch = _sketches(edges, local, values * weights[terms], len(own))
        owner = np.repeat(np.arange(len(keys)), sizes)
        order = np.argsort(local, kind="stable")
        posted, bounds = owner[order], np.searchsorted(local[order], np.arange(len(own) + 1))
        blocks: list[np.ndarray] = []
        firsts = [0]
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            blocks += _similar(posted[a:z], sketch, block)
            firsts.append(len(blocks))
        largest = np.zeros(len(own), np.int64)
        summary = []
        for members in blocks:
            at = _ranges(edges[members], sizes[members])
            np.maximum.at(largest, local[at], values[at])
            some = np.flatnonzero(largest)
            summary.append((some.astype(np.int32), largest[some].astype(np.int32)))
            largest[some] = 0
        lengths = lambda parts: np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        arrays = {
            "doc_edges": edges, "terms": terms, "values": values, "list_terms": own, "list_edges": np.asarray(firsts), "block_edges": lengths(blocks), "members": joined(blocks),
            "summary_edges": lengths([s for s, _ in summary]), "summary_terms": own[joined([s for s, _ in summary])], "summary_values": joined([v for _, v in summary]),
        }
        return cls(keys, {f: np.ascontiguousarray(x, cls._kind(f)) for f, x in arrays.items()})

    @classmethod
    def _kind(cls, field: str) -> str:
        return "<i8" if field in cls.WIDE else "<i4"

    def packed(self) -> list[bytes]:
        return [getattr(self, f).tobytes() for f in self.FIELDS]

    @classmethod
    def unpacked(cls, keys: list, blobs: list[bytes]) -> Shard:
        return cls(keys, {f: np.frombuffer(b, cls._kind(f)) for f, b in zip(cls.FIELDS, blobs)})

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``weight`` has 0 for terms that the question lacks."""
        return _weighted(self.doc_edges, self.terms, self.values, docs, weight)

    def bounds(self, blocks: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What no document of each block exceeds."""
        return _weighted(self.summary_edges, self.summary_terms, self.summary_values, blocks, weight)


def _weighted(edges: np.ndarray, terms: np.ndarray, values: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    sizes = edges[rows + 1] - edges[rows]
    at = _ranges(edges[rows], sizes)
    upto = np.concatenate([[0], np.cumsum(weight[terms[at]] * values[at])])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _sketches(edges: np.ndarray, local: np.ndarray, weighted: np.ndarray, n_terms: int) -> np.ndarray:
    """Random projections of the documents' weighted terms, of length 1."""
    signs = np.random.default_rng(11).choice(np.float32([-1, 1]), (n_terms, _SKETCH))
    out = np.zeros((len(edges) - 1, _SKETCH), np.float32)
    for i, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        out[i] = weighted[a:z].astype(np.float32) @ signs[local[a:z]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _similar(docs: np.ndarray, sketch: np.ndarray, block: int) -> list[np.ndarray]:
    """A posting list cut into blocks: nearest of evenly spaced documents, then of the means; large ones are cut."""
    if len(docs) <= block:
        return [docs]
    x = sketch[docs]
    centres = x[np.linspace(0, len(docs) - 1, -(-len(docs) // block)).astype(int)]
    near = np.argmax(x @ centres.T, axis=1)
    means = np.zeros_like(centres)
    np.add.at(means, near, x)
    near = np.argmax(x @ means.T, axis=1)
    order = np.argsort(near, kind="stable")
    out = []
    for group in np.split(docs[order], np.flatnonzero(np.diff(near[order])) + 1):
        out += np.array_split(group, -(-len(group) // (2 * block)))
    return out


def _shards(batches: Iterator[pa.RecordBatch], total: Totals, block: int, shard_docs: int, shard_terms: int) -> Iterator[Shard]:
    """Shards of the rows of :func:`term_counts` that a task reads."""
    kept, held = [], 0

    def built() -> Shard:
        sizes = np.asarray([len(t) for _, t, _ in kept], np.int64)
        return Shard.build([k for k, _, _ in kept], sizes, np.concatenate([t for _, t, _ in kept]), np.concatenate([v for _, _, v in kept]), total.weights, block)

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for name, n, terms, seen in zip(*[c.to_pylist() for c in batch.slice(at, 1024).columns]):
                if name is None or not terms:
                    continue
                terms, tf = np.frombuffer(terms, "<i4"), np.frombuffer(seen, "<i8")
                if kept and (len(kept) >= shard_docs or held + len(terms) > shard_terms):
                    yield built()
                    kept, held = [], 0
                m = 10 + 90 * n * total.n // total.length
                kept.append((name, terms, _BILLION * tf // (1000 * tf + 8 * m)))
                held += len(terms)
    if kept:
        yield built()


def index(counts: DataFrame, total: Totals, key: str, block: int = BLOCK, shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Shards of all documents that have a key and one of the terms: keys and packed arrays, a row for each shard.

    Nothing is shuffled: a task indexes what it reads. The rows may be written and searched later, by the same totals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for shard in _shards(seen(), total, block, shard_docs, shard_terms):
            yield pa.RecordBatch.from_arrays([pa.array([shard.keys], pa.list_(kind)), *[pa.array([b], pa.binary()) for b in shard.packed()]], ["keys", *Shard.FIELDS])

    fields = [StructField("keys", ArrayType(counts.schema[key].dataType)), *[StructField(f, BinaryType()) for f in Shard.FIELDS]]
    return counts.mapInArrow(run, StructType(fields))


class _Top:
    """The best ``k`` (score, key) of one question so far."""

    def __init__(self, k: int):
        self.k, self.best, self.floor = k, [], 0

    def add(self, scores: np.ndarray, keys: list, docs: np.ndarray) -> None:
        worth = np.flatnonzero((scores >= self.floor) & (scores > 0))
        if not len(worth):
            return
        if len(worth) > 4 * self.k:
            least = np.partition(scores[worth], len(worth) - self.k)[len(worth) - self.k]
            worth = worth[scores[worth] >= least]
        found = self.best + [(-s, keys[d]) for s, d in zip(scores[worth].tolist(), docs[worth].tolist())]
        self.best = sorted(found)[: self.k]
        if len(self.best) == self.k:
            self.floor = -self.best[-1][0]


def _search_shard(shard: Shard, terms: np.ndarray, weights: np.ndarray, top: _Top, weight: np.ndarray, opened: list[int]) -> None:
    """Add a shard's best documents for one question. ``weight`` is a row of zeros, as it is again at the end."""
    at = np.minimum(np.searchsorted(shard.list_terms, terms), len(shard.list_terms) - 1)
    at = at[(shard.list_terms[at] == terms) & (weights[shard.list_terms[at]] > 0)]
    if not len(at):
        return
    own = shard.list_terms[at]
    weight[own] = weights[own]
    most = shard.largest[at] * weights[own]
    order = np.argsort(-most, kind="stable")
    at, rest = at[order], np.cumsum(most[order][::-1])[::-1]  # what a document with none of the lists before can have
    seen = np.zeros(len(shard.keys), bool)
    for i, some in zip(at.tolist(), rest.tolist()):
        if some < top.floor:
            break
        blocks = np.arange(shard.list_edges[i], shard.list_edges[i + 1])
        bounds = shard.bounds(blocks, weight) if len(blocks) > 1 or top.floor else np.zeros(1, np.int64)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] < top.floor:
                break  # all others are lower
            docs = shard.members[shard.block_edges[blocks[b]] : shard.block_edges[blocks[b] + 1]]
            docs = docs[~seen[docs]]
            seen[docs] = True
            opened[0] += len(docs)
            if len(docs):
                top.add(shard.scores(docs, weight), shard.keys, docs)
    weight[own] = 0


def _found(rows: DataFrame, asked: Questions, total: Totals, k: int, key: object, shards: Callable[[Iterator[pa.RecordBatch]], Iterator[Shard]]) -> DataFrame:
    """(q, doc, score): for each question, by its number, the best ``k`` of the shards that each task gets from its rows."""
    kind = to_arrow_type(key)
    sent = rows.sparkSession.sparkContext.broadcast((asked.terms, total.weights))  # GROUP_TERMS, or those of one question

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, weights = sent.value
        tops, weight, opened = [_Top(k) for _ in questions], np.zeros(len(weights), np.int64), [0]
        for shard in shards(batches):
            for terms, top in zip(questions, tops):
                _search_shard(shard, terms, weights, top, weight, opened)
        found = [(q, name, -s) for q, top in enumerate(tops) for s, name in top.best]
        if found:
            q, names, scores = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(names, kind), pa.array(scores, pa.int64())], ["q", "doc", "score"])

    return rows.mapInArrow(run, StructType([StructField("q", IntegerType()), StructField("doc", key), StructField("score", LongType())]))


def search_shards(shards: DataFrame, asked: Questions, total: Totals, k: int = K) -> DataFrame:
    """(q, doc, score) from stored shards, rows of :func:`index`."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield Shard.unpacked(batch.column(0)[i].as_py(), [c[i].as_buffer() for c in batch.columns[1:]])

    return _found(shards, asked, total, k, shards.schema["keys"].dataType.elementType, unpacked)


def search_counts(counts: DataFrame, asked: Questions, total: Totals, key: str, k: int = K, block: int = BLOCK) -> DataFrame:
    """(q, doc, score) from rows of :func:`term_counts`: a task builds a shard, searches it and goes on to the next."""
    return _found(counts, asked, total, k, counts.schema[key].dataType, lambda batches: _shards(batches, total, block, SHARD_DOCS, SHARD_TERMS))


def rank(docs: DataFrame, questions: DataFrame, text: str = "text", key: str = "doc_id", question_key: str = "item_id", question_text: str = "text", k: int = K, block: int = BLOCK, group_terms: int = GROUP_TERMS) -> DataFrame:
    """The ``k`` best documents of each question: question_key, rank (from 1), key, score; equal scores by ascending key.

    Null texts have no terms. Documents without terms, or without a key, are never found, though all with terms count in
    the statistics; repeated rows are documents each, and their ranks differ. Rows of one question key are one question,
    those without one are left out, and a question without terms or hits has no rows. Empty tables give none. Other columns
    are not read. Questions are a stated set, answered in groups of ``group_terms`` terms at most.
    """
    names = StructType([StructField(question_key, questions.schema[question_key].dataType), StructField("rank", IntegerType()), StructField(key, docs.schema[key].dataType), StructField("score", LongType())])
    spark = docs.sparkSession
    done = None
    for asked in _question_groups(questions, question_key, question_text, group_terms):
        counts = term_counts(docs, asked.hashes, key, text)
        total = totals(counts, len(asked.hashes))
        found = search_counts(counts, asked, total, key, k, block)
        order = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        labels = spark.createDataFrame(list(enumerate(asked.names)), StructType([StructField("q", IntegerType()), StructField("name", names[0].dataType)]))
        part = best.join(F.broadcast(labels), "q").select(F.col("name").alias(question_key), "rank", F.col("doc").alias(key), "score")
        done = part if done is None else done.unionByName(part)
    return spark.createDataFrame([], names) if done is None else done
