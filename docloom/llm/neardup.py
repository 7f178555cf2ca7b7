"""N-gram Jaccard join by a MinHash LSH forest.

A document is the set of its runs of five words. Documents with equal sets are one class; one of each class goes on.
Every tree of the forest orders the classes by another sequence of minimum hashes, so that in sorted order the classes with
a common prefix, a node of the tree's prefix trie, stand together. Matching begins with the full depth. The prefix that
two classes must share is then shortened a step at a time, as far as the target recall asks for: until the chance that a
linked pair shares it in some tree reaches the target. That depth is each class's own, since the least similarity of
0.8 or more that a set can have with a different one depends on its size; classes of sets too small to be similar to
any other are in no tree. What longer prefixes connected is not compared again at shorter ones.

Classes of a node whose one-bit sketches agree well enough are candidates, and within the candidates' components all
pairs are verified on the sets themselves, so a component also recovers pairs that no tree brought together. Sets are
compared by 64-bit hashes of their runs: two different runs would have to have equal hashes to be taken for one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import linking, scratch, skew
from docloom.llm.words import Words, mapped, mix, slices

WIDTH = 5
THRESHOLD = (4, 5)  # Jaccard similarity, as a fraction
TREES = 24
DEPTH = 8
LANES = 192
RECALL = 0.9995
_FILTER_BITS = 1 << 22  # at least
_COLUMNS = 1024  # runs compared at a time


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Longest prefix, from ``depth`` downwards, at which a pair at the threshold meets in some tree with chance ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_similarity(n: int) -> float | None:
    """Least similarity from the threshold on that a set of ``n`` runs can have with a different set; None if there is none."""
    num, den = THRESHOLD
    found = [(k, n + m - k) for m in range(n * num // den, n * den // num + 2) for k in range(1, min(n, m) + 1) if k < max(n, m)]
    return min((k / union for k, union in found if k * den >= num * union), default=None)


def depths(most: int = 64) -> np.ndarray:
    """Depth of the shortest prefix of sets of each size up to ``most``, from which on it stays; one more than DEPTH: in no tree."""
    least = [least_similarity(n) for n in range(1, most + 1)]
    return np.asarray([DEPTH + 1, *[DEPTH + 1 if s is None else prefix_depth(s) for s in least]])


def _sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and the texts' offsets in them."""
    shingles, offsets = words.shingles(width)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[new], owner[new]
    return shingles, np.searchsorted(owner, np.arange(len(offsets)))


def _fingerprints(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set; zeros for an empty one."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def _minima(shingles: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """Minimum of each of ``count`` hash functions over each set that isn't empty."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, count), np.uint64)
    rng = np.random.default_rng(2718)
    factors = rng.integers(1, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, count, np.uint64)
    if len(full):
        for k in range(count):
            h = shingles * factors[k] + shifts[k]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
            out[full, k] = np.minimum.reduceat(h, offsets[:-1][full])
    return out


def sign(docs: DataFrame, text: str, key: str, width: int = WIDTH) -> DataFrame:
    """key, f1, f2 (fingerprint of the set), n (its size), buckets (a trie node in each tree), trails (the steps below it), rest, sketch.

    ``rest`` is how many steps below the node a class must share with another to be its candidate.
    """
    floor = prefix_depth(THRESHOLD[0] / THRESHOLD[1])
    count = max(TREES * DEPTH, LANES)
    own_depth = depths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                shingles, offsets = _sets(Words(part.column("text")), width)
                f1, f2 = _fingerprints(shingles, offsets)
                n = np.diff(offsets)
                depth = own_depth[np.minimum(n, len(own_depth) - 1)]
                minima = mix(_minima(shingles, offsets, count))
                node = np.repeat(np.arange(TREES, dtype=np.uint64)[None], len(minima), axis=0)
                trail = np.zeros_like(node)
                for d in range(DEPTH):
                    step = minima[:, d * TREES : (d + 1) * TREES]
                    if d < floor:
                        node = mix(node ^ step) + np.uint64(1)
                    else:
                        trail = trail << np.uint64(linking._FIELD) | step >> np.uint64(64 - linking._FIELD)
                bits = np.packbits((minima[:, :LANES] >> np.uint64(40) & np.uint64(1)).astype(np.uint8), axis=1)
                sketch = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * (LANES // 8)).astype(np.int32)), pa.py_buffer(bits.tobytes())])
                in_tree = depth <= DEPTH
                ends = pa.array(np.concatenate([[0], np.cumsum(in_tree * TREES)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[in_tree].view(np.int64).ravel())) for x in (node, trail)]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(f1), pa.array(f2), pa.array(n), *lists, pa.array((depth - floor).astype(np.int32)), sketch], ["k", "f1", "f2", "n", "buckets", "trails", "rest", "sketch"])

    source = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, "k long, f1 long, f2 long, n long, buckets array<long>, trails array<long>, rest int, sketch binary")


def _jaccard(table: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The function that says which of the rows p and q have sets whose similarity reaches the threshold, exactly."""
    lists = table.column("shingles").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values, which = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.bincount(which, minlength=len(values)) > 1  # the others add to no intersection
    column = np.cumsum(shared) - 1
    keep = shared[which]
    owner, which = owner[keep], column[which[keep]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    num, den = THRESHOLD

    def near(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        both = np.zeros((len(p), len(q)), np.float32)  # counts below 2^24
        for a in range(0, int(shared.sum()), _COLUMNS):
            own = slice(*np.searchsorted(which, (a, a + _COLUMNS)))
            x = np.zeros((len(sizes), _COLUMNS), np.float32)
            x[owner[own], which[own] - a] = 1
            both += x[p] @ x[q].T
        return both.astype(np.float64) * (num + den) >= num * (sizes[p][:, None] + sizes[q][None, :])

    return near


def candidates(classes: DataFrame) -> DataFrame:
    """(id, root) of the classes (id, n, buckets, trails, rest, sketch) that the forest connects with others."""
    rows = classes.select(F.explode(F.arrays_zip("buckets", "trails")).alias("t"), "id", "rest", "n", "sketch").select(F.col("t.buckets").alias("bucket"), F.col("t.trails").alias("trail"), "id", "rest", "n", "sketch")
    share = THRESHOLD[0] / THRESHOLD[1]
    agree = (1 + share) / 2 - 4.5 * np.sqrt((1 - share * share) / 4 / LANES)  # of two sketches at the threshold, less 4.5 standard deviations
    return linking.connected(linking.candidate_edges(rows, float(agree), levels=DEPTH - prefix_depth(share), ratio=THRESHOLD))


def _classes(signed: DataFrame) -> DataFrame:
    """One row for each set of runs: f1, f2, id, first (least key), copies and what the forest needs."""
    some = [F.any_value(c).alias(c) for c in ("n", "buckets", "trails", "rest", "sketch")]
    classes = signed.filter("n > 0").groupBy("f1", "f2").agg(F.min("k").alias("first"), F.count("*").alias("copies"), *some)
    return scratch.table(classes.withColumn("id", F.monotonically_increasing_id()), "classes")


def _linked(docs: DataFrame, text: str, key: str, signed: DataFrame, count: bool) -> DataFrame:
    """f1, f2, first, copies, root, class_id (and n_links) of each class."""
    classes = _classes(signed)
    near = candidates(classes)
    near = scratch.table(near.join(classes.select("id", "f1", "f2", "first", "copies", "n"), "id"), "candidates")
    members = _with_shingles(docs, text, key, near)
    counts, edges = linking.verified(members, ["shingles"], _jaccard, count=count)
    roots = linking.connected(edges).select("id.id", F.col("root").alias("r"))
    found = classes.select("id", "f1", "f2", "first", "copies").join(roots, "id", "left")
    least = F.when(F.col("r").isNull(), F.col("first")).otherwise(F.col("r.first")).alias("class_id")
    root = F.coalesce("r.id", "id").alias("root")
    if not count:
        return found.select("f1", "f2", "first", "copies", root, least)
    return found.join(counts, "id", "left").select("f1", "f2", "copies", root, least, (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: key, class_id, n_links, f1 and f2 (the set's fingerprint), root (of the class; null without words).

    ``class_id`` is the smallest key of the documents that it is linked with, directly or through others; ``n_links``
    counts the other documents linked directly, copies included. Two documents are linked if their sets' Jaccard
    similarity is at least 0.8; texts of one to four words are a single run, so only equal ones are linked. Documents
    without words link with nothing, and neither does a null text. Null keys are a class's smallest only if it has no
    other; repeated rows are linked like any copies. An empty table gives none; other columns are not read.
    """
    signed = scratch.table(sign(docs, text, key), "signed")
    per_class = scratch.table(_linked(docs, text, key, signed, True), "per-class")
    out = skew.joined_with_classes(signed.filter("n > 0").select("k", "f1", "f2"), per_class, ["f1", "f2"], "copies")
    alone = signed.filter("n = 0").select("k", "f1", "f2", F.col("k").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("root"))
    return out.select("k", "class_id", "n_links", "f1", "f2", "root").unionByName(alone).withColumnRenamed("k", key)


def _with_shingles(docs: DataFrame, text: str, key: str, near: DataFrame) -> DataFrame:
    """One row for each candidate, with the shingles of one document of it.

    Documents are read again; most are passed over by a filter with 16 bits or more for each candidate (up to 2^28 bits;
    beyond that more pass, and the join that follows takes them out). Of those let through only documents with
    the candidate's own key stay, so its copies are not compared; of rows that repeat key and set one stays. A null key
    counts as 0 here, which is harmless since all documents of a candidate have the same set.
    """
    size = _FILTER_BITS
    number = near.count()
    while size < min(16 * number, 1 << 28):
        size *= 2
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    slots = near.select(slot(F.col("first")).alias("s"))
    bits = slots.groupBy(F.expr("cast(s div 32 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 32 as int)))").alias("b")).toPandas()
    words = np.zeros(size // 32, np.uint32)
    words[bits["w"].to_numpy(int)] = bits["b"].to_numpy(np.int64).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("s").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((words[s // 32] >> (s % 32).astype(np.uint32)) & 1 > 0))
            for part in slices(batch, "text", 1 << 20):
                shingles, offsets = _sets(Words(part.column("text")), WIDTH)
                f1, f2 = _fingerprints(shingles, offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(f1), pa.array(f2), part.column("k"), lists], ["f1", "f2", "k", "shingles"])

    whole = F.col(f"`{key}`").cast("long")
    source = docs.select(slot(whole).alias("s"), F.coalesce(whole, F.lit(0)).alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    sets = source.mapInArrow(run, "f1 long, f2 long, k long, shingles array<long>")
    same = ["f1", "f2", "k"]
    one = sets.dropDuplicates(same).join(near.withColumn("k", F.coalesce("first", F.lit(0))), same)
    return one.select(F.col("root").alias("group"), "id", "first", F.col("copies").alias("weight"), F.col("n").alias("size"), "shingles")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of each class of linked documents the rows of the smallest key; of those, one with the class's own text.

    Columns are those of ``docs``. Rows that repeat a kept row's key and text are dropped like other copies; rows without
    words all stay, null texts too. Only what connects the documents is computed, no links are counted.
    """
    cols = docs.columns
    signs = docs.select(*[F.col(f"`{c}`") for c in cols])
    plain = dict(docs.dtypes)[text] == "string"  # then the text is not sent twice
    read = text if plain else "__t"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, read):
                f1, f2 = _fingerprints(*_sets(Words(part.column(read)), WIDTH))
                names = [c for c in part.schema.names if c != "__t"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(f1), pa.array(f2)], [*names, "__f1", "__f2"])

    marked = mapped(signs if plain else signs.withColumn("__t", F.col(f"`{text}`").cast("string")), run, "__f1 long, __f2 long", read, plain)
    marked = marked.withColumn("__h", F.xxhash64(F.col(f"`{key}`").cast("long"), "__f1", "__f2"))
    signed = scratch.table(sign(docs, text, key), "signed")
    classes = _linked(docs, text, key, signed, False)
    own = classes.filter(F.col("first").eqNullSafe(F.col("class_id")))
    # a class's smallest key may have rows of several texts: one text's stays
    chosen = own.groupBy("root").agg(F.min(F.struct("f1", "f2", F.xxhash64("class_id", "f1", "f2").alias("h"))).alias("c"))
    chosen = chosen.select(F.col("c.f1").alias("__f1"), F.col("c.f2").alias("__f2"), F.col("c.h").alias("__h"))
    same = ["__h", "__f1", "__f2"]
    kept = marked.join(chosen, same, "left_semi").dropDuplicates(same)
    wordless = (F.col("__f1") == 0) & (F.col("__f2") == 0)
    return kept.unionByName(marked.filter(wordless)).select(*[F.col(f"`{c}`") for c in cols])
