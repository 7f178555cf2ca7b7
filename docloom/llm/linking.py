"""Links between near-equal things: candidates from buckets, exact links within blocks, connected components.

What all similarity operators here share. Each thing has a 64-bit id and some buckets. Things of a bucket whose sketches
(one bit for each of some random features) agree often enough become candidates of each other; the components of the
candidate graph are small and tight. In each, all pairs are then verified exactly. Only counts of links and one edge to a
representative leave a task, never all pairs of a group. A bucket or component of more than ``block`` things is cut into
blocks, and each pair of blocks is a group of its own, so no group exceeds twice that and no pair is lost. Joins on a
component's root or a hub of edges may have a third of all rows on one key; these are plain equi-joins of narrow rows,
whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import scratch

_SMALL = 8  # things in a group whose pairs are compared for all groups at once


def paired_blocks(rows: DataFrame, group: str, member: str, block: int, size: str | None = None, most: int = 1 << 19) -> DataFrame:
    """``rows`` with ``__g`` (a hash of group and pair of blocks), ``__low``, ``__high`` and ``__own`` (the row's block).

    Groups of at most ``block`` rows, whose ``size`` adds to ``most`` at the most, are one block. Larger ones are cut by a
    hash of ``member``; a row then occurs once for each block that its own is paired with.
    """
    blocks = F.ceil(F.count("*") / block)
    if size:
        blocks = F.greatest(blocks, F.ceil(F.sum(size) / most))
    large = rows.groupBy(group).agg(blocks.cast("int").alias("__n")).filter(F.col("__n") > 1)
    own = rows.join(large, group, "left").withColumn("__q", F.coalesce("__n", F.lit(1)))
    own = own.withColumn("__own", F.when(F.col("__q") > 1, F.pmod(F.xxhash64(member, F.lit(11)), F.col("__q"))).otherwise(F.lit(0)).cast("int"))
    out = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__q") - 1)))
    out = out.withColumn("__low", F.least("__own", "__other")).withColumn("__high", F.greatest("__own", "__other"))
    return out.withColumn("__g", F.xxhash64(group, "__low", "__high")).drop("__n", "__q", "__other", group)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the bounds of the groups in them; the input is sorted by ``__g``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("__g").to_numpy(zero_copy_only=False)
        if last is not None and keys[-1] == last and keys[0] == last:
            held.append(batch)
            continue
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        yield from _bounded(held + [batch.slice(0, cut)])
        held, last = [batch.slice(cut)], keys[-1]
    yield from _bounded(held)


def _bounded(parts: list[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    parts = [p for p in parts if p.num_rows]
    if parts:
        table = pa.Table.from_batches(parts).combine_chunks()
        keys = table.column("__g").to_numpy()
        yield table, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def sketches(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of -1 and 1 from a column of binary sketches of equal length."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(flat, axis=1).astype(np.float32) * 2 - 1


def components(n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], root: np.ndarray | None = None) -> np.ndarray:
    """For each of ``n`` things the first one that it is connected with; ``near`` says which of two lists are neighbours.

    Things with the same ``root`` are known to be connected.
    """
    known = np.arange(n) if root is None else root
    root, left = known.copy(), np.arange(n)
    while len(left):
        first = left[0]
        own = known[left] == known[first]
        front, left = left[own], left[~own]
        root[front] = first
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for a in range(0, len(front), 512):
                rest = np.flatnonzero(~hit)
                hit[rest] = near(front[a : a + 512], left[rest]).any(0)
            hit = np.isin(known[left], known[left[hit]])
            front, left = left[hit], left[~hit]
            root[front] = first
    return root


_FIELD = 20  # bits of a level in a trail


def candidate_edges(rows: DataFrame, agree: float, block: int = 2048, levels: int = 0, ratio: tuple[int, int] = (0, 1)) -> DataFrame:
    """Edges (a, b) between things of a bucket whose sketches agree in a share of at least ``agree`` of the bits.

    ``rows`` has bucket (long), id (long), sketch (binary). Edges connect what is connected, they are not all pairs.

    With ``levels`` a bucket is a node of a trie: rows also have ``trail`` (the next ``levels`` steps below the node, 20
    bits each), ``rest`` (how many of these another thing must share with this one to be its candidate) and ``n`` (a size;
    two sizes must be within ``ratio``). Sorted by trail, things with a common prefix stand together. From the deepest
    prefix on, it is shortened a step at a time: things that a longer prefix connected are not compared again, and a run
    in which all are connected is done.
    """
    num, den = ratio

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups(batches):
            ids = table.column("id").to_numpy()
            trail, rest, size = (table.column(c).to_numpy() for c in ("trail", "rest", "n"))
            sizes = np.diff(bounds)
            a, b = [], []
            many = np.flatnonzero(sizes > _SMALL)
            few = np.flatnonzero((sizes > 1) & (sizes <= _SMALL))
            if len(few):
                rows_ = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in few.tolist()])
                group = np.repeat(few, sizes[few])
                bits = np.frombuffer(b"".join(table.column("sketch").take(pa.array(rows_)).to_pylist()), np.uint8).reshape(len(rows_), -1)
                for step in range(1, _SMALL):
                    at = np.flatnonzero(group[:-step] == group[step:]) if len(group) > step else np.zeros(0, int)
                    p, q = rows_[at], rows_[at + step]
                    ok = (_shared(trail[p], trail[q], levels) >= np.maximum(rest[p], rest[q])) & (np.minimum(size[p], size[q]) * den >= num * np.maximum(size[p], size[q]))
                    differ = np.bitwise_count(bits[at] ^ bits[at + step]).sum(1)
                    ok &= differ <= (1 - agree) * 8 * bits.shape[1]
                    a.append(ids[p[ok]])
                    b.append(ids[q[ok]])
            for i in many.tolist():
                own = slice(bounds[i], bounds[i + 1])
                x = sketches(table.column("sketch").slice(bounds[i], sizes[i]))
                root = _node(x, trail[own], rest[own], size[own], (2 * agree - 1) * x.shape[1], levels, ratio)
                linked = np.flatnonzero(root != np.arange(len(x)))
                a.append(ids[own][root[linked]])
                b.append(ids[own][linked])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                low, high = np.minimum(a, b), np.maximum(a, b)
                pairs = np.unique(np.stack([low, high], axis=1)[low != high], axis=0) if len(low) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    if not levels:
        rows = rows.withColumns({"trail": F.lit(0).cast("long"), "rest": F.lit(0), "n": F.lit(0).cast("long")})
    dealt = paired_blocks(rows, "bucket", "id", block).select("__g", "trail", "id", "rest", "n", "sketch")
    ordered = dealt.repartition("__g").sortWithinPartitions("__g", "trail")
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def _shared(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    """How many steps from the first on two trails have in common."""
    differ = (a ^ b).view(np.uint64)
    return sum((differ >> np.uint64(_FIELD * k) == 0).astype(np.int64) for k in range(levels)) if levels else np.zeros(len(a), np.int64)


def _node(x: np.ndarray, trail: np.ndarray, rest: np.ndarray, size: np.ndarray, least: float, levels: int, ratio: tuple[int, int]) -> np.ndarray:
    """For each thing of a trie's node, sorted by trail, the first one that it is connected with."""
    num, den = ratio
    root = np.arange(len(x))
    beside = _shared(trail[:-1], trail[1:], levels)  # longest common prefix of neighbours
    for level in range(levels, -1, -1):
        cuts = np.concatenate([[0], np.flatnonzero(beside < level) + 1, [len(x)]])
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at = np.arange(start, end)[rest[start:end] <= level]
            if len(at) < 2 or (root[at] == root[at[0]]).all():
                continue

            def near(p: np.ndarray, q: np.ndarray, at: np.ndarray = at) -> np.ndarray:
                p, q = at[p], at[q]
                ok = x[p] @ x[q].T >= least
                m, n = size[p][:, None], size[q][None, :]
                return ok & (np.minimum(m, n) * den >= num * np.maximum(m, n))

            found = at[components(len(at), near, root[at])]
            moved = np.flatnonzero(root[found] != root[at])
            if len(moved):  # also things outside ``at`` that longer prefixes connected
                into = dict(zip(root[at[moved]].tolist(), root[found[moved]].tolist()))
                root = np.asarray([into.get(r, r) for r in root.tolist()])
    return root


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) of everything in ``edges`` (a, b); the root is the smallest id (a number or struct) that it is connected with.

    Alternates two steps until the edges stop changing: each thing's larger neighbours are moved to its smallest
    neighbour, then its smaller ones are. The distance to the root shrinks to a fraction with each round.
    """
    now = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        following = scratch.table(small.filter("a <> b").distinct(), "edges")
        scratch.drop(now)
        now = following
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        state = tuple(row)


def verified(members: DataFrame, payload: list[str], links: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]], block: int = 512, count: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """Exact links within groups: (id, n_links) summed over the linked things' weights, and edges (a, b) that connect them.

    ``members`` has ``group``, ``id``, ``first`` (what a component's smallest is sought of, may be null), ``weight``,
    ``size`` (of the payload; a block's sizes add to half a million at most) and the ``payload`` columns. ``links(table)``
    gives the function that says which rows p are linked with which rows q of a group's table; it is symmetric. A thing
    that occurs twice counts once. Ends of edges are structs of first and id, in which null is the largest first. Unless ``count``, links
    are not counted, and nothing is compared that others already connect.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.Table] = []
        for table, bounds in groups(batches):
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                part = table.slice(start, end - start)
                _, first = np.unique(part.column("id").to_numpy(), return_index=True)
                if len(first) < 2:
                    continue
                part = part.take(pa.array(first))
                own, weight = part.column("__own").to_numpy(), part.column("weight").to_numpy()
                low, high = part.column("__low")[0].as_py(), part.column("__high")[0].as_py()
                p, q = np.flatnonzero(own == low), np.flatnonzero(own == high)
                if not len(p) or not len(q):
                    continue
                n, linked_with = np.zeros(len(own), np.int64), links(part)
                if count:
                    hit = linked_with(p, q)
                    if low == high:
                        np.fill_diagonal(hit, False)
                    n[p] += hit @ weight[q]
                    if low != high:
                        n[q] += hit.T @ weight[p]
                    full = np.zeros((len(own), len(own)), bool)
                    full[np.ix_(p, q)] = hit
                    full |= full.T
                    root = components(len(own), lambda x, y, full=full: full[np.ix_(x, y)])
                    linked = np.flatnonzero(n > 0)
                else:
                    root = components(len(own), linked_with)
                    linked = np.flatnonzero(root != np.arange(len(root)))
                if len(linked):
                    ends = [part.column(c).take(pa.array(i)) for i in (linked, root[linked]) for c in ("id", "first")]
                    out.append(pa.table([ends[0], ends[1], pa.array(n[linked]), ends[2], ends[3]], ["id", "first", "n", "root", "root_first"]))
            if sum(len(t) for t in out) > 10_000:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    dealt = paired_blocks(members, "group", "id", block, "size").select("__g", "__low", "__high", "__own", "id", "first", "weight", *payload)
    ordered = dealt.repartition("__g").sortWithinPartitions("__g")
    found = scratch.table(ordered.mapInArrow(check, "id long, first long, n long, root long, root_first long"), "links")
    end = lambda i, f: F.struct(F.col(f).isNull().alias("none"), F.col(f).alias("first"), F.col(i).alias("id"))
    edges = found.filter("id <> root").select(end("id", "first").alias("a"), end("root", "root_first").alias("b"))
    return found.groupBy("id").agg(F.sum("n").alias("n_links")) if count else None, edges
