"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Every item is cut into windows of 13 consecutive words (a shorter item is one window). A document contains a window
only if it contains the window's rarest word at the window's own position, so that one word is the necessary prefix.
Rarity is counted over the whole corpus. Each document position whose word may be a prefix proposes the window that
would start there, within the document's bounds; proposals are joined to the windows by hash and then compared word by
word, so that the result is exact.

What every task holds is of fixed size whatever the benchmark's size: counts and position masks over 2^20 slots of word
hashes and a filter of 2^26 bits over window hashes. A fuller filter only lets more proposals reach the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import scratch, skew
from docloom.llm.words import Words, mapped, mix, slices

WINDOW = 13
_SLOTS = 1 << 20
_FILTER_BITS = 1 << 26
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _roll(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words that begin at ``starts``."""
    out = np.full(len(starts), width, np.uint64)
    for k in range(width):
        out = out * _STEP + hashes[starts + k]
    return mix(out)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)


def _windows(items: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """One row for each window of each item: hash, words, width and the slot of each of its words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                ids, hashes, texts, widths, slots = [], [], [], [], []
                for i, item_id in enumerate(part.column("item").to_pylist()):
                    a, z = int(words.offsets[i]), int(words.offsets[i + 1])
                    n = min(width, z - a)
                    if not n:
                        continue
                    starts = np.arange(a, z - n + 1)
                    hashes.extend(_roll(words.hashes, starts, n).view(np.int64).tolist())
                    texts.extend(words.text(s, s + n) for s in starts)
                    slots.extend(_slot(words.hashes[s : s + n]).astype(np.int32).tolist() for s in starts)
                    widths.extend([n] * len(starts))
                    ids.extend([item_id] * len(starts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(hashes, pa.int64()), pa.array(texts, pa.string()), pa.array(widths, pa.int32()), pa.array(slots, pa.list_(pa.int32()))],
                    ["item", "window", "words", "width", "slots"],
                )

    chosen = items.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(cut, "item string, window long, words string, width int, slots array<int>")


def _rarity(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How often words of each wanted slot occur in the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(_slot(Words(part.column("text")).hashes), minlength=_SLOTS)
        seen = np.flatnonzero((total > 0) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["slot", "n"])

    rows = docs.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_SLOTS, np.int64)
    out[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = 0.05, keep_text: bool = True) -> DataFrame:
    """``docs`` (without ``text`` unless ``keep_text``) with n_words, n_hit, n_items, item_ids (sorted as strings) and contaminated.

    A document word is hit if it lies in an occurrence of a window; a document is contaminated if some word is hit and
    the hit words are at least ``share`` of all. Null or wordless texts have no words and are clean; wordless items
    match nothing; items with a null id are not counted. Repeated rows each get their own row. Other columns pass
    unchanged; those that clash with the result's names are replaced. An empty table gives none; texts may be of any length.
    """
    names = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")
    kept = [c for c in docs.columns if c not in names and (keep_text or c != text)]
    windows = scratch.table(_windows(items.filter(F.col(item).isNotNull()), item, item_text, window), "windows")
    wanted = np.zeros(_SLOTS, bool)
    wanted[windows.select(F.explode("slots").alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)] = True
    counts = _rarity(docs.select(F.col(text).cast("string").alias("text")), wanted)
    masks, passes = _filters(windows, counts)
    widths = sorted(masks)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for part in slices(batch, "__text"):
                words = Words(part.column("__text"))
                owner = np.repeat(np.arange(len(words)), np.diff(words.offsets))
                slots = _slot(words.hashes)
                found: list[list[dict]] = [[] for _ in range(len(words))]
                for width in widths:
                    at = masks[width][slots]
                    begins = [p - k for k in range(width) if len(p := np.flatnonzero(at >> k & 1))]
                    begins = np.unique(np.concatenate(begins)) if begins else np.zeros(0, np.int64)
                    begins = begins[(begins >= 0) & (begins + width <= len(slots))]
                    begins = begins[owner[begins] == owner[begins + width - 1]] if len(begins) else begins
                    keys = _roll(words.hashes, begins, width)
                    bit = keys & np.uint64(_FILTER_BITS - 1)
                    ok = (passes[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    for start, key in zip(begins[ok].tolist(), keys[ok].view(np.int64).tolist()):
                        i = owner[start]
                        found[i].append({"window": key, "start": int(start - words.offsets[i]), "width": width, "words": words.text(start, start + width)})
                n = np.diff(words.offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in part.schema.names if c != "__text"]
                    + [pa.array(np.arange(row, row + len(n)) + task), pa.array(n.astype(np.int64)), pa.array(found, pa.list_(pa.struct([("window", pa.int64()), ("start", pa.int64()), ("width", pa.int32()), ("words", pa.string())])))],
                    [c for c in part.schema.names if c != "__text"] + ["__row", "n_words", "__found"],
                )
                row += len(n)

    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    made = "__row long, n_words long, __found array<struct<window: bigint, start: bigint, width: int, words: string>>"
    scanned = scratch.table(mapped(source, propose, made), "proposals")
    found = scanned.filter(F.size("__found") > 0).select("__row", F.explode("__found").alias("f")).select("__row", "f.*")
    sets, set_items = _item_sets(windows)
    uses = found.groupBy("window", "words").agg(F.count("*").alias("uses"))
    known = scratch.table(sets.join(uses, ["window", "words"]), "known")
    hits = scratch.table(skew.joined_with_classes(found, known, ["window", "words"], "uses").select("__row", "start", "width", "s1", "s2"), "hits")
    seen = Window.partitionBy("__row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("__row", "start").agg(F.max(F.col("start") + F.col("width")).alias("end"))
    fresh = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(seen), F.lit(0))))
    words_hit = fresh.groupBy("__row").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).alias("n_hit"))
    # a document's items follow from the distinct sets of its windows
    items_hit = hits.select("__row", "s1", "s2").distinct().join(set_items, ["s1", "s2"]).groupBy("__row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    per_row = words_hit.join(items_hit, "__row")
    out = scanned.drop("__found").join(per_row, "__row", "left").drop("__row")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"),
        ((n_hit > 0) & (n_hit * round(1 / share) >= F.col("n_words"))).alias("contaminated"),
    )


def _item_sets(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each distinct window with the set of its items, named by two 64-bit sums over it; and each set's items.

    Windows that the same items share, such as those of a passage common to many, have one set. So what a document's hits
    are joined with is one row for each window, however many items hold it, and a set is spelled out once.
    """
    each = windows.select("window", "words", "item").distinct()
    total = lambda salt: F.expr(f"bit_xor(xxhash64(item, {salt}))")
    sets = scratch.table(each.groupBy("window", "words").agg(total(1).alias("s1"), total(2).alias("s2")), "sets")
    shown = sets.groupBy("s1", "s2").agg(F.min(F.struct("window", "words")).alias("w")).select("s1", "s2", "w.window", "w.words")
    return sets, each.join(shown, ["window", "words"]).select("s1", "s2", "item")


def _filters(windows: DataFrame, counts: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """For each width, the positions at which a slot's word is a window's prefix; and the filter over window hashes.

    Built in tasks and merged as arrays of fixed size, so the benchmark may be of any size.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        bits = []
        for batch in batches:
            for width, slots, key in zip(batch["width"], batch["slots"], batch["window"]):
                slots = np.asarray(slots)
                k = int(np.argmin(counts[slots]))  # the first of equally rare words
                own.setdefault(int(width), np.zeros(_SLOTS, np.uint16))[slots[k]] |= np.uint16(1 << k)
                bits.append(key & (_FILTER_BITS - 1))
        for width, mask in own.items():
            at = np.flatnonzero(mask)
            yield pd.DataFrame({"width": width, "at": at, "value": mask[at].astype(np.int64)})
        at, value = np.unique(np.asarray(bits, np.int64) >> 3, return_inverse=True)
        byte = np.zeros(len(at), np.int64)
        np.bitwise_or.at(byte, value, 1 << (np.asarray(bits, np.int64) & 7))
        yield pd.DataFrame({"width": 0, "at": at, "value": byte})

    merged = windows.select("width", "slots", "window").mapInPandas(build, "width int, at long, value long").groupBy("width", "at").agg(F.bit_or("value").alias("value")).toPandas()
    passes = np.zeros(_FILTER_BITS >> 3, np.uint8)
    masks: dict[int, np.ndarray] = {}
    for width, rows in merged.groupby("width"):
        if width == 0:
            passes[rows["at"].to_numpy()] = rows["value"].to_numpy(np.uint8)
        else:
            masks.setdefault(int(width), np.zeros(_SLOTS, np.uint16))[rows["at"].to_numpy()] = rows["value"].to_numpy(np.uint16)
    return masks, passes
