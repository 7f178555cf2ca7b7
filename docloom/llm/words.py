"""Words of whole texts as 64-bit hashes, for a column of texts at once.

A word is a run of letters and digits after A-Z became a-z; every non-ASCII character counts as a letter. In UTF-8
these are exactly the runs of bytes outside the other ASCII ranges, so the column's byte buffer is cut without decoding
it, and all hashing is done on arrays. Hash equality stands for equality of words only where a caller verifies it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

_BLOCK = 1 << 18  # bytes hashed at a time, so that the arrays stay in the processor's cache
_BASE = 0x9E3779B97F4A7C15 | 1


def _byte_table() -> np.ndarray:
    """Each byte in lower case, or 0 for a byte that no word has."""
    table = np.zeros(256, np.uint8)
    for byte in range(256):
        low = byte + 32 if 65 <= byte <= 90 else byte
        if 48 <= low <= 57 or 97 <= low <= 122 or low >= 128:
            table[byte] = low
    return table


BYTES = _byte_table()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(_BASE, _BLOCK + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each of ``starts`` to its end; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(out):
        to = int(np.searchsorted(ends, starts[at] + _BLOCK, side="right"))
        if to <= at:  # longer than a block
            out[at] = _hash_long(data, int(starts[at]), int(ends[at]))
            at += 1
            continue
        a, z = int(starts[at]), int(ends[to - 1])
        sums = np.zeros(z - a + 1, np.uint64)
        np.cumsum(data[a:z].astype(np.uint64) * _POWERS[: z - a], out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        out[at:to] = (sums[e] - sums[s]) * _INVERSE[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def _hash_long(data: np.ndarray, start: int, end: int) -> int:
    total, scale = 0, 1
    for a in range(start, end, _BLOCK):
        part = data[a : min(end, a + _BLOCK)].astype(np.uint64)
        total += int((part * _POWERS[: len(part)]).sum(dtype=np.uint64)) * scale
        scale = scale * pow(_BASE, _BLOCK, 1 << 64) % (1 << 64)
    return (total + end - start) % (1 << 64)


class Words:
    """Words of ``len(offsets) - 1`` texts; text i has those from ``offsets[i]`` to ``offsets[i + 1]``."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = (int(bounds[0]), int(bounds[-1])) if len(texts) else (0, 0)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
        bounds = bounds - first if len(texts) else np.zeros(1, np.int64)
        self.low = BYTES[raw]
        inside = self.low != 0
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = bounds[(bounds > 0) & (bounds < len(raw))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.bounds = bounds
        self.offsets = np.searchsorted(self.starts, bounds)
        self.hashes = hash_spans(self.low, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, start: int, end: int) -> str:
        """Words ``start`` to ``end`` joined by a space."""
        return " ".join(self.low[a:z].tobytes().decode("utf-8", "replace") for a, z in zip(self.starts[start:end], self.ends[start:end]))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words and each text's offsets in them; a shorter text, if it has words, is one run."""
        counts = np.diff(self.offsets)
        runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        offsets = np.concatenate([[0], np.cumsum(runs)])
        out = np.zeros(int(offsets[-1]), np.uint64)
        long = counts >= width
        if long.any():
            n = len(self.hashes) - width + 1
            rolled = np.zeros(n, np.uint64)
            for k in range(width):
                rolled = rolled * np.uint64(_BASE) + self.hashes[k : n + k]
            owner = np.repeat(np.arange(len(counts)), np.where(long, runs, 0))
            within = np.arange(len(owner)) - np.repeat(np.cumsum(np.where(long, runs, 0)) - np.where(long, runs, 0), np.where(long, runs, 0))
            out[offsets[owner] + within] = rolled[self.offsets[owner] + within]
        for i in np.flatnonzero((counts > 0) & ~long):
            value = 0
            for h in self.hashes[self.offsets[i] : self.offsets[i + 1]]:
                value = (value * _BASE + int(h)) % (1 << 64)
            out[offsets[i]] = (value + int(counts[i])) % (1 << 64)
        return mix(out), offsets


def extended(schema: StructType, more: str = "") -> StructType:
    """Result schema of a function over Arrow batches: the columns of ``schema``, whatever they are called, then those of ``more``."""

    def nullable(kind: DataType) -> DataType:
        if isinstance(kind, ArrayType):
            return ArrayType(nullable(kind.elementType))
        if isinstance(kind, MapType):
            return MapType(nullable(kind.keyType), nullable(kind.valueType))
        return StructType([StructField(f.name, nullable(f.dataType)) for f in kind.fields]) if isinstance(kind, StructType) else kind

    return StructType(nullable(schema).fields + (StructType.fromDDL(more).fields if more else []))


def mapped(source: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: str, read: str = "__text", keep: bool = False) -> DataFrame:
    """``source`` through ``run``, which reads the column ``read``, leaves it out unless ``keep``, and adds the columns of ``more``.

    All other columns have numbers for names while they pass, since names with dots are not found there.
    """
    hidden = source.toDF(*[c if c == read else f"__c{i}" for i, c in enumerate(source.columns)])
    names = [c for c in source.columns if keep or c != read]
    schema = extended((hidden if keep else hidden.drop(read)).schema, more)
    return hidden.mapInArrow(run, schema).toDF(*names, *schema.names[len(names) :])


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece have about ``most`` bytes; one text is never cut."""
    texts = batch.column(column).cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
