"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A sequence's cost is that of its pieces: a linear term and a quadratic one for attention. Documents are taken in
descending order of length and each goes whole to the cheapest sequence that still has room for it; only where none has,
a document is cut. Every task packs the documents that it reads, a window of some million tokens at a time, and hands
the tokens that would leave a sequence unfilled on to the next window. So nothing is shuffled, memory is bounded, and a
task leaves one sequence padded at most.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import extended, hash_spans, slices

CAPACITY = 2048
END = 1
_WINDOW_TOKENS = 1 << 22
_LINEAR, _QUADRATIC = 1.0, 1.0 / 1024


def cost(length: int | np.ndarray) -> float | np.ndarray:
    """Estimated cost of attending within a piece."""
    return _LINEAR * length + _QUADRATIC * length * length


class Encoder:
    """Token ids of whole texts.

    The vocabulary's pre-tokenizer always begins a new unit at a space between two characters that are not white space.
    The texts of a chunk are cut there, on their bytes, and each distinct unit is tokenized once: units of plain Latin
    text all in one string by the faster of two implementations of the vocabulary's byte-pair merges, other units by
    ``tokenizers``. A text with white space beyond ASCII, with the literal of an added token, or with a unit whose bytes
    differ from those that its hash stands for, is tokenized as one by ``tokenizers``.
    """

    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the vocabulary's
    _PLAIN = 0xC8  # no larger byte in text below U+0240

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]}
        self.added = [t.encode() for t in sorted(special) if t]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in unit): i for unit, i in self.tokenizer.get_vocab().items() if unit not in special}
        self.merges = tiktoken.Encoding("merges", pat_str=self._PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(u) for u in ranks]

    def exact(self, texts: list[str]) -> list[np.ndarray]:
        """Ids by ``tokenizers`` alone."""
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(bounds[0]), int(bounds[-1])
        if first == last:
            return [np.zeros(0, "<u4")] * len(texts)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
        bounds = bounds - first
        starts, ends, odd = self._units(raw, bounds)
        odd |= self._with_added(raw, bounds)
        keys = hash_spans(raw, starts, ends)
        _, like, which = np.unique(keys, return_index=True, return_inverse=True)
        differ = self._differ(raw, starts, ends, like[which])
        text_of = np.searchsorted(bounds, starts, side="right") - 1
        odd[text_of[differ]] = True
        plain = (np.maximum.reduceat(raw, starts) <= self._PLAIN) & (raw[starts] == 32)
        ids, to = self._encode(raw, starts[like], ends[like], plain[like])
        counts = np.diff(np.concatenate([[0], to]))
        each = counts[which]
        upto = np.cumsum(each)
        all_ids = ids[np.arange(upto[-1]) + np.repeat((to - counts)[which] - (upto - each), each)]
        edges = np.concatenate([[0], upto])[np.searchsorted(starts, bounds)]
        out = [all_ids[a:z] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist())]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.exact([texts[i].as_py()])[0]
        return out

    @staticmethod
    def _units(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of units, and which texts hold white space beyond ASCII."""
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        cut = np.zeros(len(raw), bool)
        cut[1:-1] = (raw[1:-1] == 32) & ~blank[:-2] & ~blank[2:]
        inner = bounds[(bounds > 0) & (bounds < len(raw))]
        cut[inner - 1] = False  # a text's last character
        cut[inner] = True
        cut[0] = True
        starts = np.flatnonzero(cut)
        lead = np.flatnonzero(raw[:-1] >= 0xC2)
        pair = raw[lead].astype(np.int64) << 8 | raw[lead + 1]
        spaces = lead[np.isin(pair, (0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380))]
        third = raw[np.minimum(spaces + 2, len(raw) - 1)]
        two = raw[spaces] == 0xC2
        spaces = spaces[two | (third <= 0x8A) | np.isin(third, (0x9F, 0xA8, 0xA9, 0xAF))]
        odd = np.zeros(len(bounds) - 1, bool)
        odd[np.searchsorted(bounds, spaces, side="right") - 1] = True
        return starts, np.append(starts[1:], len(raw)), odd

    def _with_added(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts hold the literal of an added token; one that two texts share marks the first."""
        found = np.zeros(len(bounds) - 1, bool)
        data = raw.tobytes()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                own = int(np.searchsorted(bounds, at, side="right")) - 1
                found[own] = True
                at = data.find(token, max(int(bounds[own + 1]), at + 1))
        return found

    @staticmethod
    def _differ(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Units whose bytes are not those of the unit at ``like``."""
        wrong = (ends - starts) != (ends - starts)[like]
        same = np.flatnonzero(~wrong)
        for part in np.array_split(same, max(1, len(raw) >> 20)):
            n = (ends - starts)[part]
            if not n.sum():
                continue
            run = np.cumsum(n)
            at = np.arange(run[-1]) + np.repeat(starts[part] - (run - n), n)
            bad = np.flatnonzero(raw[at] != raw[at + np.repeat(starts[like[part]] - starts[part], n)])
            wrong[part[np.searchsorted(run, bad, side="right")]] = True
        return np.flatnonzero(wrong)

    def _encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units together and where those of each unit end."""
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        data = raw.tobytes()
        chosen = np.flatnonzero(plain)
        if len(chosen):
            joined = b"".join(data[a:z] for a, z in zip(starts[chosen].tolist(), ends[chosen].tolist()))
            ids = np.asarray(self.merges.encode_ordinary(joined.decode()), "<u4")
            upto = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum((ends - starts)[chosen])) + 1
            counts[chosen] = np.diff(np.concatenate([[0], upto]))
            parts.append((chosen, ids))
        others = np.flatnonzero(~plain)
        if len(others):
            apart = self.exact([data[starts[i] : ends[i]].decode() for i in others.tolist()])
            counts[others] = [len(ids) for ids in apart]
            parts.append((others, np.concatenate(apart)))
        to = np.cumsum(counts)
        out = np.zeros(int(to[-1]), "<u4")
        for units, ids in parts:
            n = counts[units]
            run = np.cumsum(n)
            if len(ids):
                out[np.arange(run[-1]) + np.repeat((to - counts)[units] - (run - n), n)] = ids
        return out, to


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def assign(lengths: np.ndarray, capacity: int, sequences: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces (document, its start, length, sequence) that fill ``sequences``, and those left (document, start, length).

    Whole sequences are cut from longer documents first. Ties in cost go to the sequence of the lower number.
    """
    pieces: list[tuple[int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, start = int(lengths[i]), 0
        while n - start >= capacity and used < sequences:
            pieces.append((i, start, capacity, used))
            start, used = start + capacity, used + 1
        if n > start:
            rest.append((i, start, n - start))
    room = np.full(sequences - used, capacity, np.int64)
    price = np.zeros(sequences - used)
    rest.sort(key=lambda p: -p[2])
    left: list[tuple[int, int, int]] = []
    cut: list[tuple[int, int, int]] = []
    for i, start, n in rest:
        fits = np.flatnonzero(room >= n)
        if len(fits):
            s = int(fits[np.argmin(price[fits])])
            pieces.append((i, start, n, used + s))
            room[s] -= n
            price[s] += cost(n)
        else:
            cut.append((i, start, n))
    for i, start, n in cut:
        while n and len(room) and (s := int(np.argmax(room))) >= 0 and room[s]:
            take = min(n, int(room[s]))
            pieces.append((i, start, take, used + s))
            room[s] -= take
            price[s] += cost(take)
            start, n = start + take, n - take
        if n:
            left.append((i, start, n))
    return pieces, left


_OUT = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("token_ids", pa.binary())]


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row for each piece: the document's key, start, length, ids_crc32, doc_tokens, sequence_id, offset, token_ids.

    A document is its token ids and then ``end``; null texts are empty, so they are one token. ``token_ids`` holds the
    piece's ids as little-endian unsigned 32-bit values (left out unless ``with_ids``). Repeated rows and null keys are
    documents like others. Other columns of ``docs`` are not read; the key comes first, whatever it is called. An empty
    table gives none.
    """
    fields = _OUT if with_ids else _OUT[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = Encoder(tokenizer), np.asarray([end], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        kind = None
        waiting: list[tuple[object, bytes, int, int]] = []  # key, the ids that wait, the document's ids before them, all of its ids
        held = 0

        def flush(final: bool) -> pa.RecordBatch:
            nonlocal waiting, held, sequence
            lengths = np.asarray([len(w[1]) // 4 for w in waiting], np.int64)
            count = -(-held // capacity) if final else held // capacity
            pieces, left = assign(lengths, capacity, count)
            rows: list[list] = [[] for _ in range(len(fields) + 1)]
            filled = np.zeros(count, np.int64)
            for i, start, n, s in pieces:
                name, ids, before, total = waiting[i]
                part = ids[4 * start : 4 * (start + n)]
                for column, value in zip(rows, (name, before + start, n, zlib.crc32(part), total, sequence + s, int(filled[s]), part)):
                    column.append(value)
                filled[s] += n
            sequence += count
            waiting = [(waiting[i][0], waiting[i][1][4 * start : 4 * (start + n)], waiting[i][2] + start, waiting[i][3]) for i, start, n in left]
            held = sum(n for _, _, n in left)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], kind)] + [pa.array(c, t) for c, (_, t) in zip(rows[1:], fields)], [key] + [f for f, _ in fields])

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in slices(batch, "text", 8 << 20):
                for name, ids in zip(part.column(0).to_pylist(), encode(part.column("text"))):
                    ids = ids.tobytes() + last
                    waiting.append((name, ids, 0, len(ids) // 4))
                    held += len(ids) // 4
                if held >= _WINDOW_TOKENS:
                    yield flush(False)
        if waiting:
            yield flush(True)

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    names = {pa.int64(): "bigint", pa.binary(): "binary"}
    schema = extended(source.select("key").withColumnRenamed("key", key).schema, ", ".join(f"{f} {names[t]}" for f, t in fields))
    return source.mapInArrow(run, schema)
