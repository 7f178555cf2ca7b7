"""Language of mixed-language text: scripts narrow the candidates, Viterbi labels the words.

From documents of known language it is counted how often each language uses each word and each run of three bytes; both
counts are kept in a fixed number of hashed slots, so the model's size does not depend on the corpus. A word's score for
a language is its log-probability there, of the whole word where it was seen often enough and else of its byte runs. The
script of a word's first letter rules out languages that hardly use it. The best labelling of all words of a text, in which
each change of language costs a fixed penalty, gives spans; the language with most letters in them is the prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import Words, mapped, mix, slices

UNKNOWN = "und"
_WORD_SLOTS = 1 << 16
_RUN_SLOTS = 1 << 15
_SWITCH = 6.0
_BLOCK = 512
_FEW = 8  # languages up to which texts are cut into blocks
_WORD, _RUN, _SCRIPT = range(3)  # kinds of counts
#: First code point after each script's range, in order; fixed values of the Unicode blocks.
SCRIPTS = (("latin", 0x0370), ("greek", 0x0400), ("cyrillic", 0x0530), ("armenian", 0x0590), ("hebrew", 0x0600), ("arabic", 0x0900), ("indic", 0x0E00), ("thai", 0x0E80), ("other", 0x1100), ("hangul", 0x1200), ("other", 0x1E00), ("latin", 0x1F00), ("greek", 0x2000), ("other", 0x3040), ("kana", 0x3400), ("han", 0xA000), ("other", 0xAC00), ("hangul", 0xD7B0), ("other", 0x110000))
_SCRIPT_NAMES = sorted({name for name, _ in SCRIPTS})
_SCRIPT_ENDS = np.asarray([end for _, end in SCRIPTS])
_SCRIPT_OF = np.asarray([_SCRIPT_NAMES.index(name) for name, _ in SCRIPTS])


def _letterless() -> np.ndarray:
    """Code points from 128 on that are not letters."""
    return np.asarray([c for c in range(128, 0x30000) if not unicodedata.category(chr(c)).startswith("L") and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")])


_NO_LETTER = np.zeros(0x110000, bool)
_NO_LETTER[:128] = True
_NO_LETTER[_letterless()] = True
for _c in (*range(65, 91), *range(97, 123)):
    _NO_LETTER[_c] = False


class Read:
    """Words with a letter of some texts: their slots, scripts, letters, and the slots of their byte runs."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        low = words.low
        lead = (low & 0xC0) != 0x80  # bytes that begin a character
        code = _code_points(low, np.flatnonzero(lead))
        letter = ~_NO_LETTER[code]
        upto = np.concatenate([[0], np.cumsum(letter)])
        character = np.concatenate([[0], np.cumsum(lead)])
        first, last = character[words.starts], character[words.ends]
        letters = upto[last] - upto[first]
        has = letters > 0
        place = np.flatnonzero(letter)
        begin = place[np.minimum(upto[first], max(len(place) - 1, 0))] if len(place) else first
        self.words = words
        self.index = np.flatnonzero(has)
        self.letters = letters[has]
        self.script = _SCRIPT_OF[np.searchsorted(_SCRIPT_ENDS, code[begin[has]], side="right")] if has.any() else np.zeros(0, np.int64)
        self.slot = (words.hashes[has] & np.uint64(_WORD_SLOTS - 1)).astype(np.int64)
        self.offsets = np.searchsorted(self.index, words.offsets)
        self.starts, self.ends = words.starts[has], words.ends[has]
        self.first, self.last = character[self.starts], character[self.ends]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each run of three bytes, a word's edges included, and the end of each word's runs in them."""
        n = self.ends - self.starts
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        within = np.arange(total) - np.repeat(upto - n, n)
        at = within + np.repeat(self.starts, n)
        low = self.words.low
        before = np.where(within > 0, low[at - 1], 32).astype(np.uint64)
        after = np.where(within < np.repeat(n, n) - 1, low[np.minimum(at + 1, max(len(low) - 1, 0))], 32).astype(np.uint64)
        key = mix(before << np.uint64(16) | low[at].astype(np.uint64) << np.uint64(8) | after)
        return (key & np.uint64(_RUN_SLOTS - 1)).astype(np.int64), upto


def _code_points(low: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Code point of each character that begins at ``lead``; bytes outside words count as blanks."""
    padded = np.concatenate([low, np.zeros(3, np.uint8)]).astype(np.int32)
    b0, b1, b2, b3 = (padded[lead + k] for k in range(4))
    out = np.where(b0 < 0x80, b0, 32)
    out = np.where((b0 >= 0xC0) & (b0 < 0xE0), (b0 & 31) << 6 | b1 & 63, out)
    out = np.where((b0 >= 0xE0) & (b0 < 0xF0), (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, out)
    return np.where(b0 >= 0xF0, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63, out)


@dataclass
class Model:
    """Log-probabilities by slot and language, whether a word slot was seen enough, and each script's languages."""

    names: list[str]
    word: np.ndarray
    seen: np.ndarray
    run: np.ndarray
    allowed: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 20) -> Model:
    """Count over all rows of ``docs`` with text and language; every language is learned.

    What reaches the driver does not grow with the corpus but with the number of languages: counts by slot, script and
    language, of which those above 0 are sent.
    """
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter("text is not null and lang is not null")
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())

    sizes = {_WORD: _WORD_SLOTS, _RUN: _RUN_SLOTS, _SCRIPT: len(_SCRIPT_NAMES)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(names) * n, np.int64) for k, n in sizes.items()}
        number = {name: i for i, name in enumerate(names)}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                read = Read(part.column("text"))
                of = np.asarray([number[x] for x in part.column("lang").to_pylist()], np.int64)
                owner = np.repeat(of, np.diff(read.offsets))
                runs, _ = read.runs()
                run_owner = np.repeat(owner, read.ends - read.starts)
                for kind, slots, whose in ((_WORD, read.slot, owner), (_SCRIPT, read.script, owner), (_RUN, runs, run_owner)):
                    at = whose * sizes[kind] + slots
                    if totals[kind].size <= 1 << 20:
                        totals[kind] += np.bincount(at, minlength=totals[kind].size)
                    else:  # many languages: only what occurs is touched
                        at, n = np.unique(at, return_counts=True)
                        totals[kind][at] += n
        for kind, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int8)), pa.array((at // sizes[kind]).astype(np.int32)), pa.array((at % sizes[kind]).astype(np.int32)), pa.array(total[at])], ["kind", "which", "slot", "n"])

    found = rows.mapInArrow(count, "kind tinyint, which int, slot int, n long").groupBy("kind", "which", "slot").agg(F.sum("n").alias("n")).toPandas()
    tables = {}
    for kind, size in sizes.items():
        own = found[found["kind"] == kind]
        tables[kind] = np.zeros((size, max(len(names), 1)), np.float32)
        tables[kind][own["slot"].to_numpy(int), own["which"].to_numpy(int)] = own["n"].to_numpy(np.float32)
    share = lambda t: np.log((t + 0.5) / (t.sum(0) + 0.5 * len(t)))
    script = tables[_SCRIPT] / np.maximum(tables[_SCRIPT].sum(0), 1)
    return Model(names, share(tables[_WORD]).astype(np.float32), tables[_WORD].sum(1) >= least, share(tables[_RUN]).astype(np.float32), script >= 0.001)


def _word_scores(model: Model, read: Read) -> np.ndarray:
    """Log-probability of each word by language, over the best of them; a language that lacks the word's script gets a low one."""
    runs, upto = read.runs()
    n = read.ends - read.starts
    by_run = np.zeros((len(n), len(model.names)), np.float32)
    if len(n):
        for k in range(len(model.names)):
            by_run[:, k] = np.add.reduceat(model.run[runs, k], upto - n) / n
    scores = np.where(model.seen[read.slot][:, None], model.word[read.slot], 2 * by_run)
    scores = np.where(model.allowed[read.script], scores, -40.0)
    return np.maximum(scores - scores.max(1, keepdims=True, initial=-80.0), -8.0) if len(n) else scores


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float = _SWITCH) -> np.ndarray:
    """Label of each word such that the sum of scores less ``penalty`` for each change within a text is largest.

    With few labels, texts are cut into blocks that are solved for every label before them at once, so that one long text
    takes no more steps than its blocks' length and number. With many labels a text is one block, and what is kept of a
    word grows with their number, not with its square. Ties keep the label, and then go to the first.
    """
    k = scores.shape[1]
    n = len(scores)
    labels = np.zeros(n, np.int64)
    if not n or k == 1:
        return labels
    counts = np.diff(offsets)
    length = _BLOCK if k <= _FEW else max(int(counts.max()), 1)
    blocks = -(-counts // length)
    text = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[:-1][text] + nth * length
    size = np.minimum(counts[text] - nth * length, length)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    before = k if k <= _FEW else 1  # labels before a block that are told apart
    best = np.full((len(start), before, k), -penalty)  # by the label before the block and the label now
    if before == k:
        best[:, np.arange(k), np.arange(k)] = 0
    else:
        best[:] = 0  # no block stands before
    stay = np.zeros((n, before, k), bool)  # of each word
    top = np.zeros((n, before), np.int32)
    for t in range(int(size[0])):
        live = int(np.searchsorted(-size, -t, side="left"))
        now = best[:live]
        if t:
            lead = now.argmax(2)
            peak = np.take_along_axis(now, lead[:, :, None], 2) - penalty
            keep = now >= peak
            stay[start[:live] + t], top[start[:live] + t] = keep, lead
            now = np.where(keep, now, peak)
        best[:live] = now + scores[start[:live] + t][:, None, :]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = np.cumsum(blocks) - blocks
    into = np.zeros(len(order), np.int64)  # label before each block
    out = np.zeros(len(order), np.int64)  # label at its end
    long = np.flatnonzero(blocks > 1)
    single = place[first[np.flatnonzero(blocks == 1)]]
    free = best.max(1)  # the first block begins with any label at no cost: the largest entry has none before it
    out[single] = free[single].argmax(1)
    into[single] = np.take_along_axis(best[single], out[single][:, None, None], 2)[:, :, 0].argmax(1)
    for i in long.tolist():
        own = place[first[i] : first[i] + blocks[i]]
        total, back = free[own[0]], [best[own[0]].argmax(0)]
        for b in own[1:]:
            step = total[:, None] + best[b]
            back.append(step.argmax(0))
            total = step.max(0)
        label = int(total.argmax())
        for b, came in zip(own[::-1], back[::-1]):
            out[b], into[b] = label, came[label]
            label = int(came[label])
    now = out.copy()
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))
        labels[start[:live] + t] = now[:live]
        if t:
            keep = stay[start[:live] + t, into[:live], now[:live]]
            now[:live] = np.where(keep, now[:live], top[start[:live] + t, into[:live]])
    return labels


def detect(docs: DataFrame, model: Model, text: str = "text", spans: bool = True, penalty: float = _SWITCH) -> DataFrame:
    """``docs`` with lang_pred, score (share of letters in that language's spans) and spans (start, end, lang).

    Span bounds are code points, end exclusive, and run from a span's first word to its last. Texts that are null or have
    no letter, and all texts if nothing was learned, get ``und``, 0 and no spans. Whole texts are read; repeated rows and
    null keys are rows like others, and an empty table gives none. Columns with these names are replaced.
    """
    names = ("lang_pred", "score", "spans")
    kept = [c for c in docs.columns if c not in names]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.asarray([*model.names, UNKNOWN], object)
        most = min(1 << 20, max(1 << 15, (1 << 23) // len(known)))  # bytes at a time: a word has a score for each language
        for batch in batches:
            for part in slices(batch, "__text", most):
                read = Read(part.column("__text"))
                if not model.names:
                    read.offsets = read.offsets * 0
                n = len(read.offsets) - 1
                label = viterbi(_word_scores(model, read), read.offsets, penalty) if model.names else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(n), np.diff(read.offsets))
                votes = np.bincount(owner * len(known) + label, read.letters[: len(owner)], minlength=n * len(known)).reshape(n, len(known))
                total = votes.sum(1)
                best = np.where(total > 0, votes.argmax(1), len(known) - 1)
                share = np.where(total > 0, votes.max(1) / np.maximum(total, 1), 0.0)
                columns = [part.column(c) for c in part.schema.names if c != "__text"] + [pa.array(known[best].tolist(), pa.string()), pa.array(share)]
                if spans:
                    columns.append(_spans(read, owner, label, known, kind, n))
                yield pa.RecordBatch.from_arrays(columns, [c for c in part.schema.names if c != "__text"] + list(names[: 2 + spans]))

    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    made = "lang_pred string, score double" + ", spans array<struct<start: bigint, end: bigint, lang: string>>" * spans
    return mapped(source, run, made)


def _spans(read: Read, owner: np.ndarray, label: np.ndarray, known: np.ndarray, kind: pa.DataType, n: int) -> pa.Array:
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(label))[: len(at)] - 1
    lead = (read.words.low & 0xC0) != 0x80
    base = np.concatenate([[0], np.cumsum(lead)])[read.words.bounds[:-1]]
    begin, stop = read.first[at] - base[owner[at]], read.last[end] - base[owner[at]]
    offsets = np.searchsorted(owner[at], np.arange(n + 1))
    items = pa.StructArray.from_arrays([pa.array(begin), pa.array(stop), pa.array(known[label[at]].tolist(), pa.string())], ["start", "end", "lang"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, type=kind)
