"""Token ids in Arrow files of equal-length sequences.

The ids of all documents in ascending order of their keys are one stream, cut into rows of a fixed length. A file is an
Arrow stream between markers with a footer of its batches; a batch has a fixed number of rows of two fixed-size lists, the
ids and a mask, a bit for each, that is true for ids and false for what fills up a file's last row. So the i-th sequence of a file lies at a
place that needs no search, and a memory-mapped file gives it without a copy. Beside each file stands one with the keys of
its documents and where each ends. A task writes the files of the range of keys that it got from the shuffle; only names
that a finished task returned are listed, so a task that ran twice leaves a file that nothing reads.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm.packing import Encoder
from docloom.llm.words import hash_spans, slices

LENGTH = 2048
END = 2
BATCH_IDS = 1 << 20  # of one batch of a file, about
FILE_IDS = 1 << 28  # of one file, about; a task may write several
_CACHED = 1 << 18  # units of either generation whose ids a worker remembers
_MANIFEST = "part int, number int, file string, n_docs long, n_ids long"


def _classes() -> np.ndarray:
    """Kind of each byte: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 apostrophe, 5 beyond ASCII."""
    kinds = np.full(256, 3, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    kinds[65:91] = kinds[97:123] = 1
    kinds[48:58] = 2
    kinds[39] = 4
    kinds[128:] = 5
    return kinds


_KINDS = _classes()


def _cuts() -> np.ndarray:
    """Between which kinds the vocabulary's pre-tokenizer always begins a new word, whatever stands around."""
    cut = np.zeros((6, 6), bool)
    cut[0, 1:] = cut[1:, 0] = True
    cut[1, 2:5] = cut[2, 1:5] = cut[3, 1:3] = True  # an apostrophe and letters may be one word: 's
    cut[4, 2] = True
    return cut


_CUTS = _cuts()


def _kinds_of(raw: np.ndarray) -> np.ndarray:
    """Kinds of bytes, where both bytes of a letter of U+00C0 to U+024F count as letters.

    Three characters stay what they are: two that are no letters, and one whose lower case ends with a mark.
    """
    kinds = _KINDS[raw]
    lead = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC9))
    pair = raw[lead].astype(np.int64) << 8 | raw[lead + 1]
    lead = lead[~np.isin(pair, (0xC397, 0xC3B7, 0xC4B0))]
    kinds[lead] = kinds[lead + 1] = 1
    return kinds


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    """One for each Python worker, which serves many tasks."""
    return WordEncoder(path)


class WordEncoder(Encoder):
    """Token ids of whole texts by a vocabulary that drops white space and marks the ends of words.

    Texts are cut, on their bytes, where such a vocabulary always begins a new word; of each distinct unit the ids are
    taken from ``tokenizers`` once and remembered for the next texts, the last units in two generations. A text with the literal of an added
    token, or with a unit whose bytes differ from those that its hash stands for, is tokenized as one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"].encode() for t in json.loads(self.tokenizer.to_str())["added_tokens"] if t["content"]]
        vocabulary = self.tokenizer.get_vocab()
        self.finals = np.zeros(max(vocabulary.values()) + 1, bool)
        self.finals[[i for unit, i in vocabulary.items() if unit.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(bounds[0]), int(bounds[-1])
        if first == last:
            return [np.zeros(0, "<u4")] * len(texts)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
        bounds = bounds - first
        kinds = _kinds_of(raw)
        cut = np.ones(len(raw) + 1, bool)
        cut[1:-1] = _CUTS[kinds[:-1], kinds[1:]] | ((kinds[:-1] == 2) & (kinds[1:] == 2))
        cut[bounds] = True
        edges = np.flatnonzero(cut)
        shown = kinds[edges[:-1]] != 0
        starts, ends = edges[:-1][shown], edges[1:][shown]
        if not len(starts):
            return [np.zeros(0, "<u4")] * len(texts)
        low = raw | ((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5
        beyond = np.maximum.reduceat(raw, starts) >= 128  # up to the next unit, which white space doesn't change
        for i in np.flatnonzero(beyond).tolist():
            low[starts[i] : ends[i]] = raw[starts[i] : ends[i]]
        odd = self._with_added(raw, bounds)
        keys = hash_spans(low, starts, ends)
        _, like, which = np.unique(keys, return_index=True, return_inverse=True)
        differ = self._differ(low, starts, ends, like[which])
        text_of = np.searchsorted(bounds, starts, side="right") - 1
        odd[text_of[differ]] = True
        coded = self._units_ids(low, starts[like], ends[like])
        counts = np.asarray([len(c) for c in coded], np.int64) // 4
        ids, to = np.frombuffer(b"".join(coded), "<u4"), np.cumsum(counts)
        each = counts[which]
        upto = np.cumsum(each)
        all_ids = ids[np.arange(upto[-1]) + np.repeat((to - counts)[which] - (upto - each), each)]
        sides = np.concatenate([[0], upto])[np.searchsorted(starts, bounds)]
        out = [all_ids[a:z] for a, z in zip(sides[:-1].tolist(), sides[1:].tolist())]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.exact([texts[i].as_py()])[0]
        return out

    def _units_ids(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of distinct units."""
        data = low.tobytes()
        units = [data[a:z] for a, z in zip(starts.tolist(), ends.tolist())]
        if len(self.known) > _CACHED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [u for u in units if u not in known and u not in older]
        single = [u for u in new if (b"'" not in u if u.isascii() else u.decode().lower().isalpha())]
        text = b" ".join(single).decode()
        ids = self.exact([text])[0] if single else np.zeros(0, "<u4")
        to = np.flatnonzero(self.finals[ids]) + 1
        fresh: dict[bytes, bytes] = {}
        if len(to) == len(single) and (not len(to) or to[-1] == len(ids)):  # each is one word
            blob, at = ids.tobytes(), 0
            for unit, z in zip(single, (4 * to).tolist()):
                fresh[unit] = blob[at:z]
                at = z
        rest = [u for u in new if u not in fresh]
        for unit, ids in zip(rest, self.exact([u.decode() for u in rest])):
            fresh[unit] = ids.tobytes()
        found = [fresh[u] if u in fresh else known[u] if u in known else older[u] for u in units]
        known.update(zip(units, found))
        return found


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if ":" in uri else os.path.abspath(uri))


class _Writer:
    """One file of sequences and one of its documents' ends, written as ids come."""

    def __init__(self, folder: str, name: str, kind: np.dtype, length: int, key: pa.DataType):
        self.fs, self.at = _filesystem(folder)
        self.fs.create_dir(self.at, recursive=True)
        self.name, self.kind, self.length, self.key = name, kind, length, key
        self.rows = max(1, BATCH_IDS // length)
        items = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(items, length)), ("mask", pa.list_(pa.bool_(), length))], {"rows": str(self.rows)})
        self.places = pa.schema([("key", key), ("end", pa.int64())])
        self.sinks = [self.fs.open_output_stream(f"{self.at}/{name}.{end}") for end in ("arrow", "documents.arrow")]
        self.out = pa.ipc.new_file(self.sinks[0], self.schema)
        self.out_places = pa.ipc.new_file(self.sinks[1], self.places)
        self.waiting, self.held, self.n_ids, self.n_docs = [], 0, 0, 0
        self.keys: list = []
        self.ends: list[int] = []

    def add(self, key: pa.Scalar, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        self.n_docs += 1
        self.keys.append(key)
        self.ends.append(self.n_ids)
        if self.held >= self.rows * self.length:
            self._flush(False)
        if len(self.keys) >= 1 << 16:
            self._flush_places()

    def _flush(self, final: bool) -> None:
        stream = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind)
        most = self.rows * self.length
        for at in range(0, len(stream), most):
            part = stream[at : at + most]
            if len(part) < most and not final:
                break
            n = -(-len(part) // self.length) * self.length
            values, mask = np.zeros(n, self.kind), np.zeros(n, bool)
            values[: len(part)], mask[: len(part)] = part, True
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        rest = len(stream) % most
        self.waiting = [stream[len(stream) - rest :].copy()] if rest and not final else []
        self.held = 0 if final else rest

    def _flush_places(self) -> None:
        if self.keys:
            self.out_places.write_batch(pa.RecordBatch.from_arrays([pa.array(self.keys, self.key), pa.array(self.ends, pa.int64())], schema=self.places))
        self.keys, self.ends = [], []

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        self._flush_places()
        for x in (self.out, self.out_places, *self.sinks):
            x.close()
        return self.name, self.n_docs, self.n_ids


def write(docs: DataFrame, tokenizer: str, folder: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, end: int = END, file_ids: int = FILE_IDS) -> None:
    """Write the ids of each text, then ``end``, in ascending order of the keys (null first) to files under ``folder``.

    ``folder`` is a new one that driver and executors share, on any file system that Arrow opens. Null and empty texts are
    ``end`` alone. Rows with one key, however many, are in the order of their texts' hashes, so they are spread over tasks
    like all others; copies stay repeated. An empty table gives no files, and a manifest without rows. Other columns are not
    read. The list of files is a table of its own, ``manifest``.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        kind = np.dtype("<u2" if len(encode.finals) <= 1 << 16 and end < 1 << 16 else "<u4")
        last, part, done = np.asarray([end], kind), TaskContext.get().partitionId(), []
        writer = None
        for whole in batches:
            for batch in slices(whole, "__text", 4 << 20):
                for name, ids in zip(batch.column(0), encode(batch.column(1))):
                    if writer is None:
                        writer = _Writer(folder, f"part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}", kind, length, batch.schema.field(0).type)
                    writer.add(name.as_py(), np.concatenate([ids.astype(kind), last]))
                    if writer.n_ids >= file_ids:
                        done.append(writer.close())
                        writer = None
        if writer is not None:
            done.append(writer.close())
        names, n_docs, n_ids = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(done), pa.int32()), pa.array(range(len(done)), pa.int32()), pa.array(names, pa.string()), pa.array(n_docs, pa.int64()), pa.array(n_ids, pa.int64())], ["part", "number", "file", "n_docs", "n_ids"])

    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text"))
    spread = rows.select("*", F.xxhash64("__text").alias("__h"), F.monotonically_increasing_id().alias("__i"))
    order = [F.col(f"`{key}`").asc_nulls_first(), F.col("__h"), F.col("__i")]
    ranged = spread.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranged.select(F.col(f"`{key}`"), "__text").mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """part, number, file, n_docs, n_ids and first_id (the ids of all files before), a row for each file in order."""
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a short row for each file
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class SequenceFile:
    """Random access to the sequences of one file; arrays are views of the mapped file where it is local."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.rows = int(self.reader.schema.metadata[b"rows"])
        self.length = self.reader.schema.field("ids").type.list_size
        n = self.reader.num_record_batches
        self.size = (n - 1) * self.rows + self.reader.get_batch(n - 1).num_rows if n else 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``i``."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        batch, at = self.reader.get_batch(i // self.rows), i % self.rows * self.length
        ids, mask = (column.values.slice(at, self.length) for column in batch.columns)
        return ids.to_numpy(), mask

    def batches(self) -> Iterator[np.ndarray]:
        """The ids that the mask shows, a batch at a time."""
        for b in range(self.reader.num_record_batches):
            ids, mask = (column.values for column in self.reader.get_batch(b).columns)
            yield ids.to_numpy() if mask.false_count == 0 else ids.filter(mask).to_numpy()

    def close(self) -> None:
        self.source.close()


def read(spark: SparkSession, folder: str, key: str, kind: object) -> DataFrame:
    """A row for each document, from the files: key (of the type ``kind``), start, n_tokens, ids_crc32."""
    schema = StructType([StructField(key, kind), *[StructField(c, LongType()) for c in ("start", "n_tokens", "ids_crc32")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first_id").to_pylist()):
                yield from _documents(f"{folder}/{name}", first, schema.names)

    files = manifest(spark, folder).select("file", "first_id")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def _documents(uri: str, first: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Documents of one file, of which a batch of ids is in memory at a time."""
    fs, path = _filesystem(f"{uri}.documents.arrow")
    file = SequenceFile(f"{uri}.arrow")
    parts = file.batches()
    held, base = np.zeros(0, "<u2"), 0  # ids from ``base`` on
    start = 0
    with fs.open_input_file(path) as source, pa.ipc.open_file(source) as places:
        for b in range(places.num_record_batches):
            batch = places.get_batch(b)
            ends = batch.column("end").to_pylist()
            sums = []
            for begin, end in zip([start, *ends[:-1]], ends):
                crc, at = 0, begin
                while at < end:
                    if at >= base + len(held):
                        base += len(held)
                        held = next(parts)
                    part = held[at - base : end - base]
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    at += len(part)
                sums.append(crc)
            starts = [start, *ends[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([first + s for s in starts], pa.int64()), pa.array([e - s for s, e in zip(starts, ends)], pa.int64()), pa.array(sums, pa.int64())], names)
            start = ends[-1]
    file.close()
