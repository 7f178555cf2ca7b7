"""Whitening, ranked lexical search and sequence files against plain versions."""

import math
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docloom.llm import lexical, scratch, sequences, whitening
from docloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_whitening(vectors: np.ndarray):
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = (fit * n - s) / n
    values, across = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, values[::-1], across[:, ::-1]


def compare_whitening(rows, keys, vectors, components):
    x, n, s, values, across = plain_whitening(vectors)
    assert {r["n"] for r in rows} == {n} and len(rows) == len(keys) * components
    got = {(r["vec_id"], r["component"]): r for r in rows}
    deviation = ((n * x - s) ** 2).sum(1)
    for c in range(components):
        want = (x - s / n) @ across[:, c] / np.sqrt(values[c])
        have = np.asarray([got[k, c + 1]["whitened"] for k in keys])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert all(abs(got[k, c + 1]["explained"] / (values[c] / values.sum()) - 1) < 1e-9 for k in keys)
    assert [got[k, 1]["deviation"] for k in keys] == deviation.tolist()
    assert max(r["identity_error"] for r in rows) < 1e-9


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = QUERIES["op11_whitening"](spark, SF).collect()
    compare_whitening(rows, [r["vec_id"] for r in table], np.asarray([r["embedding"] for r in table]), 16)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) * [9, 1, 3, 0, 1] + [0, 5, 0, 7, 0]  # a dimension without variance
    x[:, 4] = np.floor(64 * x[:, 0]) / 64 * 2  # and one that depends on another
    x[200:] = x[0]  # a third are copies
    odd = [(None, None), (1000, []), (1001, [1.0, None, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 5), (1003, [1.0, float("inf"), 0.0, 0.0, 0.0]), (1004, [1.0, 2.0])]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(*o, 1) for o in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int").repartition(7)
    compare_whitening(whitening.whiten(df).collect(), list(range(300)), x, 3)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id >= 200")).count() == 0
    assert whitening.whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_wide_and_large_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 80)) * 10.0 ** rng.integers(-1, 5, 80)  # condition number of 1e6, codes of all widths
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    rows = whitening.whiten(df).collect()
    grid, n, s, values, _ = plain_whitening(x)
    assert len(rows) == 400 * 16 and max(r["identity_error"] for r in rows) < 1e-8
    exact = [sum((n * a - b) ** 2 for a, b in zip(g, s.tolist())) for g in grid.tolist()]
    got = {r["vec_id"]: r["deviation"] for r in rows}
    assert [got[i] for i in range(400)] == [e if e < 1 << 63 else None for e in exact]
    assert np.allclose(sorted({r["explained"] for r in rows}, reverse=True), values[:16] / values.sum(), rtol=1e-9)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_rank(docs, items, k=10):
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(words(text))
    out = {}
    for item, terms in asked.items():
        found = []
        for d, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms if bag[t])
            if score > 0 and d is not None:
                found.append((-score, d))
        for i, (s, d) in enumerate(sorted(found)[:k]):
            out[item, i + 1] = (d, -s)
    return out


def ranked(df):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}


def test_ranking(spark):
    rng = random.Random(6)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 30, 300])))) for i in range(1500)]
    docs += [(2000 + i, docs[7][1]) for i in range(700)] + [(2000, docs[7][1])] * 2  # copies, and repeated rows
    docs += [(3000, None), (3001, ""), (3002, "-- !"), (None, docs[3][1]), (3003, " ".join(vocabulary * 20)), (3004, "ÉCLAIR éclair W1 x")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(40)]
    items += [(50, docs[7][1]), (51, ""), (52, None), (None, "w1"), (53, "nowhere"), (54, "W1 w1 w2"), (54, "w9"), (55, "Éclair éclair")]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, rank int").repartition(3)
    q = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, score int").repartition(3)
    want = plain_rank(docs, items)
    assert ranked(lexical.rank(d, q)) == want
    assert ranked(lexical.rank(d.withColumn("doc_id", F.col("doc_id").cast("int")), q, block=8)) == want
    assert ranked(lexical.rank(d, q, group_terms=60)) == want
    assert lexical.rank(d, q.limit(0)).count() == 0 and lexical.rank(d.limit(0), q).count() == 0


def test_shards_blocks_and_bounds(spark):
    """Blocks are bounded, summaries bound every member, small shards give the same ranks, most documents stay unopened."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/../sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    asked = next(lexical._question_groups(q, "item_id", "text", 1 << 20))
    counts = lexical.term_counts(d, asked.hashes, "doc_id", "text")
    total = lexical.totals(counts, len(asked.hashes))
    stored = scratch.table(lexical.index(counts.coalesce(1), total, "doc_id", block=16, shard_docs=300), "shards")
    opened, postings = [0], 0
    tops = [lexical._Top(10) for _ in asked.names]
    for row in stored.collect():
        shard = lexical.Shard.unpacked(row["keys"], [bytes(row[f]) for f in shard_fields()])
        sizes = np.diff(shard.block_edges)
        assert len(shard.keys) <= 300 and sizes.max() <= 32 and sizes.min() > 0
        weight = total.weights.copy()
        bounds = shard.bounds(np.arange(len(sizes)), weight)
        for b, (a, z) in enumerate(zip(shard.block_edges[:-1], shard.block_edges[1:])):
            assert shard.scores(shard.members[a:z], weight).max() <= bounds[b]
        held = [set(shard.members[shard.block_edges[a] : shard.block_edges[z]].tolist()) for a, z in zip(shard.list_edges[:-1], shard.list_edges[1:])]
        for t, members in zip(shard.list_terms.tolist(), held):
            assert members == {i for i in range(len(shard.keys)) if t in shard.terms[shard.doc_edges[i] : shard.doc_edges[i + 1]]}
        for terms, top in zip(asked.terms, tops):
            postings += len(set().union(*[held[i] for i in np.flatnonzero(np.isin(shard.list_terms, terms))]))
            lexical._search_shard(shard, terms, total.weights, top, np.zeros(len(total.weights), np.int64), opened)
    got = {(name, i + 1): (key, -s) for name, top in zip(asked.names, tops) for i, (s, key) in enumerate(top.best)}
    assert got == plain_rank(docs, items) == ranked(renamed(lexical.search_shards(stored, asked, total), asked))
    assert opened[0] < postings / 2


def shard_fields():
    return lexical.Shard.FIELDS


def renamed(found, asked):
    from pyspark.sql import Window

    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    best = found.withColumn("rank", F.row_number().over(order)).filter("rank <= 10")
    return best.select(F.element_at(F.lit(asked.names), F.col("q") + 1).alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


@pytest.fixture(scope="module")
def encoder():
    return sequences.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))


def plain_documents(encoder, docs, end=2):
    """Rows in the order of the stream; of equal keys in the order of the texts' hashes, which callers don't compare."""
    out, start = [], 0
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.append(encoder.exact([text or ""])[0], end).astype("<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_encoder_equals_the_library(spark, encoder):
    rng = random.Random(1)
    letters = [*"abAB'st'S.,!?012 \t\n\x1c\x85 ́̈éÉİıßΣς漢字　<|>-_­​\U0001f600ſKᾳ×÷İŉǅŸ̸=≠", "<|endoftext|>", "'re", "'LL", "</w>", "don't", "é,", "Éa.", "'é", "é's"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(5000)] + [None, "", " ", "x" * 300_000]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for got, want in zip(encoder(pa.array(texts)), encoder.exact([t or "" for t in texts])):
        assert np.array_equal(got, want)


def test_sequence_query(spark, encoder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op13_sequences"](spark, SF).collect()
    assert sorted(tuple(r) for r in rows) == plain_documents(encoder, docs)


@pytest.mark.parametrize("length,file_ids", [(16, 100), (7, 1 << 28), (2048, 1 << 28)])
def test_files(spark, encoder, length, file_ids, monkeypatch):
    monkeypatch.setattr(sequences, "BATCH_IDS", 64)
    docs = [(i, " ".join(["word#", "##", str(i)] * (i % 9))) for i in range(0, 300, 3)] + [(None, "no key"), (301, None), (302, ""), (303, "long " * 5000)]
    folder = f"{scratch.shared_dir(spark)}/files-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, start int").repartition(5)
    sequences.write(df, public_tokenizers.path("word_bpe_49k.json"), folder, length=length, file_ids=file_ids)
    got = sorted((tuple(r) for r in sequences.read(spark, folder, "doc_id", df.schema["doc_id"].dataType).collect()), key=lambda r: r[1])
    assert got == plain_documents(encoder, docs)
    stream = np.concatenate([np.append(encoder.exact([t or ""])[0], 2) for _, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))])
    files = sequences.manifest(spark, folder).orderBy("part", "number").collect()
    assert files[-1]["first_id"] + files[-1]["n_ids"] == len(stream)
    for f in files:
        file = sequences.SequenceFile(f"{folder}/{f['file']}.arrow")
        own = stream[f["first_id"] : f["first_id"] + f["n_ids"]]
        assert len(file) == -(-len(own) // length)
        for i in range(len(file)):
            ids, mask = file[i]
            real = own[i * length : (i + 1) * length]
            assert len(ids) == len(mask) == length and ids[: len(real)].tolist() == real.tolist()
            assert mask.to_pylist() == [True] * len(real) + [False] * (length - len(real)) and not ids[len(real) :].any()
        with pytest.raises(IndexError):
            file[len(file)]
        ids, mask = file[0]
        assert not ids.flags.owndata and not ids.flags.writeable  # a view of the mapped file
        assert mask.buffers()[1].address == file[len(file) - 1][1].buffers()[1].address or len(file) > file.rows  # and of one batch


def test_copies_of_one_key_are_spread(spark, encoder):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text")).repartition(4)
    folder = f"{scratch.shared_dir(spark)}/files-{uuid.uuid4().hex}"
    sequences.write(df, public_tokenizers.path("word_bpe_49k.json"), folder)
    rows = sequences.read(spark, folder, "doc_id", df.schema["doc_id"].dataType).orderBy("start").collect()
    n = len(encoder.exact(["same text"])[0]) + 1
    assert [r["start"] for r in rows] == [n * i for i in range(4000)] and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert max(r["n_docs"] for r in sequences.manifest(spark, folder).collect()) < 1500
    empty = f"{scratch.shared_dir(spark)}/files-{uuid.uuid4().hex}"
    sequences.write(df.limit(0), public_tokenizers.path("word_bpe_49k.json"), empty)
    assert sequences.read(spark, empty, "doc_id", df.schema["doc_id"].dataType).count() == 0
