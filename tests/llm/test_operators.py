"""The other operators, against brute force, exact round trips or held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, language, lattice, linking, neardup, packing, quality, queries, toxicity
from docloom.llm.words import Words

SF = "/root/testdata/sf0.01"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def test_words():
    texts = ["Hello wörld. x", None, "", "abc", "Abc ABC é" * 3, "a" * 600_000 + " b", "日本 語"]
    read = Words(pa.array(texts))
    for i, t in enumerate(texts):
        assert read.text(read.offsets[i], read.offsets[i + 1]) == " ".join(words(t))


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(3)
    make = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    texts = [None, "", "one two", "one two", "One  TWO!", "...", "a b c d e", "a b c d e"]
    for _ in range(12):
        base = make(rng.randint(20, 120))
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9999)}"
            texts.append(" ".join(copy))
    texts += [" ".join(make(60)) for _ in range(30)] + [texts[20]] * 40
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, None, "c"), (3, "one two", "c")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(5)


def classes(rows):
    sets = []
    for _, text, _ in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [[j for j in range(len(rows)) if j != i and a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j])] for i, a in enumerate(sets)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(keys) if keys else None, len(links[i])))
    return sorted(out, key=str)


def test_near_duplicates(near):
    rows, docs = near
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in neardup.near_duplicates(docs).collect()), key=str) == classes(rows)


def test_keep_one(near):
    rows, docs = near
    kept = sorted((r["doc_id"] for r in neardup.keep_one(docs).collect()), key=str)
    wordless = [k for k, t, _ in rows if not words(t)]
    assert kept == sorted({c for k, c, _ in classes(rows) if k not in wordless} | set(wordless), key=str)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_are_compared_once(spark, near, monkeypatch):
    _, docs = near
    seen = []
    verified = neardup.linking.verified
    monkeypatch.setattr(neardup, "_FILTER_BITS", 32)  # a full filter lets all documents through
    monkeypatch.setattr(neardup.linking, "verified", lambda members, *a, **k: seen.append(members) or verified(members, *a, **k))
    extra = spark.createDataFrame([(20, docs.filter("doc_id = 20").first()["text"], "c")] * 3, docs.schema)
    neardup.near_duplicates(docs.unionByName(extra)).collect()
    counts = seen[0].groupBy("id").count().collect()
    assert counts and all(r["count"] == 1 for r in counts)


def test_large_groups_are_cut(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(150)]
    monkeypatch.setattr(neardup.linking.verified, "__defaults__", (16, True))
    monkeypatch.setattr(neardup.linking.candidate_edges, "__defaults__", (16, 0, (0, 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs).collect()
    assert all(r["class_id"] == 0 and r["n_links"] == 149 for r in got)
    assert [r["doc_id"] for r in neardup.keep_one(docs).collect()] == [0]


def test_forest_alone_finds_pairs_at_the_threshold(spark):
    """Without verification, which would find more by components: separate pairs of a similarity just over 0.8."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        base = [f"{i}w{rng.randint(0, 10**6)}" for _ in range(rng.randint(60, 300))]
        other, cut = list(base), int(len(base) * 0.104)
        other[-cut:] = [f"{i}x{j}" for j in range(cut)]  # 1 - 0.104 of the runs are shared: similarity (1 - c) / (1 + c)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    kept = [p for p in zip(rows[::2], rows[1::2]) if 0.8 <= jaccard(p[0][1], p[1][1]) < 0.85]
    assert len(kept) > 300
    docs = spark.createDataFrame([r for p in kept for r in p], "doc_id long, text string")
    found = neardup._classes(neardup.scratch.table(neardup.sign(docs, "text", "doc_id"), "signed"))
    roots = {r["first"]: r["root"] for r in neardup.candidates(found).join(found, "id").collect()}
    met = sum(a[0] in roots and roots.get(a[0]) == roots.get(b[0]) for a, b in kept)
    assert met >= 0.99 * len(kept)


def jaccard(a, b):
    x, y = (set(zip(*[words(t)[i:] for i in range(5)])) for t in (a, b))
    return len(x & y) / len(x | y)


def test_depths_of_set_sizes():
    for n in range(1, 20):
        possible = [k / (n + m - k) for m in range(1, 30) for k in range(min(n, m) + 1) if k < max(n, m) and 5 * k >= 4 * (n + m - k)]
        assert neardup.least_similarity(n) == (min(possible) if possible else None)
    depth = neardup.depths()
    assert depth[0] == depth[3] == neardup.DEPTH + 1 and depth[7] == 8 and depth[-1] == neardup.prefix_depth(0.8) == 5


def test_trie_node():
    rng = np.random.default_rng(3)
    f = linking._FIELD
    trail = np.sort(np.asarray([(a << 2 * f) | (b << f) | c for a, b, c in rng.integers(0, 3, (60, 3)).tolist()], np.int64))
    x = np.where(rng.random((60, 32)) < 0.5, -1, 1).astype(np.float32)
    rest, size = rng.integers(0, 4, 60), rng.integers(80, 120, 60)
    common = lambda i, j: next((k for k in range(3) if trail[i] >> (2 - k) * f != trail[j] >> (2 - k) * f), 3)
    near = [[j for j in range(60) if j != i and common(i, j) >= max(rest[i], rest[j]) and x[i] @ x[j] >= 6 and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j])] for i in range(60)]
    want = []
    for i in range(60):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        want.append(min(seen))
    root = linking._node(x, trail, rest, size, 6, 3, (4, 5))
    assert [np.flatnonzero(root == r).min() for r in root] == want


def test_lattice(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, x[:20] + rng.normal(0, 0.08, (20, 16)), x[:1] + rng.normal(0, 0.05, (30, 16)), 3 * x[:5], x[5:8], x[5:6] * 1e300]))]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None] * 16), (n + 4, []), (n + 5, [1.0, 0.0]), (n + 6, [2.0, 0.1]), (0, rows[0][1]), (None, rows[1][1])]
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [np.asarray(v) / np.abs(v).max() if g else None for (_, v), g in zip(rows, good)]
    linked = lambda i, j: i != j and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j]) >= 0.95
    links = [[j for j in range(len(rows)) if linked(i, j)] for i in range(len(rows))]
    want = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(keys) if keys else None
        want.append((key, len(links[i]), least, key == least))
    got = lattice.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_e8():
    x = np.random.default_rng(1).normal(0, 2, (300, 8))
    y = lattice.decode_e8(x)
    around = y[:, None] + lattice.ROOTS[None]
    assert len(lattice.ROOTS) == 240 and (((x[:, None] - around) ** 2).sum(2).min(1) >= ((x - y) ** 2).sum(1) - 1e-9).all()


def hit(text, items):
    w, positions, found = words(text), set(), set()
    for key, item in items:
        v = words(item)
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1 if v else 0):
            if tuple(w[i : i + n]) in windows:
                positions.update(range(i, i + n))
                found.add(str(key))
    return len(w), len(positions), sorted(found), bool(positions) and 20 * len(positions) >= len(w)


def test_decontaminate(spark):
    rng = random.Random(2)
    make = lambda n: " ".join(f"w{rng.randint(0, 60)}" for _ in range(n))
    items = [(i, make(rng.randint(14, 40))) for i in range(8)] + [(20, "w1 w2"), (21, ""), (22, None), (23, "Zq"), (24, "w1 w2")]
    docs = [(i, make(rng.randint(0, 30)) + " " + " ".join(items[rng.randrange(8)][1].split()[rng.randint(0, 5) : rng.randint(8, 40)]) + " " + make(rng.randint(0, 200)), 7) for i in range(120)]
    docs += [(200, None, 7), (201, "", 7), (202, "zq", 7), (202, "zq", 7), (None, "w1 W2", 7)]
    out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, n_words int").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in out.collect()), key=str)
    assert got == sorted(((k, *hit(t, items)) for k, t, _ in docs), key=str)
    assert out.filter("contaminated").count() and decontaminate.decontaminate(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_common_windows_have_one_set(spark):
    shared = " ".join(f"c{i}" for i in range(20))
    items = spark.createDataFrame([(i, f"{shared} u{i} " + " ".join(f"v{i}x{j}" for j in range(13))) for i in range(30)], "item_id long, text string")
    windows = decontaminate._windows(items, "item_id", "text", 13)
    sets, spelled = decontaminate._item_sets(windows)
    assert sets.groupBy("s1", "s2").count().agg(F.max("count")).first()[0] >= 8 and spelled.count() == 2 * 30
    out = decontaminate.decontaminate(spark.createDataFrame([(1, f"a b {shared} z")] * 3, "doc_id long, text string"), items).collect()
    assert [(r["n_hit"], len(r["item_ids"])) for r in out] == [(20, 30)] * 3


def test_packing(spark):
    path = queries.tokenizer_path()
    texts = ["a  b", None, "", "é à   b c", "日本 語 x", "“a” — b", "<|endoftext|> x", "it's 's don't  ", "a\0b c", "word " * 5000] + [f"some words of text {i} " * (i % 90) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(3, "again", 5), (None, "k", 5)], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(docs, path).collect()
    encode = packing.Encoder(path)
    want = {i: [*encode.exact([t or ""])[0].tolist(), 1] for i, t in enumerate(texts) if i != 3}
    pieces, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r["token_ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(r["token_ids"]) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in want.items():
        assert [x for _, part, _ in sorted(pieces[i]) for x in part] == ids and {n for _, _, n in pieces[i]} == {len(ids)}
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(own)) and own[-1][0] + own[-1][1] <= 2048
    assert sum(2048 - sum(n for _, n in own) for own in sequences.values()) < 3 * 2048
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_of_added_tokens():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "", "x<|endoftext|><|endoftext|>é", "some <|endof", "text|> more", "a b c"] + [f"text {i} <|endoftext|> " * (i % 3) + "end" for i in range(20)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in packing.Encoder(path)(pa.array(texts))] == want and 50256 in want[0]


def test_balanced_costs():
    lengths = np.random.default_rng(0).integers(1, 2500, 800)
    count = int(lengths.sum()) // 2048
    pieces, left = packing.assign(lengths, 2048, count)
    total = np.bincount([p[3] for p in pieces], [p[2] for p in pieces], minlength=count)
    assert (total == 2048).all() and sum(n for _, _, n in left) == int(lengths.sum()) % 2048


def labelled(spark, name, label, sf=SF):
    return queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("predicted", F.col(label).alias("y")).collect()


def test_quality_held_out(spark):
    rows = labelled(spark, "op3_quality", "quality")
    assert sum(r["predicted"] == r["y"] for r in rows) >= 0.93 * len(rows)


def test_toxicity_held_out(spark):
    rows = labelled(spark, "op6_toxicity", "toxic", "/root/testdata/sf0.1")
    hits = sum(r["predicted"] == r["y"] == 1 for r in rows)
    assert hits >= 0.8 * sum(r["y"] for r in rows) and hits >= 0.8 * sum(r["predicted"] for r in rows)


def sample(spark, texts, labels):
    return spark.createDataFrame([(t, y, i) for i, (t, y) in enumerate(zip(texts, labels))], "text string, y int, order long").repartition(3)


def test_toxic_words(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(1500):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if y := int(i % 8 == 0):
            w[rng.randrange(len(w))] = rng.choice(["bad", "worse", "worst"])
        texts.append(" ".join(w))
        labels.append(y)
    net = toxicity.train(sample(spark, texts[:1000], labels[:1000]))
    rows = spark.createDataFrame(list(zip(texts[1000:], labels[1000:])) + [(None, 0), ("", 0)], "text string, y int")
    got = toxicity.score(rows, net).collect()
    assert sum(r["predicted"] == r["y"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_long_texts_are_learned_from(spark):
    docs = [(i, ("fine words here " if i % 2 else "words and words ") * 4, "s") for i in range(200)]
    docs += [(i, "plain talk " * 100_000 + ("vile" if i % 2 else "nice"), "s") for i in range(200, 206)] + [(0, "again", "s"), (None, "x", "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(206)] + [(None, 1), (7, None)], "doc_id long, y int")
    rows = queries.labelled.sample(spark.createDataFrame(docs, "doc_id long, text string, source string"), labels, "doc_id", "text", "y", 500)
    assert rows.count() == 206 and rows.agg(F.max(F.length("text"))).first()[0] > 1_000_000
    assert queries.labelled.sample(spark.createDataFrame(docs, "doc_id long, text string, source string"), labels, "doc_id", "text", "y", 10).count() == 20
    words = {r["order"]: len(r["tokens"]) // 8 for r in toxicity.encode(rows).collect()}
    assert sorted(words.values())[-6:] == [200_001] * 6
    assert toxicity.score(rows, toxicity.train(rows, epochs=1)).count() == 206 and quality.score(rows, quality.train(rows)).count() == 206


def test_pieces_spread_over_the_text():
    text = bytes(range(256)) * 4000
    found = quality.pieces(text)
    assert len(found) == quality._PIECES and all(p in text for p in found)
    places = [text.index(p) for p in quality.pieces(random.Random(1).randbytes(200_000) and text)]
    assert len(places) == len(found)
    noise = random.Random(1).randbytes(200_000)
    assert max(noise.index(p) for p in quality.pieces(noise)) > 100_000 and b"".join(quality.pieces(noise[:1000])) == noise[:1000]


@pytest.mark.parametrize(("module", "seed"), [(quality, 1), (toxicity, 2)])
def test_scores_of_odd_rows(spark, module, seed):
    model = module.train(sample(spark, [f"good words {i} " * 5 for i in range(40)] + [f"bad terms {i} " * 5 for i in range(40)], [1] * 40 + [0] * 40))
    rows = [(1, "good words", 5, "p"), (1, "good words", 5, "p"), (2, None, None, None), (None, "", 1, "q"), (3, "x" * 2_000_000, 1, "r"), (4, "bad terms " * 100_000, 1, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, predicted string").repartition(2)
    out = module.score(docs, model)
    got = sorted(((r["doc_id"], r["score"], r["predicted"]) for r in out.collect()), key=str)
    assert len(got) == len(rows) and got[0] == got[1] and all(0 <= s <= 1 and p in (0, 1) for _, s, p in got)
    assert sorted(out.columns) == ["doc_id", "predicted", "score"] + ["text"] * ("text" in out.columns)
    assert module.score(docs.limit(0), model).count() == 0


def test_calibration_by_true_shares(spark):
    rows = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)] + [(None, 1), (500, None)], "doc_id long, y int")
    assert queries.labelled.totals(rows, "doc_id", "y") == (180, 20)
    rng = random.Random(5)
    word = lambda y: rng.choice("a b c d e f".split()) if rng.random() < 0.6 else rng.choice(("g h i", "x y z")[y].split())
    make = lambda y: " ".join(word(y) for _ in range(3))
    labels = [i % 2 for i in range(2000)]
    learned = sample(spark, [make(y) for y in labels], labels)
    fresh = pa.array([make(int(i % 10 == 0)) for i in range(2000)])  # a tenth has label 1, half of the sample
    assert toxicity.scores(toxicity.train(learned, (1800, 200)), fresh).mean() < toxicity.scores(toxicity.train(learned), fresh).mean()
    assert toxicity._threshold(np.asarray([3.0, 2, 1, 0] * 20), np.asarray([1, 0, 1, 0] * 20), 0.1) == 2.5
    model = quality.train(learned, (1800, 200))
    x = quality.features(quality._Sizes(model.good, model.bad)([t.encode() for t in fresh.to_pylist()]))
    assert abs((1 / (1 + np.exp(-x @ model.weights))).mean() - 0.1) < 0.04


@pytest.mark.parametrize("labels", [[], [1], [0, 0, 0]])
def test_learning_from_one_label(spark, labels):
    texts = ["some text here"] * len(labels)
    rows = spark.createDataFrame([("a",), (None,)], "text string")
    assert quality.score(rows, quality.train(sample(spark, texts, labels))).count() == 2
    assert toxicity.score(rows, toxicity.train(sample(spark, texts, labels))).count() == 2


@pytest.mark.parametrize("few", [8, 1])
def test_viterbi(monkeypatch, few):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(language, "_BLOCK", 4)
    monkeypatch.setattr(language, "_FEW", few)
    for _ in range(200):
        k, sizes = rng.integers(2, 4), rng.integers(0, 8, 3)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        scores = np.round(rng.normal(0, 2, (offsets[-1], k)), rng.integers(0, 3))
        labels = language.viterbi(scores, offsets, 1.5)
        for a, z in itertools.pairwise(offsets):
            value = lambda path: sum(scores[a + i, x] for i, x in enumerate(path)) - 1.5 * sum(x != y for x, y in itertools.pairwise(path))  # noqa: E731, B023
            assert abs(value(labels[a:z]) - max(map(value, itertools.product(range(k), repeat=int(z - a))))) < 1e-9 if z > a else True


def test_language_spans(spark):
    known = spark.createDataFrame([("the cat sat on the mat and the dog " * 9, "en"), ("el gato come en la casa y el perro " * 9, "es"), ("кот и собака в доме " * 9, "ru")], "text string, lang string")
    model = language.train(known, least=2)
    rows = spark.createDataFrame([(1, "the dog sat on the mat. el perro come en la casa"), (2, "12 ... !"), (3, None), (4, "собака"), (5, "the cat")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.detect(rows, model).collect()}
    assert [(s["lang"], s["start"]) for s in got[1]["spans"]] == [("en", 0), ("es", 24)]
    assert (got[2]["lang_pred"], got[3]["lang_pred"], got[2]["score"]) == ("und", "und", 0.0)
    assert (got[4]["lang_pred"], got[5]["lang_pred"]) == ("ru", "en")
    nothing = language.train(known.limit(0))
    assert {r["lang_pred"] for r in language.detect(rows, nothing).collect()} == {"und"}


def test_many_languages(spark):
    rng = random.Random(6)
    names = [f"l{i:03d}" for i in range(200)]
    own = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for _ in names]
    known = spark.createDataFrame([(" ".join(w * 3), n) for n, w in zip(names, own)], "text string, lang string")
    model = language.train(known, least=2)
    assert model.names == names
    rows = spark.createDataFrame([(i, " ".join(w[:6]), "a", 1.0, "b") for i, w in enumerate(own)] + [(0, " ".join(own[0][:6]), "a", 1.0, "b"), (None, " ".join(own[5] * 20_000), "a", 1.0, "b")], "doc_id long, text string, lang_pred string, score double, spans string").repartition(2)
    got = [(r["doc_id"], r["lang_pred"]) for r in language.detect(rows, model, spans=False).collect()]
    assert sorted(got, key=str) == sorted([*enumerate(names), (0, "l000"), (None, "l005")], key=str)
    assert language.detect(rows.limit(0), model).count() == 0


def test_language_held_out(spark):
    rows = queries.QUERIES["op8_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def test_queries_have_digests(spark):
    row = queries.QUERIES["op1_pii"](spark, "/root/testdata/sf0.001").filter("spans = ''").first()
    assert row["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_thresholds_are_drawn_to_the_common_one():
    """Few rows of a group move its threshold little, many rows all the way, and nothing jumps between."""
    z = np.linspace(-4, 4, 81)
    common = (z >= 1).astype(float)
    at = []
    for n in (0, 1, 4, 19, 20, 21, 100, 10000):
        own = n * (z >= 3)
        at.append(toxicity._best(np.concatenate([z, z]), np.concatenate([common, own]), np.concatenate([1 - common, n - own])))
    assert at[0] == pytest.approx(0.95) and at[-1] == pytest.approx(2.95) and at == sorted(at)
    assert toxicity._best(z, 0 * z, 1 + 0 * z) == 0 and toxicity._best(z[:0], z[:0], z[:0]) == 0


def test_columns_of_any_name(spark):
    """Dots, keywords, nested and non-null columns pass through every operator that reads texts by Arrow."""
    rows = [(i, "the quick brown fox %d" % (i // 2), 1.5, {"x.y": [1, None]}, "s") for i in range(6)] + [(6, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` double, `c d` map<string, array<int>>, `select` string").withColumn("fixed", F.lit(1))
    net = toxicity.train(sample(spark, ["x y", "z"] * 20, [0, 1] * 20))
    good = quality.train(sample(spark, ["x y", "z"] * 20, [0, 1] * 20))
    model = language.train(spark.createDataFrame([("x y z", "l")], "text string, lang string"), least=1)
    items = spark.createDataFrame([("i", "brown fox 1")], "item_id string, text string")
    outs = [quality.score(docs, good), toxicity.score(docs, net), language.detect(docs, model), decontaminate.decontaminate(docs, items), neardup.keep_one(docs)]
    own = ["doc_id", "a.b", "c d", "select", "fixed"]
    want = {r[0]: r for r in ((*(r[c] for c in own),) for r in docs.collect())}
    for out in outs:
        got = out.select(*[F.col(f"`{c}`") for c in own]).collect()
        assert got and all(tuple(r) == want[r["doc_id"]] for r in got)
        assert {c: t for c, t in out.dtypes if c in own} == {c: t for c, t in docs.dtypes if c in own}
    assert "text" not in decontaminate.decontaminate(docs, items, keep_text=False).columns
    keyed = packing.pack(docs.withColumnRenamed("doc_id", "x.id"), queries.tokenizer_path(), key="x.id")
    assert {r["x.id"] for r in keyed.collect()} == set(want)


def test_dictionaries_of_few_bytes():
    for parts in ([], [b""] * 20, [b"z"] * 10, [b"x"] * 20, [b"x y"] * 7, [b"a b c"] * 100):
        assert quality._Sizes(quality._dictionary(parts), b"other words")([b"x y", b""]).shape == (2, 3)
