import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import ann, keywords, search


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(3).normal(size=(900, 32))
    x[10] = x[20] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [])]
    return x, spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)


def exact(x, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit[queries] @ unit.T, 12)
    return {q: sorted(range(len(x)), key=lambda j, s=s: (-s[j], j))[:k] for q, s in zip(queries, score)}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 2000])
def test_batch_top_k(vectors, block_bytes):
    x, docs = vectors
    queries = docs.filter("id % 60 = 0 or id > 899").select(F.col("id").alias("query_id"), "embedding")
    assert found(search.batch_top_k(docs, queries, 7, block_bytes=block_bytes)) == exact(x, range(0, 900, 60), 7)
    assert search.batch_top_k(docs, queries.limit(0)).count() == 0 and search.batch_top_k(docs.limit(0), queries).count() == 0


def test_keys_of_text(spark):
    docs = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    queries = docs.filter("id = 'c'").select(F.col("id").alias("query_id"), "embedding")
    assert found(search.batch_top_k(docs, queries, 2)) == {"c": ["c", "a"]}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_approximate_search(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = docs.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    best, near = found(search.batch_top_k(docs, queries)), found(ann.approximate_top_k(docs, queries))
    assert np.mean([len(set(best[q]) & set(near[q])) / len(best[q]) for q in best]) >= 0.9


def test_few_rows_of_grouped_vectors_are_visited(spark, tmp_path):
    """Of vectors with groups, under a tenth are visited at all, fewer are scored, and the recall is kept."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(100, 32))
    x = search._unit(centres[rng.integers(0, 100, 6000)] + 0.35 * rng.normal(size=(6000, 32)))
    docs = spark.createDataFrame(pa.table({"id": np.arange(6000), "embedding": list(x)}))
    path = str(tmp_path / "index")
    ann.build(docs, path)
    model = ann._model(path)
    asked = np.arange(0, 6000, 100)
    prober = ann.Prober(model, x[asked], 10, model.probes)
    lists = model.list_of(x)
    codes = model.codes(x, lists)
    for n in range(len(model.centroids)):
        at = np.flatnonzero(lists == n)
        prober.add(n, at.tolist(), codes[at], x[at])
    true = np.argsort(-np.round(x[asked] @ x.T, 12), axis=1, kind="stable")[:, :10]
    recall = np.mean([len({k for _, k in prober.best[q]} & set(true[q].tolist())) / 10 for q in range(len(asked))])
    assert recall >= 0.9 and prober.visited <= len(asked) * len(x) / 10 and prober.scored <= prober.visited
    queries = docs.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = found(ann.top_k(spark, path, queries))
    assert np.mean([len(set(got[q]) & set(t.tolist())) / 10 for q, t in zip(asked.tolist(), true)]) >= 0.9


def test_stored_index(vectors, spark, tmp_path):
    x, docs = vectors
    ann.build(docs, str(tmp_path / "index"))
    queries = docs.filter("id < 5 or id > 899").select(F.col("id").alias("query_id"), "embedding")
    got = ann.top_k(spark, str(tmp_path / "index"), queries, k=3, probes=10**6)
    assert {q: ids[0] for q, ids in found(got).items()} == {q: q for q in range(5)}
    assert found(got)[0] == [0, 10, 20]  # ties by key
    assert found(ann.top_k(spark, str(tmp_path / "index"), queries, k=3, probes=10**6, block_bytes=300)) == found(got)
    one = ann.top_k(spark, str(tmp_path / "index"), queries.filter("query_id = 1"), probes=1)
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString() and found(one)[1][0] == 1
    assert ann.approximate_top_k(docs.limit(0), queries).count() == 0 == ann.approximate_top_k(docs, queries.limit(0)).count()


def test_keyword_search(spark):
    rows = [(1, "alpha beta", None), (2, "alpah", "gamma gamma"), (3, "", "beta"), (4, None, None), (5, "alphas in gamma", "")]
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    plain = keywords.keyword_search(docs, ["alpha"], {"title": 3.0, "body": 1.0}, fuzzy=False).collect()
    fuzzy = keywords.keyword_search(docs, ["alpha"], {"title": 3.0, "body": 1.0}).collect()
    assert [r["id"] for r in plain] == [1] and {r["id"] for r in fuzzy} == {1, 5} and fuzzy[0]["id"] == 1  # a swap is two edits
    assert keywords.keyword_search(docs, ["zzzzzz"], {"title": 3.0}).count() == 0 == keywords.keyword_search(docs, ["in"], {"body": 1.0}).count()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_terms_by_deletions(spark):
    rng = np.random.default_rng(8)
    vocabulary = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 12))) for _ in range(1500)})
    words = ["".join(rng.choice(list("abé"), n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12) for _ in range(3)]
    want = {(w, t, edits(w, t)) for w in words for t in vocabulary if edits(w, t) <= keywords.allowed_edits(w)}
    got = keywords.expand_fuzzy(spark.createDataFrame([(t,) for t in vocabulary * 2], "term string"), words)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "Inner" in plan and "key" in plan


def test_stored_keyword_index(spark, tmp_path):
    """Small blocks: the same scores as one block, though most are never opened; a question reads its terms' folders."""
    rng = np.random.default_rng(9)
    vocabulary = [f"word{int(x)}" for x in rng.pareto(0.6, 3000) % 500]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60))), "word7" if i % 50 == 0 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "id long, title string, body string").repartition(4)
    index = keywords.build_index(docs, str(tmp_path / "index"), {"title": 3.0, "body": 1.0})
    plain = keywords.search(index, ["word7", "word31", "zzz"], 10, fuzzy=False).collect()
    bags = [(i, [keywords_of(t), keywords_of(b)]) for i, t, b in rows]
    for field in (0, 1):
        sizes = [len(f[field]) for _, f in bags if f[field]]
        df = {w: sum(w in f[field] for _, f in bags) for w in ("word7", "word31")}
        for _, f in bags:
            f.append([bm25(w, f[field], sizes, df) for w in ("word7", "word31")])
    best = sorted(((-round(max(3 * sum(f[2]), sum(f[3])), 6), i) for i, f in bags))[:10]
    assert [(-r["score"], r["id"]) for r in plain] == best
    assert [(-r["score"], r["id"]) for r in keywords.search(index, ["word7", "word31", "zzz"], 10, fuzzy=False, direct=0).collect()] == best
    plan = index.postings(["word7", "word31"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert keywords.search(index, ["nothing"], fuzzy=True).count() == 0


def keywords_of(text):
    return (text or "").split()


def bm25(word, bag, sizes, df):
    tf, mean = bag.count(word), sum(sizes) / len(sizes)
    return np.log(1 + (len(sizes) - df[word] + 0.5) / (df[word] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean)) if tf else 0.0


def test_keyword_index_shuffles_no_texts(spark, tmp_path):
    """Of documents with keys of their own only the keys and the vocabulary are shuffled, and every document is one read."""
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words, 300)), "") for i in range(3000)]
    docs = spark.createDataFrame(pa.table({"id": [r[0] for r in rows], "title": [r[1] for r in rows], "body": [r[2] for r in rows]})).repartition(4)
    docs.write.parquet(str(tmp_path / "docs"))
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(list_of.apply, range(list_of.size()))}
    list_of = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    before = stages()
    index = keywords.build_index(spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "index"), {"title": 3.0, "body": 1.0})
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    list_of = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    shuffled = sum(n for stage, n in stages().items() if stage not in before)
    assert 0 < shuffled < sum(len(r[1]) for r in rows) / 20
    assert index.terms.count() == 400 and index.fields.count() == 1


def test_keyword_search_of_repeated_ids(spark, tmp_path):
    """Ids of several rows, and none, as in SQL: rows of one length add their counts, others their scores."""
    import duckdb

    from docloom.plans.all import ORACLE_SQL, QUERIES

    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("casa", "perro", "árbol", "niña") for b in ("", "s", "ita", "zo", "dor")]
    texts = [". ".join(" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(3)) for _ in range(60)] + ["", None, "¿¡?!"]
    ids = [*range(50), None, None, *[4] * 4, *[12] * 3, 24, 36, 36, 60]
    docs = [(i, texts[n % 63], "s", "es") for n, i in enumerate(ids)] + [(4, texts[4], "s", "es"), (24, texts[24], "s", "es"), (None, texts[50], "s", "es")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "Casas, PERRITO y árbol dor"), (2, "x")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.sql(f"select id, score from ({ORACLE_SQL['k6_keyword']})").fetchall()
    got = [(r["id"], r["score"]) for r in QUERIES["k6_keyword"](spark, str(tmp_path)).collect()]
    assert [i for i, _ in got] == [i for i, _ in want] and len({4, 12, 24, 36, None} & {i for i, _ in want}) > 2
    assert np.allclose([s for _, s in got], [s for _, s in want], rtol=0, atol=2e-6)
    named = spark.read.parquet(str(tmp_path / "documents.parquet")).select(F.col("doc_id").alias("id"), F.col("text").alias("doc"), F.col("source").alias("again"))
    index = keywords.build_index(named, str(tmp_path / "index"), {"doc": 2.0, "again": 1.0}, block=8)
    asked = lambda **more: keywords.search(index, ["casita", "niños"], 7, **more).collect()
    assert asked() == asked(direct=0) and len(asked()) == 7


def test_words_of_many_texts(spark):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("aZ09éÉÑßÿÃ¡ ·\t\n\x00-_中😀ſK"), rng.integers(0, 12))) for _ in range(2000)] + [None, "", " ", "é", "Ã", "a\u00a0b"]
    rows = spark.createDataFrame(pa.table({"n": range(len(texts)), "text": texts})).coalesce(1)
    rows = rows.select("n", F.lower("text").alias("low"), keywords.terms(F.col("text")).alias("t")).orderBy("n").toArrow()
    low = rows.column("low").combine_chunks()
    for part in (low, low.slice(7, 900)):
        at = 0 if part is low else 7
        lens, found = keywords._terms_of(part)
        want = rows.column("t").to_pylist()[at : at + len(part)]
        assert lens.tolist() == [len(t) for t in want] and found.to_pylist() == [w for t in want for w in t]


def test_keyword_index_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, ""), (2, "?", None)], "id long, title string, body string")
    for n, rows in enumerate((docs, docs.limit(0), docs.unionAll(docs))):
        index = keywords.build_index(rows, str(tmp_path / str(n)), {"title": 3.0, "body": 1.0})
        assert keywords.search(index, ["alpha"]).count() == 0 == keywords.search(index, ["alpha"], fuzzy=False).count()


def test_question_without_hits(spark):
    index = spark.createDataFrame([(1, "7", [1.0, 0.0], "x"), (2, "no", [1.0, 0.1], "x"), (3, "8", [0.0, 1.0], "y")], "id long, source_id string, embedding array<double>, kind string")
    norms = spark.createDataFrame([(7, "Ley", "t", "s", "Nacional", "r"), (8, None, None, "s", None, None)], "infoleg_id long, tipo_norma string, titulo_resumido string, titulo_sumario string, jurisdiccion string, texto_resumido string")
    articles = spark.createDataFrame([(7, [("1", "body")])], "infoleg_id long, articles array<struct<ordinal:string,body:string>>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = {r["query_id"]: r for r in search.question_context(asked, index, norms, articles, 2, {"kind": "x"}).collect()}
    assert got[1]["norma_ids"] == [7] and "Artículo 1: body" in got[1]["context"] and got[1]["message"].endswith("with 1 normas")
    assert all(got[q]["norma_ids"] == [] and got[q]["answer"] == search.NO_HITS for q in (2, 3))


def test_scores_are_made_in_tiles(spark):
    names, vectors = np.arange(1300), np.random.default_rng(1).normal(size=(1300, 4))
    rows = spark.range(5000).select("id", F.array(*[(F.col("id") * i % 7).cast("double") for i in range(1, 5)]).alias("v")).repartition(1)

    def compare(q, x):
        if len(q) > search._QUERIES or len(x) > search._ROWS:
            raise ValueError("a larger tile")
        return q @ x.T

    found = search._nearest(rows, (names, vectors), 3, "id", "query_id", "long", compare, search._matrix)[0]
    assert found.groupBy("query_id").count().filter("count = 3").count() == 1300


def test_blocks_of_an_index_search_fit_what_is_held(spark, tmp_path, monkeypatch):
    docs = spark.range(600).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.hash("id", i) % 1000).cast("float")).alias("embedding"))
    queries, path, blocks = docs.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), str(tmp_path / "index"), []
    ann.build(docs, path)
    found = lambda: sorted(map(tuple, ann.top_k(spark, path, queries).collect()))
    whole, asked = found(), search._query_blocks
    monkeypatch.setattr(search, "_query_blocks", lambda *a: (blocks.append(b) or b for b in asked(*a)))
    monkeypatch.setattr(ann, "HELD", 4 * ann._model(path).rescored * 10 * 8)
    assert found() == whole and len(blocks) > 1
