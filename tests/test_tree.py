import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import heap, relations, segment, tree

text = st.text("abc \"\\é\n", max_size=6)
articles = st.recursive(st.just([]), lambda kids: st.lists(st.fixed_dictionaries({"ordinal": text, "body": text, "articles": kids}), max_size=2), max_leaves=4)
divisions = st.recursive(
    st.just([]), lambda kids: st.lists(st.fixed_dictionaries({"name": text, "ordinal": text, "title": st.none() | text, "body": text, "articles": articles, "divisions": kids}), min_size=1, max_size=2), max_leaves=4
)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(divisions.filter(bool), min_size=1, max_size=4))
def test_flatten_and_rebuild(spark, docs):
    rows = spark.createDataFrame([(i, json.dumps({"divisions": d}, ensure_ascii=False)) for i, d in enumerate(docs)], "norm_id long, tree string")
    rebuilt = {r["norm_id"]: json.loads(r["tree"]) for r in tree.rebuild(tree.flatten(rows, "norm_id", "tree")).collect()}
    assert rebuilt == {i: {"divisions": d} for i, d in enumerate(docs)}


def node(**kind):
    return {"name": "n", "ordinal": "1", "title": None, "body": "b", "articles": [], "divisions": []} | kind


def test_order_and_text(spark):
    doc = {"divisions": [node(body=f" b{i} ", articles=[{"ordinal": "1", "body": f"a{i}", "articles": []}], divisions=[node(body=f"s{i}")]) for i in range(12)]}
    rows = spark.createDataFrame([(1, json.dumps(doc))], "norm_id long, tree string")
    nodes = tree.flatten(rows, "norm_id", "tree")
    assert tree.document_text(nodes).first()["text"] == " ".join(f"b{i} a{i} s{i}" for i in range(12))
    assert [r["path"] for r in tree.subtree(nodes, 1, "d1").collect()] == ["d1", "d1_a1", "d1_d1"]


@pytest.mark.parametrize(
    ("doc", "path", "error"),
    [
        ("{", "", "not JSON"),
        ('{"divisions": 3}', "", "divisions must be a list"),
        (json.dumps({"divisions": [node(divisions=[node(articles=[{"ordinal": "1", "articles": []}])])]}), "d1_d1_a1", "missing body"),
        (json.dumps({"divisions": [node(), node(body=7)]}), "d2", "body must be a string"),
        (json.dumps({"divisions": [node(articles="x")]}), "d1", "articles must be a list"),
    ],
)
def test_structure_errors(spark, doc, path, error):
    rows = spark.createDataFrame([(1, doc), (2, '{"divisions": []}')], "norm_id long, tree string")
    assert [tuple(r) for r in tree.structure_errors(rows, "norm_id", "tree").collect()] == [(1, path, error)]


def test_search_documents(spark):
    e = [1.0]
    doc = {"divisions": [node(divisions=[node() | {"embedding": e}], articles=[{"ordinal": "1", "body": "b", "articles": [{"ordinal": "1", "body": "c", "articles": [], "embedding": e}]}])]}
    nodes = tree.flatten(spark.createDataFrame([(1, json.dumps(doc))], "norm_id long, tree string"), "norm_id", "tree")
    meta = spark.createDataFrame([(1, "t")], "norm_id long, titulo string")
    summaries = spark.createDataFrame([(1, e)], "norm_id long, embedding array<double>")
    assert {r["path"] for r in tree.search_documents(nodes, meta, summaries).collect()} == {"d1_d1", None}


def test_orphans_leave(spark):
    rows = spark.createDataFrame([(1, json.dumps({"divisions": [node(divisions=[node(body="lost")])]}))], "norm_id long, tree string")
    nodes = tree.flatten(rows, "norm_id", "tree").withColumn("parent_path", F.when(F.col("path") == "d1_d1", "d9").otherwise(F.col("parent_path")))
    assert "lost" not in tree.rebuild(nodes).first()["tree"]


def test_segment(spark):
    raw = "Visto\nCONSIDERANDO:\nQue sí.\nArtículo 1°.- Apruébase:\na) primero\n1) uno\n2) dos\nsigue\nb) segundo\nArt. 2 - Fin.\nAntecedentes Normativos\n- Viejo"
    rows = spark.createDataFrame([(1, raw), (2, "Título I\nCapítulo 1\nArt. 1. x\nTítulo II\nSección 1\nArt. 2. y"), (3, None)], "norm_id long, text string")
    got = {(r["norm_id"], r["path"]): r["body"] for r in segment.segment(rows).collect()}
    assert got[1, "d3_a1"] == "Apruébase:" and got[1, "d3_a1_a1_a2"] == "dos\nsigue" and got[1, "d3_a1_a2"] == "segundo" and got[1, "d4_a1"] == "Viejo"
    assert got[2, "d1_d1_a1"] == "x" and got[2, "d2_d1_a1"] == "y" and not any(n == 3 for n, _ in got)


def test_deep_trees(spark):
    deep = node(body="b20")
    for i in range(19, 0, -1):
        deep = node(body=f"b{i}", divisions=[deep])
    broken = json.loads(json.dumps({"divisions": [deep]}).replace('"body": "b20"', '"body": 5'))
    rows = spark.createDataFrame([(1, json.dumps({"divisions": [deep]}))], "norm_id long, tree string")
    nodes = tree.flatten(rows, "norm_id", "tree")
    assert nodes.count() == 20 and json.loads(tree.rebuild(nodes).first()["tree"]) == {"divisions": [deep]}
    errors = tree.structure_errors(spark.createDataFrame([(1, json.dumps(broken)), (2, json.dumps({"divisions": [deep]}))], "norm_id long, tree string"), "norm_id", "tree").collect()
    assert [(r["norm_id"], r["path"].count("_"), r["error"]) for r in errors] == [(1, 19, "body must be a string")]


def test_nodes_of_a_stated_depth_are_not_written(spark, monkeypatch):
    made, table = [], tree.shared.table
    monkeypatch.setattr(tree.shared, "table", lambda df, label: made.append(label) or table(df, label))
    deep = lambda n: '{"body":"%d","articles":[%s]}' % (n, deep(n - 1) if n > 1 else "")
    docs = spark.createDataFrame([(1, '{"divisions":[%s]}' % deep(2)), (2, "no JSON"), (3, None)], "id long, tree string")
    assert [r["path"] for r in tree.flatten(docs, "id", "tree", 2).orderBy("sort_path").collect()] == ["d1", "d1_a1"] and not made
    longer = spark.createDataFrame([(1, '{"divisions":[%s]}' % deep(11))], "id long, tree string")
    assert sorted(r["depth"] for r in tree.flatten(longer, "id", "tree").collect()) == list(range(1, 12))
    try:
        tree.counts(tree.flatten(longer, "id", "tree", 10)).collect()
    except Exception as error:
        assert "deeper than 10 levels" in str(error)
    else:
        raise AssertionError("no error")


def test_descendants(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, None), (5, 4), (6, 99), (7, 8), (8, 7)]
    nodes = spark.createDataFrame(rows, "id long, parent long")
    found = lambda roots: sorted(map(tuple, heap.descendants(nodes, roots, "parent").collect()))
    assert found(2) == [(2, 2, 0), (2, 3, 1)] and found(42) == []
    assert found(nodes.filter("id in (1, 4, 7)")) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (4, 4, 0), (4, 5, 1), (7, 7, 0), (7, 8, 1)]


def test_descendants_of_repeated_ids(spark):
    """As in SQL: a node is below each node of its parent's id, and only the rows without a parent are roots."""
    nodes = spark.createDataFrame([(1, None), (2, 1), (2, None), (3, 2), (3, 2), (4, 3)], "id long, parent long")
    found = sorted(map(tuple, heap.descendants(nodes, nodes.filter("parent is null"), "parent").collect()))
    assert found == sorted([(1, 1, 0), (1, 2, 1), (2, 2, 0)] + [(1, 3, 2), (2, 3, 1)] * 2 + [(1, 4, 3), (2, 4, 2)] * 2)


def test_article_subtree_of_long_lines(spark, tmp_path):
    """More than 999 sentences in a line repeat ids of the next line's sentences."""
    import duckdb

    from docloom.plans.all import ORACLE_SQL, QUERIES

    text = ". ".join(f"s{i}" for i in range(2100)) + "\n" + ". ".join(f"t{i}" for i in range(1005)) + "\na. b. c"
    spark.createDataFrame([(1, text), (2, "a. b. c. d")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["h7_article_subtree"](spark, str(tmp_path)).select("root", "id", "depth")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(f"select root, id, depth from ({ORACLE_SQL['h7_article_subtree']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 2147


def _walk(rows, roots):
    """(root, id, depth) by walking down from each root, which ends where it comes back to it."""
    below = {}
    for i, p in rows:
        below.setdefault(p, []).append(i)
    out = []
    for root in roots:
        level, depth = [root], 0
        while level:
            out += [(root, i, depth) for i in level]
            level, depth = [c for i in level for c in below.get(i, []) if c != root], depth + 1
    return sorted(out)


def test_descendants_of_any_nodes(spark, monkeypatch):
    rng, made = random.Random(4), []
    table = heap.shared.table
    monkeypatch.setattr(heap.shared, "table", lambda df, label: made.append(label) or table(df, label))
    chain = [(i, i - 1 if i else None) for i in range(300)]
    forest = [(i, rng.choice([None, 9999, *range(max(0, i - 9), i)])) for i in range(200)]
    circles = [(i, (i // 10) * 10 + (i + 1) % 10) for i in range(40)] + [(40 + i, rng.randrange(40 + i)) for i in range(30)] + [(90, 90)]
    for rows, roots in ((chain, [0, 150]), (forest, [i for i, p in forest if p is None]), (forest, list(range(0, 200, 7))), (circles, [0, 3, 12, 45, 90]), (circles, [])):
        made.clear()
        nodes = spark.createDataFrame(rows, "id long, parent long").repartition(3)
        found = heap.descendants(nodes, spark.createDataFrame([(i,) for i in roots] * 2 + [(-5,)], "id long"), "parent")
        assert sorted(map(tuple, found.collect())) == _walk(rows, roots)
        assert len(made) <= 11  # rounds grow with the logarithm of the depth


def test_context_batch(spark):
    """Ids for each hit by rank, bodies once for each node; unknown types and ids, and nodes of no record, are left out."""
    norms = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "infoleg_id long, title string")
    divs = spark.createDataFrame([(10, 1, "L1", "d10"), (11, 1, "L2", None), (20, 2, "L1", "d20"), (20, 3, "L1", "again"), (90, 9, "L1", "lost")], "id long, norma_id long, name string, body string")
    arts = spark.createDataFrame([(100, 10, 1, "a100"), (101, 11, 2, "a101"), (102, 77, 1, "lost")], "id long, division_id long, order_index int, body string")
    hits = [("division", 11, 7), ("division", 10, 3), ("division", 11, 1), ("division", 11, 7), ("division", 20, 4), ("division", 10, None), ("division", 90, 0), ("article", 101, 9), ("article", 100, 2)]
    pairs = spark.createDataFrame(hits + [("article", 102, 0), ("article", 555, 0), ("division", None, 0), ("summarized_text", 10, 0)], "entity_type string, entity_id long, hit_rank int")
    got = {r["infoleg_id"]: r for r in relations.context_batch(pairs, norms, divs, arts, ["title"]).collect()}
    assert set(got) == {1, 2, 3} and [got[i]["first_rank"] for i in (1, 2, 3)] == [1, 4, 4] and got[1]["title"] == "one"
    assert got[1]["division_ids"] == [10, 11, 10, 11, 11] and got[1]["article_ids"] == [100, 101]
    assert [tuple(x) for x in got[1]["divisions"]] == [(11, "L2", None), (10, "L1", "d10")] and [tuple(x) for x in got[1]["articles"]] == [(100, "1", "a100"), (101, "2", "a101")]
    assert [x["body"] for i in (2, 3) for x in got[i]["divisions"]] == ["d20", "again"] and got[2]["article_ids"] == [] == got[3]["articles"]


def test_context_batch_of_many_hits(spark, tmp_path):
    """A long line that is hit often: its text is neither repeated for its hits nor shuffled for a query of ids."""
    import duckdb

    from docloom.plans.all import ORACLE_SQL, QUERIES

    path = lambda name: str(tmp_path / f"{name}.parquet")
    text = F.concat(F.repeat(F.lit("xyz "), 250_000), F.lit(". b\nc. d"))
    spark.range(4).select(F.col("id").alias("doc_id"), F.lit("es").alias("lang"), F.lit("s").alias("source"), text.alias("text")).coalesce(1).write.parquet(path("documents"))
    spark.range(9000).selectExpr("id event_id", "case when id < 8997 then 1 else id % 6 end user_id").coalesce(1).write.parquet(path("events"))
    found = QUERIES["j3_context_batch"](spark, str(tmp_path))
    db = duckdb.connect()
    for name in ("documents", "events"):
        db.execute(f"create view {name} as select * from '{path(name)}/*.parquet'")
    want = db.sql(f"select {', '.join(found.columns)} from ({ORACLE_SQL['j3_context_batch']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and max(len(r[3]) for r in want) > 3000 * 5
