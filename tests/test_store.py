import difflib
import hashlib
import time

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import embed, sampling, search, store, verify
from docloom.streaming import flow


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (4, "z")], "k long, v string")
    once = store.upsert(base, new, "k")
    assert sorted(map(tuple, once.collect()), key=str) == [(1, "a"), (2, "y"), (3, None), (4, "z")]
    assert sorted(map(tuple, store.upsert(once, new, "k").collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_a_keyed_table_is_not_shuffled(spark):
    """Upsert, replacement and delete join with the table in its buckets; only the other side is exchanged."""
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    base, new = store.keyed_table(rows, "k", 16), spark.range(4000, 6000).select(F.col("id").alias("k"), F.lit(-1).cast("long").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out, n in ((store.upsert(base, new, "k"), 6000), (store.replace_children(base, "k", new), 6000), (store.missing(base, new, "k"), 4000)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            branches = plan[: plan.index("Bucketed: true")].splitlines()
            scan = len(branches[-1]) - len(branches[-1].lstrip(" :+-"))
            above = [line for line in branches if "Exchange" in line and len(line) - len(line.lstrip(" :+-")) < scan]
            assert not above and out.count() == n and out.agg(F.sum("v")).first()[0] == (sum(2 * i for i in range(4000)) - 2000 * (n == 6000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quota_never_exceeded(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("s"))
    counts = {r["s"]: r["count"] for r in sampling.by_quota(rows, "s", {"0": 3, "1": 1000, "9": 5}, [F.col("id")]).groupBy("s").count().collect()}
    assert counts == {"0": 3, "1": 72}


def test_scores(spark):
    rows = spark.createDataFrame([(1, "uno dos tres cuatro", "uno dos tres cuatro"), (2, "", ""), (3, "uno dos tres cuatro cinco seis siete ocho", "uno dos tres cuatro"), (4, "uno", None)], "id long, o string, d string")
    got = {r["id"]: r for r in verify.fidelity(rows, ["id"], "o", "d").collect()}
    assert got[1]["score"] == 1.0 and got[2]["jaccard"] == 1.0 and got[4]["score"] == 0.0
    assert abs(got[3]["truncated"] - 0.4) < 1e-12
    decided = verify.decide(spark.createDataFrame([(True, 0.7), (True, 0.69), (False, 0.9)], "v boolean, s double"), "v", "s", 0.3)
    assert [r["is_valid"] for r in decided.collect()] == [True, False, False]


def test_matching_blocks_equal_the_library(spark):
    """Also lists of 200 and more words, where frequent ones begin no block, and nested blocks."""
    rng = np.random.default_rng(12)
    draw = lambda words, n: [f"w{int(x) % words}" for x in rng.pareto(0.8, n) * 2]
    rows = [(i, draw(3, rng.integers(0, 12)), draw(3, rng.integers(0, 12))) for i in range(150)]
    rows += [(200 + i, draw(60, rng.integers(0, 90)), draw(60, rng.integers(0, 90))) for i in range(30)]
    rows += [(300 + i, draw(90, rng.integers(150, 320)), draw(90, rng.integers(190, 320))) for i in range(8)]
    rows += [(400, ["x"] * 250, ["x"] * 240), (401, ["x"] * 250, ["y", *["x"] * 240]), (402, [], []), (403, ["a"], []), (404, ["a"], ["a"])]
    edited = draw(500, 300)
    rows.append((405, edited, [w for w in edited[:120] if w != "w1"] + draw(9, 15) + edited[130:]))
    got = verify.sequence_ratio(spark.createDataFrame(rows, "id long, o array<string>, d array<string>").repartition(3), ["id"], "o", "d").collect()
    want = {i: difflib.SequenceMatcher(None, o, d).ratio() for i, o, d in rows}
    assert {r["id"]: r["ratio"] for r in got} == want


def test_fidelity_of_the_turns(spark):
    """Every turn of the small table as a derivation of the one before it, against the formula in plain Python."""
    from docloom.plans import search as plans

    words = {(r["conv_id"], r["turn"]): (r["o"], r["d"]) for r in plans._words(spark, "/root/testdata/sf0.001").collect()}
    for r in plans.v5(spark, "/root/testdata/sf0.001").collect():
        o, d = words.pop((r["conv_id"], r["turn"]))
        share = len(set(d) - set(o)) / max(len(set(o)), 1)
        kept = len(d) / len(o) if o else 1.0
        jaccard = len(set(o) & set(d)) / len(set(o) | set(d)) if o or d else 1.0
        score = (0.7 * difflib.SequenceMatcher(None, o, d).ratio() + 0.3 * jaccard) * (max(0.4, 1 - 3 * share) if share > 0.05 else 1) * (max(0.3, 1 - 2 * (0.8 - kept)) if kept < 0.8 else 1)
        assert abs(r["score"] - score) < 1e-9
    assert not words


def test_user_functions(spark):
    rows = spark.createDataFrame([("a b",), (" ",), (None,)], "t string")
    assert [r["embedding"] for r in embed.embed(rows, "t", lambda: lambda ts: [[float(len(t))] for t in ts]).collect()] == [[3.0], None, None]
    outcome = embed.correct(rows, "t", lambda: lambda t: t.upper() if t.strip() else 1 / 0, "m").select("attempt.*").collect()
    assert [(r["output"], r["success"]) for r in outcome] == [("A B", True), (None, False), (None, False)]
    assert [r["tree"] for r in embed.structure(rows, "t", lambda: lambda t: "{}").collect()] == ["{}", "{}", None]


def test_hash_embedding(spark):
    rows = [(1, "a b  A\n" * 3), (2, " "), (3, None), (4, "word " * 20000), (4, "word"), (None, "x")]
    got = {r["id"]: r["embedding"] for r in embed.hash_embedding(spark.createDataFrame(rows, "id long, t string"), "id", "t", 8).collect()}
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:15], 16) % 8
    want = [0.0] * 8
    want[slot("a")] += 6
    want[slot("b")] += 3
    assert np.allclose(got[1], np.asarray(want) / np.linalg.norm(want)) and got[2] is None is got[3]
    assert got[4][slot("word")] == 1.0 and sum(got[4]) == 1.0 and got[None][slot("x")] == 1.0


def test_ids(spark):
    hits = spark.createDataFrame([("division", "5"), ("article", "x"), ("summarized_text", "7"), ("other", "8")], "document_type string, document_id string")
    assert [tuple(r) for r in search.parse_hits(hits).collect()] == [("division", 5)]


def test_late_rows_are_dropped(spark, tmp_path):
    base = "2024-01-10 00:00:00"
    late = [("2024-01-03 00:30:00", "s"), ("2024-01-02 23:00:00", "s")]
    for rows in ([(base, "s")], [(base, "s")], late, [("2024-01-30 00:00:00", "s")]):
        spark.createDataFrame(rows, "t string, service string").selectExpr("cast(t as timestamp) ts", "service").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their age; a batch drops what was late before the batch in front of it
    stream = flow.source(spark, str(tmp_path / "in"), "ts timestamp, service string", stage="purifying")
    out = flow.drain(flow.windowed(flow.on_time(stream), "1 hour", "service", {"n": F.count("*")}), "late")
    starts = {str(r["start"]) for r in out.collect()}
    assert "2024-01-03 00:00:00" in starts and "2024-01-02 23:00:00" not in starts
