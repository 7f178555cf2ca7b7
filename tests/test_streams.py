"""Streams fed in several runs."""

from pyspark.sql import functions as F

from docloom.sources import records, shared
from docloom.streaming import flow

SCHEMA = "user_id long, event_id long, value double"


def test_upserts_resume_and_compact(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    (tmp_path / "in").mkdir()
    run = lambda: flow.upsert_stream(flow.source(spark, source, SCHEMA, stage="embedding"), "user_id", path, "event_id", compact=3)
    assert run().count() == 0
    want = {}
    for i in range(5):
        rows = [(u, 100 * i + u, float(i)) for u in range(i, i + 3)] + [(u, -1, 9.0) for u in range(2)]  # late rows change nothing
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        for u, e, v in rows:
            want[u] = max(want.get(u, (-2, 0)), (e, v))
        assert {r["user_id"]: (r["event_id"], r["value"]) for r in run().collect()} == want
    base, batches = flow._versions(spark, path)
    assert base is not None and len(batches) < 3
    assert {r["user_id"]: (r["event_id"], r["value"]) for r in run().collect()} == want


def test_late_logs_are_dropped(spark, tmp_path):
    day = lambda d: F.expr(f"timestamp'2024-01-01' + interval {d} days")
    for i, days in enumerate([[30], [31], [1, 32]]):
        spark.range(1).select(F.explode(F.array(*[day(d) for d in days])).alias("ts"), F.lit("s").alias("service")).coalesce(1).write.mode("append").parquet(str(tmp_path / "logs"))
    logs = flow.on_time(spark.readStream.schema("ts timestamp, service string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "logs")))
    out = flow.drain(flow.windowed(logs, "1 hour", "service", {"n": F.count("*")}), "late", "append")
    assert out.filter("start < timestamp'2024-01-20'").count() == 0


def test_nested_fields_leave(spark):
    df = spark.sql("select 1 id, array(1.0) embedding, named_struct('embedding', 2, 'a', array(named_struct('embedding', 3, 'embeddings', 4)), 'm', map('k', named_struct('x', 5, 'embedding', 6))) n, cast(null as struct<embedding:int,y:int>) e")
    out = records.without_field(df)
    assert out.schema.simpleString() == "struct<id:int,n:struct<a:array<struct<embeddings:int>>,m:map<string,struct<x:int>>>,e:struct<y:int>>" and out.first()["e"] is None


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    try:
        shared.shared_dir(Session)
    except ValueError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError("no error")


def messages(spark, folder, rows, schema):
    """A file for each message."""
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)


def attempts(spark, folder, rows):
    """A file for each receive (id, day)."""
    for name, day in rows:
        spark.sql("select 1").select(F.lit(name).cast("string").alias("id"), F.expr(f"timestamp'2024-01-01' + interval {day} days").alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def test_third_receive_is_dead_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    dead = lambda: sorted(map(tuple, flow.drain(flow.dead_letters(flow.source(spark, source, "id string, ts timestamp", stage="embedding"), "id"), "dead", path=path).collect()), key=repr)
    attempts(spark, source, [("a", 1), ("b", 1), ("a", 1)])
    assert dead() == []
    attempts(spark, source, [("a", 2), ("c", 1)])
    assert dead() == [("a", 3)]
    attempts(spark, source, [("a", 2), ("a", 3), ("b", 2)])
    assert dead() == [("a", 3)]  # restarted, no second time
    attempts(spark, source, [("d", 3)] * 5 + [(None, 3)] * 3)
    assert dead() == [("a", 3), ("d", 3), (None, 3)]
    attempts(spark, source, [("a", 40), ("x", 41)])
    dead()
    attempts(spark, source, [("b", 42), ("x", 43)])  # b's receives of the first days are forgotten
    assert dead() == [("a", 3), ("d", 3), (None, 3)]


def test_dead_letters_with_all_receives(spark, tmp_path):
    from docloom.plans.all import QUERIES

    rows = [("error", 1)] * 5 + [("error", 2)] * 3 + [("error", 3)] * 2 + [("view", 3)] * 9
    spark.createDataFrame([(k, u, "2024-01-01 00:00:00") for k, u in rows], "event_type string, user_id long, ts string").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(map(tuple, QUERIES["t4_dead_letters"](spark, str(tmp_path)).collect())) == [(1, 5), (2, 3)]


def test_replay_sees_the_cache_of_its_time(spark, tmp_path):
    source, cache, path = (str(tmp_path / n) for n in ("in", "cache", "out"))
    read = lambda: spark.read.schema("id long, body string").parquet(cache)
    run = lambda: {(r["id"], r["status"], r["body"]) for r in flow.replay(flow.source(spark, source, "id long"), read, "id", path).collect()}
    spark.createDataFrame([(1, "one")], "id long, body string").write.parquet(cache)
    messages(spark, source, [(1,), (2,), (2,)], "id long")
    first = {(1, "replayed", "one"), (2, "not_in_cache", None)}
    assert run() == first
    spark.createDataFrame([(2, "two")], "id long, body string").write.mode("append").parquet(cache)
    assert run() == first  # no new request
    messages(spark, source, [(2,)], "id long")
    assert run() == first | {(2, "replayed", "two")}


def test_batches_of_a_stage(spark, tmp_path):
    import time

    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    messages(spark, source, [(i,) for i in range(12)], "id long")
    parts = []

    def stage(rows):
        if not rows.isStreaming:
            parts.append(rows.rdd.getNumPartitions())
        return rows.withColumn("twice", F.col("id") * 2)

    start = time.time()
    out, taken = flow.consume(flow.source(spark, source, "id long", stage="embedding"), stage, "embedding", path)
    assert taken == [5, 5, 2] and time.time() - start >= 5 and max(parts) <= 20
    assert sorted(r["twice"] for r in out.collect()) == [2 * i for i in range(12)]
    messages(spark, source, [(99,)], "id long")
    out, taken = flow.consume(flow.source(spark, source, "id long", stage="embedding"), stage, "embedding", path)
    assert taken == [1] and out.count() == 13


def test_complete_results_resume(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    counts = lambda: {r["id"]: r["n"] for r in flow.drain(flow.source(spark, source, "id long").groupBy("id").agg(F.count("*").alias("n")), "n", "complete", path).collect()}
    messages(spark, source, [(1,), (2,)], "id long")
    assert counts() == {1: 1, 2: 1} == counts()
    messages(spark, source, [(1,)], "id long")
    assert counts() == {1: 2, 2: 1}


def test_landed_pages(spark, tmp_path):
    """A page a partition; a stream reads each page once, in order of day and number; gaps are named."""
    import json

    from docloom.sources import pages

    pages.register(spark)
    folder = tmp_path / "pages"

    def land(day, page, body):
        (folder / f"day={day}/page={page}").mkdir(parents=True)
        (folder / f"day={day}/page={page}/x.json").write_text(body if isinstance(body, str) else json.dumps(body))

    load = lambda: spark.read.format("landed_pages").load(f"file://{folder}")
    assert load().count() == 0
    land("2024-01-01", 1, {"count": 5, "limit": 2, "results": [{"id": 1}, {"id": 2}]})
    land("2024-01-01", 3, {"count": 5, "limit": 2, "results": [{"id": 5}, {"id": None}, {"id": 0}]})
    land("2024-01-02", 1, "no json")
    assert load().rdd.getNumPartitions() == 3
    assert sorted(r["infoleg_id"] for r in records.page_ids(load()).collect()) == [1, 2, 5]
    assert [(str(r["day"]), r["page"]) for r in records.missing_pages(load()).collect()] == [("2024-01-01", 2)]

    def run():
        stream = spark.readStream.format("landed_pages").load(f"file://{folder}")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((str(r["day"]), r["page"], r["count"]) for r in spark.read.schema(pages.SCHEMA).parquet(str(tmp_path / "out")).collect())

    first = [("2024-01-01", 1, 5), ("2024-01-01", 3, 5), ("2024-01-02", 1, None)]
    assert run() == first
    land("2024-01-02", 2, {"count": 3, "limit": 2, "results": []})
    assert run() == [*first, ("2024-01-02", 2, 3)] == run()


def test_many_landed_pages_share_files_and_partitions(spark, tmp_path, monkeypatch):
    import json

    from docloom.sources import pages

    pages.register(spark)
    folder = tmp_path / "pages"
    for first in (1, 1001):
        (folder / f"day=2024-01-01/page={first}").mkdir(parents=True)
        (folder / f"day=2024-01-01/page={first}/x.txt").write_text("\n".join(json.dumps({"page": p, "limit": 1, "results": [{"id": p}]}) for p in range(first, first + 3)))
    landed = spark.read.format("landed_pages").load(f"file://{folder}")
    assert sorted((r["page"], r["results"][0]["id"]) for r in landed.collect()) == [(p, p) for p in (1, 2, 3, 1001, 1002, 1003)]
    assert landed.rdd.getNumPartitions() == 2
    monkeypatch.setattr(pages, "PARTS", 4)
    parts = pages._parts([pages.Page("2024-01-01", i, str(i)) for i in range(10)])
    assert [len(p.pages) for p in parts] == [3, 3, 3, 1] and pages._parts([]) == []
