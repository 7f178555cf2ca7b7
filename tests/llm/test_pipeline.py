"""The pipeline's stages against brute force on the small documents."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import classes, hit

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if number == 0:
            good, bad = ({r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter(f"quality = {q}").collect()} for q in (1, 0))
            assert len(bad & after) <= 0.2 * len(bad) and len(good & after) >= 0.98 * len(good)
        elif number == 1:
            found = classes([(k, r["text"], None) for k, r in before.items()])
            assert after == {c for _, c, _ in found}
        elif number == 2:
            assert after == {k for k, r in before.items() if not hit(r["text"], items)[3]}
        elif number == 3:
            assert after == before.keys()
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert not any(re.search(r"[0-9a-f]{24}|AKIA[A-Z0-9]{16}", t or "") for t in texts.values())
            assert all(texts[k] == r["text"] for k, r in before.items() if not re.search(r"[0-9a-f]{24}|AKIA|[A-Za-z0-9+/_-]{20}|(?i:password|passwd|secret|token|api_?key)", r["text"] or ""))
        else:
            assert after == before.keys() and docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_keep_foreign_columns(spark):
    """Columns with names that operators use, or with a dot, come back unchanged; odd rows and empty tables pass."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2).withColumn("text", F.lit(""))).unionByName(docs.limit(1)).unionByName(docs.limit(1).withColumn("source", F.lit(None).cast("string")))
    names = ["score", "predicted", "n_words", "n_hit", "n_items", "item_ids", "contaminated", "spans", "class_id", "__before", "__t", "a.b"]
    wide = docs.unionByName(odd)
    for i, name in enumerate(names):
        wide = wide.withColumn(name, F.lit(-float(i)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, small)
        assert out.columns == wide.columns and [f.dataType for f in out.schema] == [f.dataType for f in wide.schema]
        rows = out.select(*[F.col(f"`{n}`") for n in names]).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(-float(i) for i in range(len(names)))]
        assert stage(spark, wide.limit(0), small).count() == 0
