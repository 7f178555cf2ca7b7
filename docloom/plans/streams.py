"""Streams drained to the end, sources and sinks written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.plans import views
from docloom.plans.registry import query
from docloom.plans.views import LOGS, NORMAS, table
from docloom.sources import pages, records, shared
from docloom.streaming import flow


def _stream(spark: SparkSession, sf: str, name: str, stage: str | None = None) -> DataFrame:
    schema = table(spark, sf, name).schema
    return flow.source(spark, f"{sf}/{name}.parquet*", schema, stage=stage)  # a pattern, since the table may be one file


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    return flow.on_time(views.logs_of(_stream(spark, sf, "events")))


_START = "time_bucket(interval '{0}', ts)"


@query("t7_volume", f"""with {LOGS} select {_START.format('1 minute')} start, service, count(*) n from logs group by all""")
def t7(spark: SparkSession, sf: str) -> DataFrame:
    return flow.drain(flow.windowed(_logs(spark, sf), "1 minute", "service", {"n": F.count("*")}), "volume", "complete")


@query("t8_errors", f"""with {LOGS} select time_bucket(interval '1 minute', ts) - to_minutes(i) start, service, count(*) n from logs, (select unnest(range(0, 5)) i) where "level" = 'ERROR' group by all""")
def t8(spark: SparkSession, sf: str) -> DataFrame:
    return flow.drain(flow.windowed(_logs(spark, sf), "5 minutes", "service", {"n": F.count("*")}, "1 minute", F.col("level") == "ERROR"), "errors", "complete")


@query("t9_duration", f"with {LOGS} select {_START.format('1 minute')} start, service, round(avg(duration_ms), 6) avg_ms from logs where service = 'purchase' group by all")
def t9(spark: SparkSession, sf: str) -> DataFrame:
    return flow.drain(flow.windowed(_logs(spark, sf), "1 minute", "service", {"avg_ms": F.round(F.avg("duration_ms"), 6)}, only=F.col("service") == "purchase"), "duration", "complete")


@query("t10_models", f"with {LOGS} select time_bucket(interval '1 minute', ts) - to_minutes(i) start, model, count(*) n from logs, (select unnest(range(0, 5)) i) where service = 'view' group by all")
def t10(spark: SparkSession, sf: str) -> DataFrame:
    return flow.drain(flow.windowed(_logs(spark, sf), "5 minutes", "model", {"n": F.count("*")}, "1 minute", F.col("service") == "view"), "models", "complete")


@query("t11_timeline", f"""with {LOGS} select ts, infoleg_id, '[' || service || '] ' || "level" || ': ' || infoleg_id line from logs where "level" = 'ERROR'""")
def t11(spark: SparkSession, sf: str) -> DataFrame:
    return flow.drain(flow.timeline(_logs(spark, sf), F.col("level") == "ERROR").select("ts", "infoleg_id", "line"), "timeline")


@query("t12_on_time", f"with {LOGS} select {_START.format('1 hour')} start, service, count(*) n from logs group by all")
def t12(spark: SparkSession, sf: str) -> DataFrame:
    return flow.drain(flow.windowed(_logs(spark, sf), "1 hour", "service", {"n": F.count("*")}), "on-time", "complete")


_SPACE = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


@query("t1_stage", f"with {NORMAS} select infoleg_id, case when length(trim(texto_norma_actualizado, {_SPACE})) > 10 then 'updated_text' when length(trim(texto_norma, {_SPACE})) > 10 then 'original_text' when length(trim(texto_resumido, {_SPACE})) > 10 then 'summary_only' else 'no_valid_text' end primary_field from normas")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    route = T.route(F.col("texto_norma_actualizado"), F.col("texto_norma"), F.col("texto_resumido"))
    stage = lambda s: views.normas_of(s).select("infoleg_id", route.alias("primary_field"))
    return flow.run_stage(_stream(spark, sf, "documents", "purifying"), stage, "stage")


@query("t3_malformed", "select doc_id, doc_id % 10 <> 0 ok from documents")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    json = F.to_json(F.struct("doc_id", "lang"))
    raw = _stream(spark, sf, "documents").select(F.when(F.col("doc_id") % 10 == 0, F.expr("substr(to_json(struct(doc_id, lang)), 1, length(to_json(struct(doc_id, lang))) - 1)")).otherwise(json).alias("value"))
    good, bad = flow.parse_messages(raw, "doc_id bigint,lang string")
    fixed = bad.select(F.regexp_extract("value", r'"doc_id":(\d+)', 1).cast("long").alias("doc_id"), F.lit(False).alias("ok"))
    return flow.drain(good.select("doc_id", F.lit(True).alias("ok")).unionByName(fixed), "malformed")


@query("t4_dead_letters", "select user_id, count(*) receives from events where event_type = 'error' group by 1 having count(*) >= 3")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    return flow.drain(flow.dead_counts(_stream(spark, sf, "events").filter("event_type = 'error'"), "user_id"), "dead", "complete")


@query("t2_batches", "select doc_id, length(text) size from documents")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    """The inserting stage: ten files a batch, ten seconds apart."""
    stage = lambda rows: rows.select("doc_id", F.length("text").cast("long").alias("size"))
    return flow.consume(_stream(spark, sf, "documents", "inserting"), stage, "inserting", shared.new_path(spark, "batches"))[0]


@query("t5_upsert", """select user_id, max(event_id) event_id, arg_max("value", event_id) "value" from events group by 1""")
def t5(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf, "events", "inserting").select("user_id", "event_id", "value")
    return flow.upsert_stream(rows, "user_id", shared.new_path(spark, "keyed"), "event_id")


_STAGE_OF = {"view": "processing", "click": "message_sent", "error": "api_error", "purchase": "insertion"}


@query("t13_vocabulary", f"""select event_id, coalesce(stage in ({', '.join(f"'{s}'" for s in flow.STAGES)}), false) is_known from (select event_id, case event_type {' '.join(f"when '{k}' then '{v}'" for k, v in _STAGE_OF.items())} else 'data_transformation' end stage from events)""")
def t13(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.expr("case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _STAGE_OF.items()) + " else 'data_transformation' end")
    return flow.drain(flow.vocabulary(_stream(spark, sf, "events").withColumn("stage", stage)).select("event_id", "is_known"), "vocabulary")


@query("t6_replay", "select doc_id, case when l.doc_id is not null then 'replayed' else 'not_in_cache' end status, quality, case when l.doc_id is not null then true end from_cache from documents d left join labels l using (doc_id)")
def t6(spark: SparkSession, sf: str) -> DataFrame:
    cache = lambda: table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("from_cache"))
    answers = flow.replay(_stream(spark, sf, "documents"), cache, "doc_id", shared.new_path(spark, "replay"))
    return answers.select("doc_id", "status", "quality", "from_cache")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    norms = views.normas(spark, sf)
    have = set(norms.columns)
    absent = [F.expr(f"cast(null as {kind})").alias(name) for name, kind in (f.split(" ", 1) for f in records.NORM.split(", ")) if name not in have]
    return norms.select("*", *absent)


def _as_text(records_: DataFrame) -> DataFrame:
    """Records whose lists are JSON text, as a store may hand them out."""
    numbers = F.concat(F.lit('[{"numero":"'), F.col("infoleg_id").cast("string"), F.lit('","dependencia":"x","rama_digesto":null}]'))
    return records_.withColumn("id_normas", numbers).withColumn("lista_normas_que_complementa", F.concat(F.lit("["), F.col("infoleg_id").cast("string"), F.lit(",7]")))


@query("s1_read_cache", f"with {NORMAS} select infoleg_id, tipo_norma, publicacion::varchar publicacion, md5(texto_norma) body from normas")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    path = shared.new_path(spark, "cache")
    records.wrap(_records(spark, sf), "2024-01-01T00:00:00").write.json(path)
    good, _ = records.read_cached(spark, path)
    return good.select("infoleg_id", "tipo_norma", "publicacion", F.md5("texto_norma").alias("body"))


@query("s3_export", f"with {NORMAS} select infoleg_id, coalesce(texto_norma <> '', false) has_full_text, publicacion::varchar publicacion, md5(texto_norma) body, 'migrator://postgres/' || infoleg_id api_url, infoleg_id::varchar numero, infoleg_id + 7 complements from normas")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = records.wrap(_as_text(_records(spark, sf)), "2024-01-01T00:00:00").select("data.scraping_data.*")
    record, about = "infoleg_response", "scraper_metadata"
    complements = F.aggregate(f"{record}.lista_normas_que_complementa", F.lit(0).cast("long"), lambda a, x: a + x)
    return wrapped.select(f"{record}.infoleg_id", f"{about}.has_full_text", f"{record}.publicacion", F.md5(f"{record}.texto_norma").alias("body"), f"{about}.api_url", F.col(f"{record}.id_normas")[0]["numero"].alias("numero"), complements.alias("complements"))


@query("s5_payload", f"with {NORMAS} select infoleg_id, tipo_norma, titulo_sumario, case when infoleg_id % 2 = 0 then publicacion end publicacion, case when infoleg_id % 3 = 0 then 0 else infoleg_id end complements from normas")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    day = F.when(F.col("infoleg_id") % 2 == 0, F.date_format("publicacion", "yyyy-MM-dd")).otherwise(F.date_format("publicacion", "dd/MM/yyyy"))
    payload = F.to_json(F.struct(F.col("infoleg_id").alias("id"), F.col("tipo_norma").alias("tipoNorma"), F.col("titulo_sumario").alias("tituloSumario"), day.alias("publicacion"), F.when(F.col("infoleg_id") % 3 != 0, F.array("infoleg_id")).alias("listaNormasQueComplementa")))
    rows = records.from_payload(views.normas(spark, sf).select(payload.alias("json")))
    return rows.select("infoleg_id", "tipo_norma", "titulo_sumario", "publicacion", F.coalesce(F.try_element_at("lista_normas_que_complementa", F.lit(1)), F.lit(0)).alias("complements"))


_PAGES = "numbered as (select o_orderkey k, cast(o_orderdate as date) d, row_number() over (partition by cast(o_orderdate as date) order by o_orderkey) - 1 i from orders)"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys of each day, three to a page; every fifth page has not landed."""
    days = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    cut = days.select("day", F.size("k").cast("long").alias("count"), F.lit(3).cast("long").alias("limit"), "k", F.explode(F.expr("sequence(1, cast(ceil(size(k) / 3) as int))")).alias("page"))
    return cut.select("day", F.col("page").cast("long").alias("page"), "count", "limit", F.expr("transform(slice(k, (page - 1) * 3 + 1, 3), x -> named_struct('id', x))").alias("results")).filter("page % 5 <> 0")


@query("s6_page_ids", f"""with {_PAGES} select d as "day", k infoleg_id from numbered where (i // 3 + 1) % 5 <> 0 and k <> 0""")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    return records.page_ids(_pages(spark, sf))


@query("s6_missing_pages", f"""with {_PAGES}, pages as (select d, i // 3 + 1 page, count(*) over (partition by d) n from numbered) select distinct d as "day", page from pages p where page % 5 = 0""")
def s6_missing(spark: SparkSession, sf: str) -> DataFrame:
    return records.missing_pages(_pages(spark, sf))


@query("s6_page_source", """with months as (select date_trunc('month', cast(o_orderdate as date)) d, o_orderkey k, row_number() over (partition by date_trunc('month', cast(o_orderdate as date)) order by o_orderkey) - 1 i from orders)
select cast(d as date) as "day", i // 100 + 1 page, count(*) n, cast(sum(k) as bigint) total from months where (i // 100 + 1) % 5 <> 0 group by all""")
def s6_source(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys of each month, a hundred to a page and a thousand pages to a file, landed; every fifth page is missing."""
    path = shared.new_path(spark, "landed")
    pages.register(spark)
    place = F.row_number().over(Window.partitionBy("day").orderBy("o_orderkey")) - 1
    keys = table(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("day"), "o_orderkey").withColumn("number", F.floor(place / 100) + 1).filter("number % 5 <> 0")
    answers = keys.groupBy("day", "number").agg(F.lit(100).alias("limit"), F.collect_list(F.struct(F.col("o_orderkey").alias("id"))).alias("results"))  # a page's keys
    first = F.floor((F.col("number") - 1) / 1000) * 1000 + 1
    lines = answers.select("day", first.alias("page"), F.to_json(F.struct(F.col("number").alias("page"), "limit", "results")).alias("value"))
    lines.repartition("day", "page").write.partitionBy("day", "page").text(path)
    landed = spark.read.format(pages.NAME).load(path).select("day", "page", F.explode("results.id").alias("id"))
    return landed.groupBy("day", "page").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query("s7_dump", "select cast(vec_id as varchar) vec_id, cast(label as varchar) label, len(embedding) dims, round(list_sum(cast(embedding as double[])), 6) total, round(list_sum(list_transform(cast(embedding as double[]), lambda x, i: x * i)), 6) placed from embeddings")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    docs, path = table(spark, sf, "embeddings"), shared.new_path(spark, "dump")
    records.dump(docs, path, "csv")
    back = spark.read.schema("vec_id string, embedding string, label string").option("header", True).option("escape", '"').csv(path).withColumn("e", F.from_json("embedding", "array<float>"))
    total = lambda values: F.round(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), 6)
    return back.select("vec_id", "label", F.size("e").cast("long").alias("dims"), total(F.transform("e", lambda x: x.cast("double"))).alias("total"), total(F.transform("e", lambda x, i: x.cast("double") * (i + 1))).alias("placed"))


@query("s8_reimport", "select cast(vec_id as varchar) _id, label, len(embedding) dims from embeddings")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    docs, path = table(spark, sf, "embeddings"), shared.new_path(spark, "dump")
    records.dump(docs.select(F.col("vec_id").cast("string").alias("_id"), F.lit("docs").alias("_index"), "embedding", "label"), path, "ndjson")
    return records.read_dump(spark, path, "embedding array<float>, label int").select("_id", "label", F.size("embedding").cast("long").alias("dims"))


@query("s9_failure_log", "select doc_id, substr(text, 1, 1000) as input from documents")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    path = shared.new_path(spark, "failures")
    failed = table(spark, sf, "documents").select("doc_id", F.col("text").alias("input"))
    records.log_failures(failed.filter("doc_id % 2 = 0"), path)
    records.log_failures(failed.filter("doc_id % 2 = 1"), path)
    return spark.read.schema("doc_id bigint, input string").json(path)


@query("s10_articles", "select cast(item_id as varchar) article_number, md5(text) body from benchmark")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    path = shared.new_path(spark, "articles")
    one = F.struct(F.col("item_id").cast("string").alias("article_number"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))
    lists = table(spark, sf, "benchmark").groupBy(F.expr("item_id div 50").alias("g")).agg(F.to_json(F.collect_list(one)).alias("value"))  # 50 articles a file
    lists.write.partitionBy("g").text(path)
    return records.read_articles(spark, path).select("article_number", F.md5("body").alias("body"))


@query("p18_flat_norm", f"with {NORMAS} select infoleg_id, tipo_norma, md5(coalesce(texto_norma_actualizado, texto_norma)) structured, infoleg_id % 7 tokens_used from normas")
def p18(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = records.wrap(_records(spark, sf), "2024-01-01").select("data.scraping_data")
    r = "scraping_data.infoleg_response"
    trees = F.map_from_entries(F.array(F.struct(F.lit("original_text"), F.struct(F.col(f"{r}.texto_norma").alias("structured_data"))), F.struct(F.lit("updated_text"), F.struct(F.col(f"{r}.texto_norma_actualizado").alias("structured_data")))))
    done = F.struct(
        F.create_map(F.lit("original_text"), F.col(f"{r}.texto_norma")).alias("purifications"), trees.alias("parsings"), F.struct(F.lit("m").alias("model_used"), (F.col(f"{r}.infoleg_id") % 7).alias("tokens_used")).alias("processor_metadata"),
        F.lit(None).cast("struct<embedding_model_used:string>").alias("embedder_metadata"),
    )
    flat = records.flat_norm(wrapped.withColumn("processing_data", done))
    return flat.select("infoleg_id", "tipo_norma", F.md5("structured").alias("structured"), "tokens_used")
