"""Stand-ins of the operators' inputs on the given tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the documents table."""
    return normas_of(table(spark, sf_dir, "documents"))


def normas_of(docs: DataFrame) -> DataFrame:
    """Records: documents with a type, a title, texts that may be missing, empty or blank, and a date.

    A short title is the first sentence, a summary the first line, both whole.
    """
    return docs.selectExpr(
        "cast(doc_id as bigint) infoleg_id",
        "case when doc_id % 50 = 7 then null else source end tipo_norma",
        "upper(lang) titulo_sumario",
        "case when doc_id % 10 = 9 then null when doc_id % 100 = 3 then '' else text end texto_norma",
        "case when doc_id % 3 = 0 and doc_id % 10 <> 9 then text end texto_norma_actualizado",
        "case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then '   ' else substring_index(text, '\\n', 1) end texto_resumido",
        "substring_index(text, '. ', 1) titulo_resumido",
        "case doc_id % 3 when 0 then 'Nacional' when 1 then 'Provincial' end jurisdiccion",
        "date_add(date'2000-01-01', cast(doc_id % 5000 as int)) publicacion",
    )


NORMAS = """normas as (select cast(doc_id as bigint) infoleg_id,
  case when doc_id % 50 = 7 then null else source end tipo_norma, upper(lang) titulo_sumario,
  case when doc_id % 10 = 9 then null when doc_id % 100 = 3 then '' else text end texto_norma,
  case when doc_id % 3 = 0 and doc_id % 10 <> 9 then text end texto_norma_actualizado,
  case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then '   ' else split_part(text, chr(10), 1) end texto_resumido,
  split_part(text, '. ', 1) titulo_resumido,
  case doc_id % 3 when 0 then 'Nacional' when 1 then 'Provincial' end jurisdiccion,
  date '2000-01-01' + cast(doc_id % 5000 as int) as publicacion
  from documents)"""


def divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node for each line of a document, parents as in a heap."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("norma_id"), F.posexplode(F.split("text", "\n")).alias("p", "body"))
    return lines.selectExpr(
        "norma_id * 10000 + p + 1 id", "norma_id", "case when p = 0 then null else norma_id * 10000 + (p + 1) div 2 end parent_division_id", "p + 1 order_index", "concat('L', p + 1) name", "body"
    )


DIVISIONS = """division_lines as (select cast(doc_id as bigint) norma_id, generate_subscripts(string_split(text, chr(10)), 1) ord, unnest(string_split(text, chr(10))) body from documents where text is not null),
divisions as (select norma_id * 10000 + ord id, norma_id, case when ord = 1 then null else norma_id * 10000 + ord // 2 end parent_division_id, cast(ord as int) order_index, concat('L', ord) "name", body from division_lines)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node for each sentence of a division; every third is a parent of the next two."""
    sentences = divisions(spark, sf_dir).select(F.col("id").alias("division_id"), F.posexplode(F.split("body", "[.] ")).alias("q", "body"))
    return sentences.selectExpr(
        "division_id * 1000 + q + 1 id", "division_id", "case when q % 3 = 0 then null else division_id * 1000 + q + 1 - q % 3 end parent_article_id", "q + 1 order_index", "body"
    )


ARTICLES = (
    DIVISIONS
    + """,
sentences as (select id division_id, generate_subscripts(string_split(body, '. '), 1) ord, unnest(string_split(body, '. ')) body from divisions),
articles as (select division_id * 1000 + ord id, division_id, case when ord % 3 = 1 then null else division_id * 1000 + ord - (ord - 1) % 3 end parent_article_id, cast(ord as int) order_index, body from sentences)"""
)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw directed edges, with repeats."""
    return table(spark, sf_dir, "lineitem").selectExpr("cast(l_partkey as bigint) origin", "cast(l_suppkey as bigint) destination", "'complementa' kind")


RELATIONS = "relations as (select cast(l_partkey as bigint) origin, cast(l_suppkey as bigint) destination, 'complementa' kind from lineitem)"


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference numbers as text, some of them no numbers."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id as bigint) norma_id", "cast(turn as bigint) ord", "case turn % 4 when 0 then cast(turn as string) when 1 then ' 12 ' when 2 then '5 bis' else '' end numero", "role dependencia"
    )


REFERENCES = """refs as (select cast(conv_id as bigint) norma_id, cast(turn as bigint) ord, case turn % 4 when 0 then cast(turn as varchar) when 1 then ' 12 ' when 2 then '5 bis' else '' end numero, role dependencia from conversations)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records of the events table."""
    return logs_of(table(spark, sf_dir, "events"))


def logs_of(events: DataFrame) -> DataFrame:
    """Log records of services; the event time is a timestamp, in the session's time zone."""
    return events.selectExpr(
        "cast(ts as timestamp) ts", "event_type service", "case when event_type = 'error' then 'ERROR' else 'INFO' end level", "cast(user_id as bigint) infoleg_id", "value duration_ms",
        "concat('m', cast(get_json_object(props, '$.k') as int) % 5) model",
    )


LOGS = """logs as (select ts, event_type service, case when event_type = 'error' then 'ERROR' else 'INFO' end "level", cast(user_id as bigint) infoleg_id, "value" duration_ms,
  concat('m', cast(json_extract_string(props, '$.k') as int) % 5) model from events)"""
