"""Outcomes, failures, intake, usage and index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import stats
from docloom.plans import views
from docloom.plans.registry import query
from docloom.plans.views import LOGS, NORMAS, table

_FAILURES = "failures as (select cast(user_id as bigint) infoleg_id, case when event_id % 3 > 0 then 'e' || cast(json_extract_string(props, '$.k') as int) % 4 end error_type from events where event_type = 'error')"


def _failures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'error'").selectExpr("cast(user_id as bigint) infoleg_id", "case when event_id % 3 > 0 then concat('e', cast(get_json_object(props, '$.k') as int) % 4) end error_type")


@query("a5_failed_ids", f"with {_FAILURES} select distinct infoleg_id from failures order by 1")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return stats.failed_ids(_failures(spark, sf))


@query("a6_failures_by_type", f"with {_FAILURES} select coalesce(error_type, 'unknown') error_type, infoleg_id, count(*) over (partition by coalesce(error_type, 'unknown')) n from failures")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return stats.failures_by_type(_failures(spark, sf))


@query("a7_failure_summary", f"with {_FAILURES} select coalesce(error_type, 'unknown') error_type, count(*) n, (select count(*) from failures) total, (select count(distinct infoleg_id) from failures) unique_ids from failures group by 1")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return stats.failure_summary(_failures(spark, sf))


@query("a8_stage_statistics", f"""with {LOGS} select model stage, count(*) total, count(*) filter ("level" <> 'ERROR') successful, count(*) filter ("level" = 'ERROR') failed, round(count(*) filter ("level" <> 'ERROR') * 100.0 / count(*), 2) success_rate from logs group by 1""")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return stats.outcome_statistics(views.logs(spark, sf).withColumnRenamed("model", "stage"), ["stage"], F.col("level") != "ERROR")


@query(
    "a9_daily_intake",
    """with days as (select cast(unnest(generate_series(date '1998-01-01', date '1998-12-31', interval 1 day)) as date) d),
own as (select cast(o_orderdate as date) d, o_orderkey k, o_orderstatus s from orders)
select days.d as "day", count(k) total, count(*) filter (s = 'O') scraped, count(*) filter (s = 'P') cached, count(*) filter (s = 'F') failed from days left join own on own.d = days.d group by 1""",
)
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return stats.daily_intake(_outcomes(spark, sf), "1998-01-01", "1998-12-31", "day", "status")


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("cast(o_orderdate as date) day", "o_orderkey", "case o_orderstatus when 'O' then 'scraped' when 'P' then 'cached' else 'failed' end status")


@query("a9_failed_ids", """select cast(o_orderdate as date) "day", o_orderkey from orders where o_orderstatus not in ('O', 'P') and cast(o_orderdate as date) between date '1998-01-01' and date '1998-12-31'""")
def a9_failed(spark: SparkSession, sf: str) -> DataFrame:
    return stats.failed_of_day(_outcomes(spark, sf), "1998-01-01", "1998-12-31", "day", "status", "o_orderkey")


@query("a10_index_statistics", f"with {NORMAS} select tipo_norma, count(*) n from normas where tipo_norma is not null group by 1 order by n desc, 1 limit 10")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return stats.index_statistics(views.normas(spark, sf), "tipo_norma")


@query(
    "a10_index_report",
    f"""with {NORMAS}, t as (select 'content_types' section, titulo_sumario "value" from normas union all select 'jurisdictions', jurisdiccion from normas union all select 'document_types', tipo_norma from normas),
counts as (select section, "value", count(*) n from t where "value" is not null group by all)
select section, "value", n from counts qualify row_number() over (partition by section order by n desc, "value") <= 10 union all select 'documents', null, count(*) from normas""",
)
def a10_report(spark: SparkSession, sf: str) -> DataFrame:
    return stats.index_report(views.normas(spark, sf), {"content_types": "titulo_sumario", "jurisdictions": "jurisdiccion", "document_types": "tipo_norma"})


@query("a11_batch_summary", """select event_id // 500 batch, count(*) total, count(*) filter (event_type <> 'error') successful, count(*) filter (event_type = 'error') failed, round(count(*) filter (event_type <> 'error') * 100.0 / count(*), 2) success_rate from events group by 1""")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return stats.outcome_statistics(table(spark, sf, "events").withColumn("batch", F.expr("event_id div 500")), ["batch"], F.col("event_type") != "error")


@query("a12_counts", "select (select count(*) from documents) documents, (select count(*) from embeddings) vectors")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").agg(F.count("*").alias("vectors"))
    return table(spark, sf, "documents").agg(F.count("*").alias("documents")).crossJoin(F.broadcast(vectors))  # one row each


@query(
    "a13_usage",
    """with used as (select user_id, cast(date_trunc('month', ts) as date) "month", sum(cast(floor("value") as bigint)) used from events group by all),
limits as (select distinct user_id, case user_id % 3 when 1 then 500 when 2 then 1000 end lim, case when user_id % 10 = 1 then 'admin' else 'user' end role from events)
select user_id, "month", cast(used as bigint) used, cast(case when lim is not null and role <> 'admin' then greatest(0, lim - used) end as bigint) remaining, lim is null or role = 'admin' or used < lim may_use from used join limits using (user_id)""",
)
def a13(spark: SparkSession, sf: str) -> DataFrame:
    prompts = table(spark, sf, "events").selectExpr("user_id", "ts created_at", "cast(floor(value) as bigint) tokens_used")
    users = prompts.select("user_id").distinct().selectExpr("user_id", "cast(case user_id % 3 when 1 then 500 when 2 then 1000 end as bigint) monthly_token_limit", "case when user_id % 10 = 1 then 'admin' else 'user' end role")
    return stats.usage(prompts, users)


@query("a14_run_summary", """select count(*) total, count(*) filter (event_type <> 'error') successful, count(*) filter (event_type = 'error') failed, round(count(*) filter (event_type <> 'error') * 100.0 / count(*), 2) success_rate, round(avg("value"), 4) avg_seconds from events""")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return stats.run_summary(table(spark, sf, "events"), F.col("event_type") != "error", "value")
