"""Outcomes, failures, intake and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failed_ids(failures: DataFrame) -> DataFrame:
    """Distinct ids that failed, sorted."""
    return failures.filter("infoleg_id is not null").select("infoleg_id").distinct().orderBy("infoleg_id")


def failures_by_type(failures: DataFrame) -> DataFrame:
    """Each failure with its type and the type's number of failures; a missing type is 'unknown'.

    Failures stay rows, since one type may have most of them; the counts are a row for each type.
    """
    typed = failures.withColumn("error_type", F.coalesce("error_type", F.lit("unknown")))
    return typed.join(count_by_type(failures), "error_type")


def count_by_type(failures: DataFrame) -> DataFrame:
    """Number of failures of each type."""
    return failures.groupBy(F.coalesce("error_type", F.lit("unknown")).alias("error_type")).agg(F.count("*").alias("n"))


def failure_summary(failures: DataFrame) -> DataFrame:
    """Total and distinct failed ids, with the count of each type beside them."""
    total = failures.agg(F.count("*").alias("total"), F.countDistinct("infoleg_id").alias("unique_ids"))
    return count_by_type(failures).crossJoin(F.broadcast(total))  # total is one row


def outcome_statistics(outcomes: DataFrame, group: list[str], ok: Column) -> DataFrame:
    """Total, successes, failures and success rate in percent of each group."""
    agg = [F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed")]
    rows = outcomes.groupBy(*group).agg(*agg)
    return rows.withColumn("success_rate", F.round(F.try_divide(F.col("successful") * 100.0, F.col("total")), 2))


def daily_intake(outcomes: DataFrame, start: str, end: str, day: str, status: str) -> DataFrame:
    """For each day of the range: total, scraped, cached and failed; days without outcome are zeros."""
    calendar = outcomes.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(day))
    own = outcomes.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    of = lambda s: F.count_if(F.col(status) == s)
    rows = own.groupBy(day).agg(F.count("*").alias("total"), of("scraped").alias("scraped"), of("cached").alias("cached"), of("failed").alias("failed"))
    out = calendar.join(rows, day, "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "scraped", "cached", "failed")}
    return out.withColumns(zero)


def failed_of_day(outcomes: DataFrame, start: str, end: str, day: str, status: str, key: str) -> DataFrame:
    """The ids that failed on each day of the range, a row each."""
    return outcomes.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col(status) == "failed")).select(day, key)


def usage(prompts: DataFrame, users: DataFrame) -> DataFrame:
    """For each user and month: tokens used, what remains of the limit (null if unlimited), whether more may be used."""
    used = prompts.groupBy("user_id", F.trunc("created_at", "month").alias("month")).agg(F.sum("tokens_used").alias("used"))
    rows = used.join(users, "user_id")
    free = F.col("monthly_token_limit").isNull() | (F.col("role") == "admin")
    remaining = F.when(~free, F.greatest(F.lit(0).cast("long"), F.col("monthly_token_limit") - F.col("used")))
    return rows.select("user_id", "month", "used", remaining.alias("remaining"), (free | (F.col("used") < F.col("monthly_token_limit"))).alias("may_use"))


def index_report(docs: DataFrame, terms: dict[str, str], most: int = 10) -> DataFrame:
    """(section, value, n): the number of documents, and the ``most`` frequent values of each column in ``terms`` (section -> column).

    All sections come from one pass: rows are counted once for each section's value before anything is shuffled.
    """
    sections = F.array(F.struct(F.lit("documents").alias("section"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(s).alias("section"), F.col(c).cast("string").alias("value")) for s, c in terms.items()])
    counts = docs.select(F.explode(sections).alias("t")).select("t.*").filter((F.col("section") == "documents") | F.col("value").isNotNull()).groupBy("section", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def index_statistics(docs: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The ``most`` frequent values of a column with their counts."""
    return docs.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def run_summary(outcomes: DataFrame, ok: Column, seconds: str) -> DataFrame:
    """Total, successes, failures, rate and mean seconds of a run."""
    return outcomes.agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.round(F.try_divide(F.count_if(ok) * 100.0, F.count("*")), 2).alias("success_rate"), F.round(F.avg(seconds), 4).alias("avg_seconds"))
