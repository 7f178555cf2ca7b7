"""Corpus profiling: lengths, counts and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T


def with_length(norms: DataFrame) -> DataFrame:
    """infoleg_id, character_count, text_source and character_range of each record."""
    updated, original = F.col("texto_norma_actualizado"), F.col("texto_norma")
    return norms.select(
        "infoleg_id",
        F.length(T.primary_text(updated, original)).cast("long").alias("character_count"),
        T.text_source(updated, original).alias("text_source"),
    ).withColumn("character_range", T.length_bucket(F.col("character_count")))


def length_distribution(norms: DataFrame) -> DataFrame:
    """Count, share in percent, least, most and mean length for each bucket, with the bucket's rank."""
    one = with_length(norms).groupBy("character_range").agg(
        F.count("*").alias("norm_count"),
        F.min("character_count").alias("min_chars"),
        F.max("character_count").alias("max_chars"),
        F.round(F.avg("character_count"), 0).alias("avg_chars"),
    )
    return with_share(one, "norm_count", "percentage").withColumn("bucket_order", T.bucket_rank(F.col("character_range"))).orderBy("bucket_order")


def with_share(counts: DataFrame, n: str, name: str) -> DataFrame:
    """Percent of the grand total, which is one row and joined to the counts."""
    total = counts.agg(F.sum(n).alias("__total"))
    return counts.join(F.broadcast(total)).withColumn(name, F.round(F.col(n).cast("double") * 100 / F.col("__total"), 2)).drop("__total")


def count_by(norms: DataFrame, column: str) -> DataFrame:
    """Count and share for each value, null shown as 'NULL', most frequent first."""
    counts = norms.groupBy(F.coalesce(column, F.lit("NULL")).alias(column)).agg(F.count("*").alias("norm_count"))
    return with_share(counts, "norm_count", "percentage").orderBy(F.desc("norm_count"), column)


def titled(norms: DataFrame, titles: list[str]) -> DataFrame:
    """Ids and titles of the records with one of ``titles``, by id."""
    return norms.filter(F.col("titulo_sumario").isin(titles)).select("infoleg_id", "titulo_sumario").orderBy("infoleg_id")


def size_of(norms: DataFrame, norm_id: int) -> DataFrame:
    """Length and source of one record's text; no text has length 0."""
    one = with_length(norms.filter(F.col("infoleg_id") == norm_id))
    return one.select("infoleg_id", F.coalesce("character_count", F.lit(0)).cast("long").alias("character_count"), "text_source")
