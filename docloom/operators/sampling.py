"""Samples by quota, listings, and rows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows to take from each length bucket, and from each type of record.
LENGTH_QUOTAS = {
    "No text": 5, "Empty (0 chars)": 1, "1-499 chars": 1, "500-999 chars": 2, "1K-2K chars": 2, "2K-3K chars": 2, "3K-5K chars": 5, "5K-7.5K chars": 10, "7.5K-10K chars": 5,
    "10K-15K chars": 3, "15K-20K chars": 2, "20K-30K chars": 2, "30K-50K chars": 1, "50K-75K chars": 1, "75K-100K chars": 1, "100K-150K chars": 1, "150K-200K chars": 1, "200K+ chars": 1,
}
TYPE_QUOTAS = {"Resolución": 5, "Decreto": 2} | dict.fromkeys(
    ["Disposición", "Decisión Administrativa", "Comunicación", "Decreto/Ley", "Nota Externa", "Decisión", "Directiva", "Instrucción", "Acordada", "Circular", "Nota", "Acta", "Recomendación", "Laudo", "Convenio", "Acuerdo", "Providencia", "Protocolo", "Actuacion", "Interpretación"],
    1,
)


def by_quota(rows: DataFrame, stratum: str, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """The first rows of each stratum in ``order``, as many as its quota; strata without quota are left out.

    Spark keeps only the leading rows of each stratum before the shuffle, up to the largest quota.
    """
    table = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).filter(F.col("rn") <= max(quotas.values()))
    return ranked.filter(F.col("rn") <= F.try_element_at(table, F.col(stratum))).drop("rn")


def shuffled(key: Column, seed: str) -> Column:
    """A random but repeatable order."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def listing(rows: DataFrame, filters: dict[str, object], order: str, limit: int, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows that equal all given filters, by ``order``, at most 100, with the number of all matches as ``total``."""
    for name, value in filters.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    total = rows.agg(F.count("*").alias("total"))
    return rows.drop(*drop).orderBy(order).limit(min(limit, 100)).crossJoin(F.broadcast(total)).orderBy(order)  # total is one row


def distinct_ids(hits: DataFrame, column: str) -> DataFrame:
    """Distinct whole numbers among ids given as text."""
    return hits.select(F.col(column).try_cast("long").alias(column)).filter(F.col(column).isNotNull()).distinct()
