"""Bounded samples of labelled rows, and folds by key, for the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import scratch


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(f"`{key}`").cast("string")) % modulus


def totals(labels: DataFrame, key: str, label: str) -> tuple[int, int]:
    """How many rows with a key have label 0 and how many label 1."""
    y = F.col(f"`{label}`").cast("int")
    row = labels.filter(F.col(f"`{key}`").isNotNull()).agg(*[F.count(F.when(y == k, 1)) for k in (0, 1)]).first()
    return row[0], row[1]


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows (text, y, order) for each of the labels 0 and 1, chosen by a hash of the key.

    The bound is on labelled rows only; texts are whole, of any length, and null ones are empty. Rows without key or
    label are not learned from. Which labels are taken is decided on the labels alone, a row of a few bytes each, so the
    texts are read once, by a join with ``2 * per_class`` rows at most. Of several documents with one key the least text is taken.
    """
    names = labels.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{label}`").cast("int").alias("y")).filter(F.col("__k").isNotNull())
    names = names.withColumn("order", F.xxhash64("__k", F.lit(label)))
    picked = None
    for y in (0, 1):
        own = names.filter(F.col("y") == y).distinct().orderBy("order", "__k").limit(per_class)
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.select(F.col(f"`{key}`").alias("__k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(picked), "__k").groupBy("__k", "y", "order").agg(F.min("text").alias("text"))
    return scratch.table(joined.select("text", "y", "order"), "sample")
