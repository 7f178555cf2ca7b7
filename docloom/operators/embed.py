"""User functions on columns of text: embedding, correction, structuring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def hash_slot(word: Column, dims: int) -> Column:
    """The slot of a word: the first 60 bits of its MD5 modulo ``dims``, which any engine can compute."""
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long") % dims


def hash_embedding(texts: DataFrame, key: str, text: str, dims: int = 64, out: str = "embedding") -> DataFrame:
    """(key, ``out``): a vector of unit length from the counts of the words' slots; the default where no model is given.

    Words are lower-cased runs without ASCII white space. A text's words become rows, counted by slot before anything is
    shuffled, so what leaves a task is a row for each text and slot at most, however long or frequent a text is. Rows with
    the same key are one text. Texts without words, null ones included, have a null vector; so has a null key's, whose
    rows are also one text.
    """
    own = texts.select(F.col(f"`{key}`").alias("__k"), F.explode_outer(F.split(F.lower(F.col(f"`{text}`").cast("string")), r"[ \t-\r]+")).alias("__w"))
    slots = own.select("__k", F.when(F.col("__w") != "", hash_slot(F.col("__w"), dims)).cast("int").alias("__s"))
    counts = slots.groupBy("__k", "__s").agg(F.count("*").cast("double").alias("__n"))
    filled = F.when(F.col("__s").isNotNull(), F.struct("__s", "__n"))
    sparse = counts.groupBy("__k").agg(F.map_from_entries(F.collect_list(filled)).alias("m"), F.sqrt(F.sum(F.when(F.col("__s").isNotNull(), F.col("__n") * F.col("__n")))).alias("length"))  # dims entries at most
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("length"))
    return sparse.select(F.col("__k").alias(key), F.when(F.col("length").isNotNull(), vector).alias(out))


def embed(df: DataFrame, column: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], out: str = "embedding") -> DataFrame:
    """``df`` with vectors from a model; ``make`` loads it once for each task. Blank texts get null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            texts = batch.fillna("").str.strip()
            vectors = iter(model(texts[texts != ""].tolist()))
            yield pd.Series([list(next(vectors)) if t else None for t in texts])

    return df.withColumn(out, run(F.col(column)))


def correct(df: DataFrame, column: str, make: Callable[[], Callable[[str], str]], model: str, out: str = "attempt") -> DataFrame:
    """``df`` with the outcome of a correcting model: struct<model, output, success>; an error is a failed attempt."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fix = make()

        def one(text: str | None) -> str | None:
            try:
                return None if text is None else fix(text)
            except Exception:  # noqa: BLE001  any failure of a user's model is an attempt that failed
                return None

        for batch in batches:
            yield batch.map(one)

    rows = df.withColumn("__out", run(F.col(column)))
    return rows.withColumn(out, F.struct(F.lit(model).alias("model"), F.col("__out").alias("output"), F.col("__out").isNotNull().alias("success"))).drop("__out")


def structure(df: DataFrame, column: str, make: Callable[[], Callable[[str], str]], out: str = "tree") -> DataFrame:
    """``df`` with a tree (JSON) from a structuring function, through batches of rows; failures give null."""
    schema = StructType([f for f in df.schema if f.name != out] + [StructField(out, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        build = make()

        def one(text: str | None) -> str | None:
            try:
                return None if text is None else build(text)
            except Exception:  # noqa: BLE001  any failure of a user's function gives no tree
                return None

        for batch in batches:
            yield batch.assign(**{out: batch[column].map(one)})

    return df.mapInPandas(run, schema)
