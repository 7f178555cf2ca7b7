"""Keyed tables: upsert, replacement of children, cascading delete, cache tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources import shared


def keyed_table(rows: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """``rows`` written once in buckets of their key, sorted, to a new folder of the shared one.

    Joins on the key, so upserts, replacements and deletes, then read the table where it lies: only what is incoming is
    shuffled, to the table's buckets. ``buckets`` should be as many as a shuffle of the table would have partitions.
    """
    spark = rows.sparkSession
    path = shared.new_path(spark, "keyed")
    name = "docloom_" + path.rsplit("-", 1)[-1]
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def upsert(base: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``incoming`` in place of those with the same key.

    Of incoming rows with one key the largest stays, so that a repeated delivery changes nothing. The base is not
    sorted: its replaced rows leave by an anti join.
    """
    value = F.struct(*[F.col(f"`{c}`") for c in base.columns])
    last = incoming.groupBy(key).agg(F.max(value).alias("row")).select("row.*") if _sortable(base) else incoming.dropDuplicates([key])
    return base.join(last.select(key), key, "left_anti").select(*base.columns).unionByName(last.select(*base.columns))


def _sortable(df: DataFrame) -> bool:
    return not any("map<" in kind or "variant" in kind for _, kind in df.dtypes)


def replace_children(children: DataFrame, parent: str, updated: DataFrame) -> DataFrame:
    """``children`` with those of every parent in ``updated`` exchanged for its rows there."""
    return children.join(updated.select(parent).distinct(), parent, "left_anti").select(*children.columns).unionByName(updated.select(*children.columns))


def delete_cascade(ids: DataFrame, norms: DataFrame, divisions: DataFrame, articles: DataFrame, references: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """All tables without the records in ``ids`` (infoleg_id) and what hangs on them; edges between records stay."""
    gone = ids.select(F.col("infoleg_id").alias("norma_id")).distinct()
    lost = divisions.join(gone, "norma_id", "left_semi").select(F.col("id").alias("division_id"))
    return {
        "norms": norms.join(gone, norms["infoleg_id"] == gone["norma_id"], "left_anti"),
        "divisions": divisions.join(gone, "norma_id", "left_anti"),
        "articles": articles.join(lost, "division_id", "left_anti"),
        "references": references.join(gone, "norma_id", "left_anti"),
        "vectors": vectors.join(gone, vectors["source_id"] == gone["norma_id"], "left_anti"),
    }


def cached(requested: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests that the cache answers."""
    return requested.join(cache.select(key).distinct(), key, "left_semi")


def missing(requested: DataFrame, cache: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Requests to process: those not in the cache, or all by ``force``."""
    return requested if force else requested.join(cache.select(key).distinct(), key, "left_anti")


def consistent(relational: DataFrame, vectorial: DataFrame, key: str) -> DataFrame:
    """Keys written to both stores (``both``) or to one only (``relational_only``, ``vector_only``)."""
    left = relational.select(key).distinct().withColumn("r", F.lit(True))
    right = vectorial.select(key).distinct().withColumn("v", F.lit(True))
    status = F.when(F.col("r") & F.col("v"), "both").when(F.col("r"), "relational_only").otherwise("vector_only")
    return left.join(right, key, "full_outer").select(key, status.alias("status"))


def replay(ids: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Cached records of the requested ids with status ``replayed``, else ``not_in_cache``."""
    found = ids.distinct().join(cache.withColumn("__hit", F.lit(True)), key, "left")
    return found.withColumn("status", F.when(F.col("__hit"), "replayed").otherwise("not_in_cache")).drop("__hit")


def unwrap(messages: DataFrame, wrapper: str = "data", marks: tuple[str, ...] = ("cached_at",)) -> DataFrame:
    """Messages in a cache wrapper become what they wrap; others stay. The fields of both are those in the wrapper."""
    fields = messages.schema[wrapper].dataType.names
    wrapped = F.col(wrapper).isNotNull() & F.greatest(*[F.col(m).isNotNull() for m in (*marks, *marks)])
    return messages.select(*[F.when(wrapped, F.col(f"{wrapper}.{f}")).otherwise(F.col(f)).alias(f) for f in fields])
