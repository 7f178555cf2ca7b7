"""References, the graph between records, and joins from nodes to their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import number_or


def division_owner(divisions: DataFrame, norms: DataFrame) -> DataFrame:
    """division_id and the record it belongs to."""
    joined = divisions.select(F.col("id").alias("division_id"), F.col("norma_id").alias("infoleg_id"))
    return joined.join(norms.select("infoleg_id", "titulo_sumario"), "infoleg_id")


def article_owner(articles: DataFrame, divisions: DataFrame, norms: DataFrame) -> DataFrame:
    """article_id, its division and the record both belong to."""
    return articles.select(F.col("id").alias("article_id"), "division_id").join(division_owner(divisions, norms), "division_id")


def context_batch(pairs: DataFrame, norms: DataFrame, divisions: DataFrame, articles: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each record that the (entity_type, entity_id, hit_rank) pairs lead to: first_rank and ``columns`` of it.

    ``division_ids`` and ``article_ids`` have an id for each hit, by rank; ``divisions`` and ``articles`` have each node
    asked for once, by its first hit, with its body. Unknown types and ids are left out. Hits meet their nodes as ranks of
    an id, so no body is repeated for a hit, and a caller who takes only ids moves no bodies.
    """
    asked = pairs.filter(F.col("entity_id").isNotNull())
    rank = F.col("hit_rank")
    unranked = F.array_repeat(F.lit(None).cast(pairs.schema["hit_rank"].dataType), F.count_if(rank.isNull()).cast("int"))
    hits = lambda kind: asked.filter(F.col("entity_type") == kind).groupBy(F.col("entity_id").alias("id")).agg(F.min(rank).alias("first"), F.concat(unranked, F.collect_list(rank)).alias("ranks"))
    parts = lambda rows, kind, label: rows.select("norma_id", F.lit(kind).alias("kind"), "id", "first", "ranks", F.col(label).cast("string").alias("label"), "body")
    owners = divisions.select(F.col("id").alias("division_id"), "norma_id")
    d = hits("division").join(divisions.select("id", "norma_id", "name", "body"), "id")
    a = hits("article").join(articles.select("id", "division_id", "order_index", "body"), "id").join(owners, "division_id")
    found = parts(d, "division", "name").unionByName(parts(a, "article", "order_index"))

    def ids(kind: str) -> Column:
        each = F.transform(F.collect_list(F.when(F.col("kind") == kind, F.struct("id", "ranks"))), lambda x: F.transform(x["ranks"], lambda r: F.struct(r.alias("hit_rank"), x["id"].alias("id"))))
        return F.transform(F.sort_array(F.flatten(each)), lambda x: x["id"])

    def nodes(kind: str, label: str) -> Column:
        each = F.struct("first", "id", F.col("label").alias(label), "body")
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, each))), lambda x: F.struct(x["id"].alias("id"), x[label].alias(label), x["body"].alias("body")))

    grouped = found.groupBy("norma_id").agg(
        F.min("first").alias("first_rank"), ids("division").alias("division_ids"), ids("article").alias("article_ids"), nodes("division", "name").alias("divisions"), nodes("article", "ordinal").alias("articles")
    )
    return grouped.join(norms.select("infoleg_id", *columns), grouped["norma_id"] == norms["infoleg_id"]).drop("norma_id")


def complements(edges: DataFrame) -> DataFrame:
    """(infoleg_id, relation, other): the records that each record complements and those that complement it, distinct.

    A row for each, since a record may have most others as neighbours.
    """
    out = edges.select(F.col("origin").alias("infoleg_id"), F.lit("complements").alias("relation"), F.col("destination").alias("other"))
    into = edges.select(F.col("destination").alias("infoleg_id"), F.lit("complemented_by").alias("relation"), F.col("origin").alias("other"))
    return out.unionByName(into).distinct()


def reference_rows(refs: DataFrame) -> DataFrame:
    """References with their number parsed, -1 where it is none."""
    return refs.withColumn("numero", number_or(F.col("numero")))


def references_of(norms: DataFrame, refs: DataFrame) -> DataFrame:
    """Each record with the list of its references in order."""
    grouped = refs.groupBy("norma_id").agg(F.array_sort(F.collect_list(F.struct("ord", "numero", "dependencia"))).alias("references"))
    joined = norms.select("infoleg_id").join(grouped, norms["infoleg_id"] == grouped["norma_id"], "left")
    return joined.select("infoleg_id", F.coalesce("references", F.array().cast(grouped.schema["references"].dataType)).alias("references"))


def edges(norms: DataFrame, outgoing: str, incoming: str, key: str = "infoleg_id", kind: str = "complementa") -> DataFrame:
    """Distinct directed edges from two lists of each record; the second list's edges point at the record."""
    out = norms.select(F.col(key).alias("origin"), F.explode(outgoing).alias("destination"))
    into = norms.select(F.explode(incoming).alias("origin"), F.col(key).alias("destination"))
    return out.unionByName(into).distinct().withColumn("kind", F.lit(kind))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest ``order``."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__rn = 1").drop("__rn")
