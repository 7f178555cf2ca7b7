"""Operators on node tables that hold ids of parents: descendants and insertion order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources import shared


def descendants(nodes: DataFrame, roots: DataFrame | int, parent: str) -> DataFrame:
    """(root, id, depth) of each root (a table with ``id``, or one id) and of all below it.

    Every node knows a node above it and the roots up to there. In each round it takes over what that node knows, so
    the distance doubles and a tree of depth n needs about log2(n) rounds, whatever the number of its nodes. What a node
    holds is its part of the result. A node whose parent is missing ends there. On a circle a root is met
    once, with its least depth: where a node would learn of a root again its walk has been round, and one that meets no
    root ends when it is longer than there are nodes.

    Where ids repeat, a node is below each node of its parent's id, as in SQL. Roots that
    come with their ``parent`` are told from other nodes of their id by it.
    """
    wanted = nodes.filter(F.col("id") == roots) if isinstance(roots, int) else roots
    up = F.col(parent).cast(nodes.schema["id"].dataType).alias("up")
    begun = shared.table(nodes.select("id", up), "nodes")
    if parent in wanted.columns:
        named = wanted.select(F.col("id").alias("r"), up.alias("u"), F.lit(True).alias("own")).distinct()
        begun = begun.join(named, (F.col("id") == F.col("r")) & F.col("up").eqNullSafe(F.col("u")), "left").drop("r", "u")
    else:
        begun = begun.join(wanted.select("id", F.lit(True).alias("own")).distinct(), "id", "left")
    if begun.groupBy("id").count().filter("count > 1").head(1):
        return _of_repeated(begun)
    own = F.array(F.struct(F.col("id").alias("root"), F.lit(0).cast("long").alias("depth")))
    table = shared.table(begun.select("id", "up", F.lit(1).cast("long").alias("steps"), F.when(F.col("own"), own).otherwise(F.filter(own, lambda r: F.lit(False))).alias("line")), "lines")
    reach, most = 1, table.count()
    while reach <= 2 * most and table.filter(F.col("up").isNotNull()).head(1):
        above = table.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("line").alias("far"))
        moved = table.filter(F.col("up").isNotNull()).join(above, "up", "left")
        known, far = F.transform("line", lambda r: r["root"]), F.transform("far", lambda r: r["root"])
        circle = F.coalesce(F.arrays_overlap(known, far), F.lit(False))
        shifted = F.transform("far", lambda r: F.struct(r["root"].alias("root"), (r["depth"] + F.col("steps")).alias("depth")))
        fresh = F.when(circle, F.filter(shifted, lambda r: ~F.array_contains(F.transform("line", lambda x: x["root"]), r["root"]))).otherwise(shifted)
        line = F.when(F.col("far").isNull(), F.col("line")).otherwise(F.concat("line", fresh))
        # new names, since in functions of elements a name would mean the column that is being made
        moved = moved.select("id", F.when(~circle, F.col("next")).alias("u"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("s"), line.alias("l")).toDF(*table.columns)
        table = shared.table(moved.unionByName(table.filter(F.col("up").isNull())), "lines")
        reach *= 2
    return table.select("id", F.explode("line").alias("r")).select("r.root", "id", F.col("r.depth").cast("int").alias("depth"))


def _of_repeated(nodes: DataFrame) -> DataFrame:
    """(root, id, depth) of nodes (id, up, own) whose ids repeat: a row for each way from a root to a node, as walks would find.

    ``far`` holds the ways of ``reach`` steps upwards, ``found`` the results of fewer; both double in a round.
    """
    found = shared.table(nodes.filter("own").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")), "found")
    far, reach, most = shared.table(nodes.filter("up is not null").select("id", "up"), "far"), 1, nodes.count()
    while far.head(1):
        if reach > 2 * most:
            raise ValueError("nodes of repeated ids lie on a circle, so ways have no end")
        above = found.select("root", F.col("id").alias("up"), (F.col("depth") + reach).alias("depth"))
        found = shared.table(found.unionByName(far.join(above, "up").select("root", "id", "depth")), "found")
        far = shared.table(far.join(far.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "far")
        reach *= 2
    return found


def numbered(nodes: DataFrame, group: str, order: str) -> DataFrame:
    """Nodes with ``number``, from 1 in each group."""
    return nodes.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long"))
