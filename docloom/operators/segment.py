"""Raw text of a rule to a document tree, by the form of its lines.

Lines are headings (divisions), articles, items, or continue what stands before them. Each division kind, articles and
item kinds have a level; a node's parents are the last nodes of smaller levels that nothing of a still smaller level has
closed since. All of that are windows over one document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Forms of headings: pattern, name, level. The first that fits counts.
HEADINGS = (
    (r"(?i)^antecedentes normativos\b", "Antecedentes Normativos", 1),
    (r"(?i)^anexo\b", "Anexo", 1),
    (r"(?i)^libro\b", "Libro", 1),
    (r"(?i)^t[ií]tulo\b", "Título", 2),
    (r"(?i)^cap[ií]tulo\b", "Capítulo", 3),
    (r"(?i)^secci[oó]n\b", "Sección", 4),
    (r"(?i)^considerando\b", "Consideraciones", 1),
)
ARTICLE = r"(?i)^art(?:[ií]culo|\.)[ ]*(\d+)[°º]?[ .:–—-]*"
ITEMS = (("letter", r"^\(?([a-zñ])\)[ ]*"), ("number", r"^\(?(\d+)[.)°][ ]*"), ("dash", r"^[-•–][ ]*()"))
ARTICLE_LEVEL, LEVELS = 5, 8


def _levels(rows: DataFrame) -> DataFrame:
    """Lines with kind, level (null: continues), name, ordinal and body."""
    line = F.col("line")
    level, name = F.lit(None).cast("int"), F.lit(None).cast("string")
    for pattern, title, at in reversed(HEADINGS):
        level, name = F.when(line.rlike(pattern), at).otherwise(level), F.when(line.rlike(pattern), title).otherwise(name)
    rows = rows.withColumn("level", level).withColumn("name", name)
    rows = rows.withColumn("article", F.col("level").isNull() & line.rlike(ARTICLE)).withColumn("level", F.when(F.col("article"), ARTICLE_LEVEL).otherwise(F.col("level")))
    item = F.lit(None).cast("string")
    for kind, pattern in reversed(ITEMS):
        item = F.when(line.rlike(pattern), kind).otherwise(item)
    return rows.withColumn("item", F.when(F.col("level").isNull(), item))


def segment(docs: DataFrame, key: str = "norm_id", text: str = "text") -> DataFrame:
    """Flat nodes (norm_id, kind, path, parent_path, depth, order_index, name, ordinal, title, body) of each text.

    Text before the first heading or article is a division ``Preámbulo``; articles without a heading before them are in
    ``Cuerpo Principal``. Items belong to the article or division before them; the kind of marker that comes first there
    is their first level, a second kind the second. Unmarked lines continue the node before them. Blank texts give none.
    """
    lines = docs.select(F.col(key).alias("norm_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\n")).alias("pos", "line")).withColumn("line", F.trim("line")).filter("line <> ''").withColumn("pos", 2 * F.col("pos") + 1)
    rows = _levels(lines)
    by_doc = Window.partitionBy("norm_id").orderBy("pos")
    past = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    # implied divisions: a preamble before everything, a main part before the first article that no heading leads
    divided = F.max(F.when(F.col("level") < ARTICLE_LEVEL, 1)).over(past)
    placed = F.max(F.when(F.col("article"), 1)).over(past)
    first = F.row_number().over(by_doc) == 1
    last_name = F.last(F.when(F.col("level") < ARTICLE_LEVEL, F.col("name")), ignorenulls=True).over(past)
    implied = F.when(F.col("article") & placed.isNull() & (divided.isNull() | (last_name == "Consideraciones")), "Cuerpo Principal").when(first & F.col("level").isNull(), "Preámbulo")
    rows = rows.withColumn("implied", implied)
    extra = rows.filter("implied is not null").select("norm_id", (F.col("pos") - 1).alias("pos"), F.lit(None).cast("string").alias("line"), F.lit(1).alias("level"), F.col("implied").alias("name"), F.lit(False).alias("article"), F.lit(None).cast("string").alias("item"))
    rows = rows.drop("implied").unionByName(extra)
    # items: the level of a marker kind is the order in which kinds first occur in their article or division
    rows = rows.withColumn("home", F.max(F.when(F.col("level").isNotNull(), F.col("pos"))).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("first", F.when(F.col("item").isNotNull(), F.min("pos").over(Window.partitionBy("norm_id", "home", "item"))))
    nth = F.dense_rank().over(Window.partitionBy("norm_id", "home", F.col("item").isNotNull()).orderBy("first"))
    rows = rows.withColumn("level", F.coalesce("level", F.when(F.col("item").isNotNull(), F.least(ARTICLE_LEVEL + nth, F.lit(LEVELS)))))
    rows = rows.withColumn("node", F.max(F.when(F.col("level").isNotNull(), F.col("pos"))).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    bodies = rows.groupBy("norm_id", "node").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    starts = rows.filter("level is not null").select("norm_id", "pos", "line", "level", "name")
    seen = Window.partitionBy("norm_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    for at in range(1, LEVELS + 1):
        starts = starts.withColumn(f"l{at}", F.max(F.when(F.col("level") == at, F.col("pos"))).over(seen))
    chain = F.array_compact(F.array(*[F.when((F.lit(at) < F.col("level")) & (F.col(f"l{at}") > F.greatest(F.lit(-1), *[F.coalesce(f"l{b}", F.lit(-1)) for b in range(1, at)] or [F.lit(-1)])), F.col(f"l{at}")) for at in range(1, LEVELS + 1)]))
    starts = starts.withColumn("chain", chain).withColumn("parent", F.try_element_at("chain", F.lit(-1))).withColumn("kind", F.when(F.col("level") < ARTICLE_LEVEL, "division").otherwise("article"))
    starts = starts.withColumn("order_index", F.row_number().over(Window.partitionBy("norm_id", "parent", "kind").orderBy("pos")))
    own = F.concat(F.when(F.col("kind") == "division", "d").otherwise("a"), F.col("order_index").cast("string"))
    names = starts.select("norm_id", F.col("pos").alias("at"), own.alias("own"))
    steps = starts.select("norm_id", "pos", F.explode(F.concat("chain", F.array("pos"))).alias("at")).join(names, ["norm_id", "at"])
    paths = steps.groupBy("norm_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "own"))), lambda s: s["own"]).alias("p"))
    out = starts.join(paths, ["norm_id", "pos"]).join(bodies.withColumnRenamed("node", "pos"), ["norm_id", "pos"])
    return out.select(
        "norm_id",
        "kind",
        F.array_join("p", "_").alias("path"),
        F.nullif(F.array_join(F.slice("p", 1, F.size("p") - 1), "_"), F.lit("")).alias("parent_path"),
        F.size("p").alias("depth"),
        "order_index",
        "name",
        _ordinal(F.col("line"), F.col("kind")).alias("ordinal"),
        F.when(F.col("kind") == "division", F.col("line")).alias("title"),
        _body(F.col("l"), F.col("kind")).alias("body"),
    )


def _ordinal(line: Column, kind: Column) -> Column:
    marks = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (ARTICLE, *[p for _, p in ITEMS])]
    return F.when(kind == "article", F.coalesce(*marks))


def _body(lines: Column, kind: Column) -> Column:
    """Lines of a node without its mark; a division's heading is its title, not its body."""
    plain = F.get(lines, F.lit(0))["line"]
    marked = F.coalesce(*[F.when(plain.rlike(p), F.regexp_replace(plain, p, "")) for p in (ARTICLE, *[p for _, p in ITEMS])], plain)
    rest = F.transform(F.slice(lines, 2, 1_000_000_000), lambda x: x["line"])
    own = F.when(kind == "division", rest).otherwise(F.concat(F.array(marked), rest))
    return F.array_join(F.filter(own, lambda x: x.isNotNull()), "\n")
