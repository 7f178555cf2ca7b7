"""Document trees: JSON at the edge, flat tables with path keys inside.

A tree is {"divisions": [{name, ordinal, title, body, articles, divisions}]}; an article is {ordinal, body, articles}.
Spark has no recursive types, so children travel as JSON text and one level is unfolded at a time. Paths look like
``d1_d2`` and ``d5_a1_a2``; ``sort_path`` pads the numbers and ranks a node's articles before its divisions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources import shared

_DIVISION = "struct<name:string,ordinal:string,title:string,body:string,embedding:array<double>,articles:array<string>,divisions:array<string>>"
_ARTICLE = "struct<ordinal:string,body:string,embedding:array<double>,articles:array<string>>"
NODE = ["norm_id", "kind", "path", "parent_path", "sort_path", "depth", "order_index", "name", "ordinal", "title", "body", "embedding"]


_ROW = "array<struct<kind:string,path:string,parent_path:string,sort_path:string,depth:int,order_index:int,name:string,ordinal:string,title:string,body:string,embedding:array<double>,__articles:array<string>,__divisions:array<string>>>"
_UNFOLDED = 4  # levels that are unfolded in one pass


def _children(column: str, kind: str) -> Column:
    """Structs of ``_ROW`` of the children in a column of JSON texts, each parsed once, their order counted from 1."""
    letter, rank = ("d", "2") if kind == "division" else ("a", "1")
    none = F.lit(None).cast("string")

    def child(n: Column, i: Column) -> Column:
        order = (i + 1).cast("string")
        own = F.concat(F.lit(letter), order)
        return F.struct(
            F.lit(kind).alias("kind"),
            F.when(F.col("path") == "", own).otherwise(F.concat_ws("_", "path", own)).alias("path"),
            F.when(F.col("path") != "", F.col("path")).alias("parent_path"),
            F.concat("sort_path", F.lit(rank), F.lpad(order, 6, "0")).alias("sort_path"),
            (F.col("depth") + 1).alias("depth"),
            (i + 1).alias("order_index"),
            (n["name"] if kind == "division" else none).alias("name"),
            n["ordinal"].alias("ordinal"),
            (n["title"] if kind == "division" else none).alias("title"),
            n["body"].alias("body"),
            n["embedding"].alias("embedding"),
            n["articles"].alias("__articles"),
            (n["divisions"] if kind == "division" else F.lit(None).cast("array<string>")).alias("__divisions"),
        )

    read = F.transform(F.col(column), lambda j: F.from_json(j, _DIVISION if kind == "division" else _ARTICLE))
    return F.coalesce(F.transform(read, child).cast(_ROW), F.array().cast(_ROW))


def _unfold(rows: DataFrame, first: bool) -> DataFrame:
    """Children of all rows and, but for the ``first`` level, the rows themselves, which then have none to unfold."""
    below = [_children("__articles", "article"), _children("__divisions", "division")]
    if not first:
        none = F.lit(None).cast("array<string>")
        below.insert(0, F.array(F.struct(*NODE[1:], none.alias("__articles"), none.alias("__divisions"))).cast(_ROW))
    return rows.select("norm_id", F.explode(F.concat(*below)).alias("n")).select("norm_id", "n.*")


def flatten(trees: DataFrame, key: str, tree: str, depth: int | None = None) -> DataFrame:
    """All nodes of all trees, of any depth, one row each (columns ``NODE``). Broken JSON gives no rows.

    Levels are unfolded within a row, so nothing is shuffled or written; a query that needs few columns carries few. Only
    of trees that go on below ``_UNFOLDED`` levels, what is left to unfold is written to the shared folder, for the next
    pass to start from. Where the caller states the ``depth`` no pass looks for such trees, and a deeper one is an error.
    """
    top = F.from_json(tree, "struct<divisions:array<string>>")["divisions"]
    level = trees.select(F.col(key).alias("norm_id"), F.lit("").alias("path"), F.lit("").alias("sort_path"), F.lit(0).alias("depth"), F.lit(None).cast("array<string>").alias("__articles"), top.alias("__divisions"))
    levels = []
    more = (F.coalesce(F.size("__articles"), F.lit(0)) > 0) | (F.coalesce(F.size("__divisions"), F.lit(0)) > 0)
    while True:
        for i in range(depth or _UNFOLDED):
            level = _unfold(level, i == 0)
        if depth:
            error = F.raise_error(F.lit(f"a tree is deeper than {depth} levels")).cast("boolean")
            return level.filter(F.when(more, error).otherwise(True)).select(*NODE)
        levels.append(level.select(*NODE))
        level = shared.table(level.filter(more).select("norm_id", "path", "sort_path", "depth", "__articles", "__divisions"), "level")
        if not level.head(1):
            break
    return reduce(DataFrame.unionByName, levels)


def keyed(nodes: DataFrame) -> DataFrame:
    """Nodes with ``id`` and ``parent_id``, the same for the same record and path on every run."""
    key = lambda path: F.xxhash64("norm_id", path)
    return nodes.withColumn("id", key("path")).withColumn("parent_id", F.when(F.col("parent_path").isNotNull(), key("parent_path")))


def depth_order(nodes: DataFrame) -> DataFrame:
    """Nodes numbered from 1 within their record in the order of insertion: a division, its articles, its divisions."""
    return nodes.withColumn("number", F.row_number().over(Window.partitionBy("norm_id").orderBy("sort_path")).cast("long"))


def attach_keys(nodes: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the stored key of their path, and those that have none and must not go on."""
    known = stored.select("norm_id", "path", F.col("id").alias("stored_id"))
    return nodes.join(known, ["norm_id", "path"]), nodes.join(known, ["norm_id", "path"], "left_anti")


def rebuild(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """norm_id and tree (JSON) from flat nodes; children by order, nodes whose parent is missing left out."""
    deepest = max_depth or nodes.agg(F.max("depth")).first()[0] or 0
    below: DataFrame | None = None
    for depth in range(deepest, 0, -1):
        own = nodes.filter(F.col("depth") == depth)
        if below is not None:
            kids = below.groupBy("norm_id", F.col("parent_path").alias("path")).agg(
                F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "article", F.struct("order_index", "path", "json")))), lambda c: c["json"]).alias("a"),
                F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "division", F.struct("order_index", "path", "json")))), lambda c: c["json"]).alias("d"),
            )
            own = own.join(kids, ["norm_id", "path"], "left")
        else:
            own = own.withColumn("a", F.lit(None).cast("array<string>")).withColumn("d", F.lit(None).cast("array<string>"))
        listed = lambda c: F.concat(F.lit("["), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ","), F.lit("]"))
        # fields as JSON without the closing brace; the children's JSON is inserted as it is
        article = F.concat(_open(F.struct("ordinal", "body")), F.lit(',"articles":'), listed(F.col("a")), F.lit("}"))
        division = F.concat(_open(F.struct("name", "ordinal", "title", "body")), F.lit(',"articles":'), listed(F.col("a")), F.lit(',"divisions":'), listed(F.col("d")), F.lit("}"))
        below = own.select("norm_id", "kind", "path", "parent_path", "order_index", F.when(F.col("kind") == "article", article).otherwise(division).alias("json"))
        if (deepest - depth) % 4 == 3:  # deep trees would make one plan of all levels
            below = shared.table(below, "below")
    roots = below.groupBy("norm_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "path", "json"))), lambda c: c["json"]).alias("d"))
    return roots.select("norm_id", F.concat(F.lit('{"divisions":['), F.array_join("d", ","), F.lit("]}")).alias("tree"))


def _open(fields: Column) -> Column:
    json = F.to_json(fields, {"ignoreNullFields": "false"})
    return F.substring(json, 1, F.length(json) - 1)


def subtree(nodes: DataFrame, norm_id: int, path: str) -> DataFrame:
    """A node and all below it, in document order."""
    own = nodes.filter(F.col("norm_id") == norm_id)
    return own.filter((F.col("path") == path) | F.col("path").startswith(f"{path}_")).orderBy("sort_path")


def document_text(nodes: DataFrame) -> DataFrame:
    """norm_id and its nodes' bodies in document order, stripped, blank ones left out, joined by a space."""
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    texts = nodes.filter(body != "").groupBy("norm_id").agg(F.array_sort(F.collect_list(F.struct("sort_path", body.alias("body")))).alias("b"))
    return texts.select("norm_id", F.array_join(F.transform("b", lambda x: x["body"]), " ").alias("text"))


def counts(nodes: DataFrame) -> DataFrame:
    """Divisions and articles of each record."""
    return nodes.groupBy("norm_id").agg(F.count_if(F.col("kind") == "division").alias("divisions_created"), F.count_if(F.col("kind") == "article").alias("articles_created"))


def structure_errors(trees: DataFrame, key: str, tree: str) -> DataFrame:
    """First error of each tree in document order: key, path, error. Trees without error give no row.

    Checked are the list of divisions, the required keys of every node at every depth, string fields (null allowed) and
    list fields.
    """
    v = F.try_parse_json(tree)
    root = trees.select(F.col(key).alias(key), v.alias("v"))
    kind_of = lambda value, path: F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    is_list = lambda kind: F.coalesce(kind.startswith("ARRAY"), F.lit(False))
    errors = [root.filter(F.col("v").isNull()).select(key, F.lit("").alias("path"), F.lit("").alias("sort"), F.lit("not JSON").alias("error"))]
    top = kind_of(F.col("v"), "$.divisions")
    errors.append(root.filter(F.col("v").isNotNull() & ~is_list(top)).select(key, F.lit("").alias("path"), F.lit("").alias("sort"), F.lit("divisions must be a list").alias("error")))
    fields = {"division": (["name", "ordinal", "title", "body"], ["articles", "divisions"]), "article": (["ordinal", "body"], ["articles"])}
    level = {"division": _nodes(root.filter(is_list(top)).select(key, F.lit("").alias("path"), F.lit("").alias("sort"), "v"), key, "divisions", "d", "2"), "article": None}
    while True:
        following: dict[str, list[DataFrame]] = {"division": [], "article": []}
        for kind, rows in level.items():
            if rows is None:
                continue
            texts, lists = fields[kind]
            checks = []
            for name in texts + lists:
                found = kind_of(F.col("v"), f"$.{name}")
                checks.append(F.when(found.isNull(), f"missing {name}"))
                if name in texts:
                    checks.append(F.when(~found.isin("STRING", "VOID"), f"{name} must be a string"))
                else:
                    checks.append(F.when(~is_list(found), f"{name} must be a list"))
            checked = rows.withColumn("error", F.coalesce(*checks))
            errors.append(checked.filter("error is not null").select(key, "path", "sort", "error"))
            for name in lists:
                child = "division" if name == "divisions" else "article"
                ok = rows.filter(is_list(kind_of(F.col("v"), f"$.{name}")))
                following[child].append(_nodes(ok, key, name, "d" if child == "division" else "a", "2" if child == "division" else "1"))
        level = {k: shared.table(reduce(DataFrame.unionByName, v), "level") if v else None for k, v in following.items()}
        if not any(rows is not None and rows.head(1) for rows in level.values()):
            break
    everything = reduce(DataFrame.unionByName, errors)
    return everything.groupBy(key).agg(F.min(F.struct("sort", "path", "error")).alias("e")).select(key, "e.path", "e.error")


def _nodes(rows: DataFrame, key: str, name: str, letter: str, rank: str) -> DataFrame:
    values = F.try_variant_get("v", f"$.{name}", "array<variant>")
    out = rows.select(key, "path", "sort", F.posexplode(values).alias("p", "child"))
    own = F.concat(F.lit(letter), (F.col("p") + 1).cast("string"))
    return out.select(key, F.when(F.col("path") == "", own).otherwise(F.concat_ws("_", "path", own)).alias("path"), F.concat("sort", F.lit(rank), F.lpad((F.col("p") + 1).cast("string"), 6, "0")).alias("sort"), F.col("child").alias("v"))


def search_documents(nodes: DataFrame, meta: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One search document for each node with an embedding, with its record's metadata.

    A division without embedding is left out but what is below it stays; an article without one hides its sub-articles.
    ``summaries`` (norm_id, embedding) adds a document for each summary.
    """
    bare = nodes.filter((F.col("kind") == "article") & F.col("embedding").isNull()).select("norm_id", F.col("path").alias("hidden"))
    shown = nodes.filter(F.col("embedding").isNotNull())
    under = shown.alias("n").join(bare.alias("b"), (F.col("n.norm_id") == F.col("b.norm_id")) & F.array_contains(_ancestors("n.path"), F.col("b.hidden")), "left_anti")
    letter = F.when(F.col("kind") == "division", "d").otherwise("a")
    docs = under.select("norm_id", F.format_string("n%s_%s%s", F.col("norm_id").cast("string"), letter, F.xxhash64("norm_id", "path").cast("string")).alias("doc_id"), F.col("kind").alias("document_type"), "path", "embedding")
    if summaries is not None:
        more = summaries.filter(F.col("embedding").isNotNull())
        docs = docs.unionByName(more.select("norm_id", F.format_string("n%s_summarized", F.col("norm_id").cast("string")).alias("doc_id"), F.lit("summarized_text").alias("document_type"), F.lit(None).cast("string").alias("path"), "embedding"))
    return docs.join(meta, "norm_id")


def _ancestors(path: str) -> Column:
    parts = F.split(path, "_")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "_"))


def positional_documents(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents ``doc_{n}``, ``div_{n}_{i}``, ``art_{n}_{i}_{j}`` by position (from 0); of equal ids the last node stays.

    Nested divisions count anew, so their ids repeat; nested articles are left out.
    """
    i = F.col("order_index") - 1
    parent = F.regexp_extract("parent_path", r"d(\d+)$", 1).cast("int") - 1
    own = nodes.filter("embedding is not null").filter("kind = 'division' or parent_path rlike 'd[0-9]+$'")
    ids = F.when(F.col("kind") == "division", F.format_string("div_%s_%d", F.col("norm_id").cast("string"), i)).otherwise(F.format_string("art_%s_%d_%d", F.col("norm_id").cast("string"), parent, i))
    placed = own.select("norm_id", ids.alias("doc_id"), "sort_path", "embedding").groupBy("norm_id", "doc_id").agg(F.max_by("embedding", "sort_path").alias("embedding"))
    whole = documents.filter("embedding is not null").select("norm_id", F.format_string("doc_%s", F.col("norm_id").cast("string")).alias("doc_id"), "embedding")
    return placed.unionByName(whole)
