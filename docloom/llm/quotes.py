"""Quotation linking: nested quotes are parsed, joined to the messages they quote, and left out of the conversations.

In SQL functions only. A line's quote level is the number of ``>`` before it. Consecutive lines of one level above 0 are
a quoted passage. Passages are normalised (marks and blank lines off, lower case, white space collapsed) and hashed. So
are the texts that messages say themselves: the whole of it, its paragraphs, each two lines that follow each other and
each line. A passage is linked to the first message whose whole text or paragraph it is, else to the first that says its
first two lines, else its first line; in the same conversation if one there says it earlier, else in a conversation of a
smaller id. A message replies to the message with most linked passages of its lowest level; without such, to the message
before it. Conversations that quote others join their threads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import scratch, skew

MARKS = r"^\s*+((?:>\s*+)++)"  # never tried again from within, so that no number of marks is too deep
ATTRIBUTION = r"^\s*+(?:On|Am|Le|El) .{1,200}:\s*+$"
_WHOLE, _TWO, _ONE = 0, 1, 2  # what of a passage a key stands for


def normal(line: Column) -> Column:
    """A line without quote marks, in lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"\s++", " "))


def _key(grain: int, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(f"{grain} "), text)))


def parse(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with ``__lines``: array of level, said (the line without marks), norm (normalised), leads (an attribution before a quote)."""
    lines = F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), r"\r?\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), r"[^>]++", ""))
    rows = messages.withColumn("__raw", lines)
    rows = rows.withColumn("__lines", F.transform("__raw", lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("said"), normal(x).alias("norm"))))
    # an attribution belongs to the quote that follows it
    led = F.transform("__lines", lambda x, i: (x["level"] == 0) & x["said"].rlike(ATTRIBUTION) & (F.coalesce(F.try_element_at("__lines", i + 2)["level"], F.lit(0)) > 0))
    return rows.withColumn("__lines", F.zip_with("__lines", led, lambda x, a: x.withField("leads", a))).drop("__raw")


def _runs(parts: Column) -> Column:
    """Texts between empty lines."""
    return F.filter(F.transform(F.split(F.array_join(parts, "\n"), r"\n{2,}+"), _trimmed), lambda p: p != "")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\n++|\n++$", "")


def _said(paragraphs: Column) -> Column:
    """Keys of a message's own text: whole, paragraphs, pairs of lines, lines."""
    whole = F.array_join(paragraphs, "\n")
    lines = F.when(F.size(paragraphs) > 0, F.split(whole, "\n")).otherwise(F.array().cast("array<string>"))
    pairs = F.zip_with(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("\n"), b))
    entire = F.when(F.size(paragraphs) > 1, F.array(_key(_WHOLE, whole))).otherwise(F.array().cast("array<binary>"))
    return F.concat(entire, F.transform(paragraphs, lambda p: _key(_WHOLE, p)), F.transform(pairs, lambda p: _key(_TWO, p)), F.transform(lines, lambda x: _key(_ONE, x)))


def link(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """One row for each message: its columns without ``text``, and

    own_text (lines outside quotes), n_passages, n_linked (passages with an original), max_level, parent_conv and
    parent_turn (null for a first message), thread_id (smallest conversation id of the thread) and position (reply order
    in the thread, from 1; a parent stands before its replies). Null texts are empty, messages with a null conversation
    or turn quote and are quoted by nobody; rows repeated exactly keep their places in any order. Texts and lines may be
    of any length and quotes of any depth. An empty table gives none. Columns with these names are replaced.
    """
    names = ["own_text", "n_passages", "n_linked", "max_level", "parent_conv", "parent_turn", "thread_id", "position"]
    kept = [c for c in messages.columns if c != text and c not in names]
    parsed = parse(messages.select(*[F.col(f"`{c}`") for c in (*kept, text)]).withColumn("__row", F.monotonically_increasing_id()), text)
    own = F.filter("__lines", lambda x: (x["level"] == 0) & ~x["leads"])
    before = lambda i: F.coalesce(F.try_element_at("__lines", F.greatest(i, F.lit(1)))["level"], F.lit(0))
    starts = F.transform("__lines", lambda x, i: (x["level"] > 0) & ((i == 0) | (before(i) != x["level"])))
    # a passage's lines carry their level; an empty line stands between passages
    marked = F.transform("__lines", lambda x, i: F.when(x["level"] > 0, F.concat(F.when((i > 0) & (before(i) != x["level"]), "\n").otherwise(""), x["level"].cast("string"), F.lit(":"), x["norm"])).otherwise(""))
    shown = F.transform("__lines", lambda x: F.when((x["level"] == 0) & ~x["leads"], x["norm"]).otherwise(""))
    split = parsed.select("*", _runs(marked).alias("__marked"), _runs(shown).alias("__paragraphs"))
    passages = F.transform("__marked", lambda p: F.struct(F.substring_index(p, ":", 1).cast("int").alias("level"), _trimmed(F.regexp_replace(F.regexp_replace(p, r"(?m)^[0-9]++:", ""), r"\n{2,}+", "\n")).alias("text")))
    table = scratch.table(
        split.select(
            *[F.col(f"`{c}`") for c in kept],
            "__row",
            F.col(f"`{conversation}`").alias("__c"),
            F.col(f"`{turn}`").alias("__t"),
            F.array_join(F.transform(own, lambda x: x["said"]), "\n").alias("own_text"),
            _said(F.col("__paragraphs")).alias("__own"),
            F.filter(passages, lambda p: p["text"] != "").alias("__quoted"),
            F.size(F.filter(starts, lambda b: b)).cast("long").alias("n_passages"),
            F.coalesce(F.array_max(F.transform("__lines", lambda x: x["level"])), F.lit(0)).cast("long").alias("max_level"),
        ),
        "messages",
    )
    first, two = F.substring_index("q.text", "\n", 1), F.substring_index("q.text", "\n", 2)
    keys = F.array(F.struct(F.lit(_WHOLE).alias("rank"), _key(_WHOLE, F.col("q.text")).alias("key")), F.struct(F.lit(_TWO).alias("rank"), F.when(two != first, _key(_TWO, two)).alias("key")), F.struct(F.lit(_ONE).alias("rank"), _key(_ONE, first).alias("key")))
    asked = table.filter(F.size("__quoted") > 0).select("__row", "__c", "__t", F.posexplode("__quoted").alias("pid", "q")).select("__row", "__c", "__t", "pid", "q.level", F.explode(keys).alias("k"))
    asked = scratch.table(asked.select("__row", "__c", "__t", "pid", "level", "k.rank", "k.key").filter("key is not null"), "asked")
    uses = asked.groupBy("__c", "key").agg(F.count("*").alias("uses"))
    wanted = uses.groupBy("key").agg(F.sum("uses").alias("uses"))
    said = table.filter("__c is not null and __t is not null").select("__c", "__t", F.explode("__own").alias("key"))
    near = scratch.table(said.groupBy("__c", "key").agg(F.min("__t").alias("near")).join(wanted.select("key"), "key", "left_semi"), "near")
    here = scratch.table(near.join(uses, ["__c", "key"]), "here")
    there = scratch.table(near.groupBy("key").agg(F.min(F.struct("__c", "near")).alias("far")).join(wanted, "key"), "there")
    place = lambda c, t: F.struct(F.col(c).alias("c"), F.col(t).alias("t"))
    found = skew.joined_with_classes(asked, here, ["__c", "key"], "uses").filter("near < __t").select("__row", "pid", "level", "rank", F.lit(0).alias("away"), place("__c", "near").alias("origin"))
    found = found.unionByName(skew.joined_with_classes(asked, there, ["key"], "uses").filter("far.__c < __c").select("__row", "pid", "level", "rank", F.lit(1).alias("away"), place("far.__c", "far.near").alias("origin")))
    linked = found.groupBy("__row", "pid", "level").agg(F.min(F.struct("rank", "away", "origin"))["origin"].alias("origin"))
    votes = linked.groupBy("__row", "level", "origin").agg(F.count("*").alias("n"))
    best = votes.groupBy("__row").agg(F.min(F.struct("level", (-F.col("n")).alias("n"), "origin")).alias("b"), F.sum("n").alias("n_linked"))
    rows = table.drop("__own", "__quoted").join(best.select("__row", F.col("b.origin").alias("__origin"), F.col("n_linked").alias("__linked")), "__row", "left")
    turns = _numbered(table.select("__c", "__t").filter("__c is not null and __t is not null").distinct(), "__c", ["__t"])
    last = turns.select("__c", (F.col("__n") + 1).alias("__n"), F.col("__t").alias("__last"))
    rows = rows.join(turns.join(last, ["__c", "__n"]).select("__c", "__t", "__last"), ["__c", "__t"], "left")
    before = F.when(F.col("__last").isNotNull(), F.struct(F.col("__c").alias("c"), F.col("__last").alias("t")))
    rows = rows.withColumn("__parent", F.coalesce("__origin", before))
    roots = _threads(rows.filter("__origin.c < __c").groupBy("__c").agg(F.min("__origin.c").alias("root")).select("__c", "root")).withColumnRenamed("root", "__root")
    rows = rows.join(roots, "__c", "left").withColumn("thread_id", F.coalesce("__root", "__c"))
    return _numbered(rows, "thread_id", ["__c", "__t", "__row"]).select(
        *[F.col(f"`{c}`") for c in kept],
        "own_text",
        "n_passages",
        F.coalesce("__linked", F.lit(0)).cast("long").alias("n_linked"),
        "max_level",
        F.col("__parent.c").alias("parent_conv"),
        F.col("__parent.t").alias("parent_turn"),
        "thread_id",
        F.col("__n").alias("position"),
    )


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``__n``, from 1 in each group by ``order``.

    A group may hold most rows: they are dealt by ranges of group and order, numbered within each range, and moved on by
    what the ranges before hold of the group.
    """
    dealt = scratch.table(rows.repartitionByRange(group, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    own = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__p", group).orderBy(*order)))
    sizes = dealt.groupBy(F.col(group).alias("__g"), F.col("__p").alias("__q")).agg(F.count("*").alias("__size"))
    above = F.sum("__size").over(Window.partitionBy("__g").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__g", "__q", F.coalesce(above, F.lit(0)).alias("__above"))
    joined = own.join(sizes, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return joined.withColumn("__n", (F.col("__i") + F.col("__above")).cast("long")).drop("__p", "__i", "__g", "__q", "__above")


def _threads(edges: DataFrame) -> DataFrame:
    """Smallest conversation that each conversation's quotes lead to; the way halves with every step."""
    now = scratch.table(edges, "threads")
    while True:
        up = now.select(F.col("__c").alias("root"), F.col("root").alias("higher"))
        moved = now.join(up, "root", "left").select("__c", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved"))
        following = scratch.table(moved, "threads")
        scratch.drop(now)
        now = following.drop("moved")
        now._docloom_path = following._docloom_path
        if not following.filter("moved").head(1):
            return now
