"""Secrets by corpus-wide ownership frequency, in SQL functions only.

Fixed patterns give the base spans; those always stay. A wider pattern proposes other long tokens that mix letters and
digits. All candidate values are hashed and aggregated over the corpus by distinct repositories and owners: a value whose
repositories are spread over several owners is a widely copied example; one that is concentrated in its owner's, however
many these are, is specific to that owner and looks live. Proposed spans of the second sort are added; base spans are only told
apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import scratch, skew, spans

KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
BASE = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}+", "hex": "[0-9a-f]{24,}+"}
WIDE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
_VALUE = r"""[A-Za-z0-9+/_.=-]+$"""
_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
OWNERS = 2  # a value spread over more owners is a copied example; an owner counts by its share of the value's repositories


def _value(kind: str, text: Column) -> Column:
    return F.regexp_replace(text, _HEAD, "") if kind == "assign" else text


def _mixed(text: Column) -> Column:
    """Looks random: upper and lower case and several digits."""
    return text.rlike("[A-Z]") & text.rlike("[a-z]") & (F.length(F.regexp_replace(text, "[^0-9]", "")) >= 3)


def _candidate(kind: str) -> Callable[[Column], Column]:
    rank = F.lit(KINDS.index(kind))
    return lambda m: F.struct(m["start"].alias("start"), rank.alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.sha2(_value(kind, m["text"]), 256).alias("value"))


def scan(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``__found``: kind, start, end, value hash of all candidates, by start, then kind as listed."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    gates = {"assign": t.rlike("[:=]"), "access": t.contains("AKIA"), "hex": None, "token": None}
    raw = []
    for k in KINDS:
        found, gaps = spans.find(t, BASE.get(k, WIDE), gates[k])
        raw += [found.alias(f"__m_{k}"), gaps.alias(f"__g_{k}")]
    df = docs.select(*kept, *raw)
    df = df.select(*kept, *[spans.placed(F.col(f"__m_{k}"), F.col(f"__g_{k}")).alias(f"__m_{k}") for k in KINDS])
    keep = {"assign": lambda m: F.length(_value("assign", m["text"])) >= 6, "access": lambda m: F.lit(True), "hex": lambda m: F.lit(True), "token": lambda m: _mixed(m["text"])}
    tagged = [F.transform(F.filter(f"__m_{k}", keep[k]), _candidate(k)) for k in KINDS]
    return df.select(*kept, F.array_sort(F.concat(*tagged)).alias("__found"))


def ownership(candidates: DataFrame) -> DataFrame:
    """value -> repositories and owners that have it, spread, uses, copied; from rows (value, owner, repository).

    ``spread`` is how many owners with equally many repositories each would be as concentrated: 1 for a single owner,
    little more if others have few of the repositories, the number of owners if all have equally many. It depends on
    shares, not on the size of the corpus. A null owner is an owner. Equal rows are summed before each shuffle, so a value that most rows have is no burden to any task.
    """
    repositories = candidates.groupBy("value", "owner", "repository").agg(F.count("*").alias("uses"))
    owners = repositories.groupBy("value", "owner").agg(F.count("*").alias("n"), F.sum("uses").alias("uses"))
    counts = owners.groupBy("value").agg(F.sum("n").alias("repositories"), F.count("owner").alias("owners"), F.sum("uses").alias("uses"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    spread = F.col("repositories").cast("double") * F.col("repositories") / F.col("squares")
    return counts.withColumn("spread", spread).withColumn("copied", F.col("spread") > OWNERS).drop("squares")


def find_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """``docs`` (without ``text`` unless ``keep_text``) with ``base``, ``spans``, ``live`` and ``copied``.

    ``base`` and ``spans`` are arrays of kind, start, end, by start, then kind; ``live`` and ``copied`` count the candidates
    that look live and those whose value is widely copied. Null owners count as one, and null repositories as one.
    Null texts have no spans; repeated rows and null keys are rows like others, and an empty table gives none. Columns
    with these names are replaced.
    """
    names = ["base", "spans", "live", "copied"]
    kept = [c for c in docs.columns if c not in names]
    found = scan(docs.select(*[F.col(f"`{c}`") for c in kept]), text)
    found = found if keep_text else found.drop(text)
    kept = [c for c in kept if keep_text or c != text]
    table = scratch.table(found.withColumn("__row", F.monotonically_increasing_id()), "secrets")
    one = table.filter(F.size("__found") > 0).select("__row", F.col(f"`{owner}`").alias("owner"), F.col(f"`{repository}`").cast("string").alias("repository"), F.explode("__found").alias("s"))
    one = one.select("__row", "owner", "repository", "s.*")
    values = scratch.table(ownership(one).select("value", "uses", "copied"), "values")
    judged = skew.joined_with_classes(one, values, ["value"], "uses")
    # a proposed token stands only apart from base spans: none that begins before it reaches it, none begins within it
    is_base = F.col("kind") != "token"
    reach, following = spans.around(["__row"], ["start", "rank"], is_base)
    apart = is_base | ((F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end")))
    rows = judged.withColumn("apart", apart).filter("apart").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "copied"))).alias("s"))
    short = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.filter("s", lambda s: s["kind"] != "token")
    shown = F.filter("s", lambda x: (x["kind"] != "token") | ~x["copied"])
    copied = F.size(F.filter("s", lambda s: s["copied"]))
    rows = rows.select("__row", F.transform(base, short).alias("base"), F.transform(shown, short).alias("spans"), (F.size("s") - copied).alias("live"), copied.alias("copied"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    plain = [F.col(f"`{c}`") for c in kept]
    # only rows with candidates are shuffled
    some = table.filter(F.size("__found") > 0).drop("__found").join(rows, "__row", "left").select(*plain, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"), F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("copied", F.lit(0)).alias("copied"))
    return some.unionByName(table.filter(F.size("__found") <= 0).select(*plain, none.alias("base"), none.alias("spans"), F.lit(0).alias("live"), F.lit(0).alias("copied")))


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; no row is dropped."""
    name = {c: f"__c{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with the result's
    found = find_secrets(docs.toDF(*name.values()), name[text], name[owner], name[repository], keep_text=True)
    return spans.cut_out(found, name[text], "spans", mark).select(*[F.col(n).alias(c) for c, n in name.items()])
