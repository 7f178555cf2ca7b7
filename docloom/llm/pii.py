"""Personal data by gradient boosting over candidate spans, in SQL functions only.

Fixed patterns give the base spans of four kinds; those always stay. Wider generators propose further spans of each kind,
which may overlap: addresses whose signs are spelled out or spaced, numbers with other separators, without a country's
sign or of other lengths. Boosted trees then tell by format and context which proposals are personal data. What is
learned is not the base patterns' form. Base spans are the known positives and all other proposals are unlabelled, some
of them positive too; the features say what surrounds a span and how its digits or labels are grouped, and leave out all
that sets base spans apart by definition (signs and separators). Over the whole corpus positives and proposals are counted
for each combination of features, a number that the codes bound, and the trees are fitted to these counts.

Their probability of being a known positive becomes one of being personal data by division through its mean over the
known positives of the kind (which are a share of all positives, the same at all places); that mean is drawn to the one
over all kinds by a fixed number of rows, so that a kind of few known positives is judged too. A kind's threshold is the
lowest at which the proposals to be added are, by these probabilities, precise enough. Of accepted proposals that overlap
each other, of whatever kinds, the best stays, and none that overlaps a base span.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import scratch, spans

KINDS = ("email", "ip", "card", "phone")
# Patterns of the contract, with runs that are not tried again from their middle and never given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?[(\[{<] ?(?i:at|@) ?[)\]}>] ?| @ ?|@ )", r"(?:\.| ?[(\[{<] ?(?i:dot|\.) ?[)\]}>] ?)"
WIDE = {
    "email": [
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ (?i:at) [A-Za-z0-9-]++(?: (?i:dot) [A-Za-z0-9-]++)++",
    ],
    "ip": [
        r"(?<![0-9.])[0-9]{1,3}+(?: \.|\. | \. )[0-9]{1,3}+ ?\. ?[0-9]{1,3}+ ?\. ?[0-9]{1,3}+(?![0-9.])",
        r"(?<![0-9.])[0-9]{1,3}+(?: ?[(\[{] ?(?i:dot|\.) ?[)\]}] ?[0-9]{1,3}+){3}(?![0-9.])",
    ],
    "card": [
        r"(?<![0-9])[0-9]{4}(?:[./_\u2013-]| - ?|- )[0-9]{4}(?:[./_\u2013-]| - ?|- )[0-9]{4}(?:[./_\u2013-]| - ?|- )[0-9]{4}(?![0-9])",
        r"(?<![0-9])3[0-9]{3}[ ._-]?[0-9]{6}[ ._-]?[0-9]{5}(?![0-9])",
    ],
    "phone": [
        r"(?<![0-9+])(?:00 ?)?+[(]?[0-9]{1,4}+(?:[ ().-]{1,2}+[0-9]{2,5}+){2,5}+(?![0-9])",
        r"(?<![0-9+])[(]?0[0-9]{1,4}[)]?[ /.-]{1,2}[0-9](?:[ /.-]?[0-9]){4,10}(?![0-9])",
    ],
}
_HINT = {"email": r"mail|contact|write|reach|address", "ip": r"ip|addr\w*|host|server|client|node", "card": r"cards?|visa|credit|debit|pay\w*|mastercard", "phone": r"tel\w*|phone|call|fax|mobil\w*|cell|dial|whatsapp"}
_OTHER = r"orders?|id|ids|no|nr|numbers?|invoice|version|v|isbn|ref\w*|sku|parts?|serial|item|case|ticket|build|page|section|date|since|year"
#: Number of codes of each feature: how it is grouped, how long it is, whether its parts make sense, before, after, hint.
CODES = {"groups": 6, "size": 8, "sound": 2, "before": 5, "after": 5, "hint": 4}
_SPAN = "array<struct<kind:string,start:int,end:int>>"


def _each(function: Callable[[Column, str], Column], kind: str) -> Callable[[Column], Column]:
    """A function of one array element, for a fixed kind."""
    return lambda element: function(element, kind)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum of card numbers."""
    places = F.sequence(F.lit(1), F.length(digits))
    weighed = F.transform(places, lambda i: F.substring(digits, -i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    n = F.length(_digits(text))
    return F.when(n.between(16, 19), luhn(_digits(text))).otherwise(False) if kind == "card" else n.between(8, 15)


def _code(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]"), 1).when(text.rlike(r"^\p{L}"), 2).when(text.rlike(r"^[\"'=:(\[<]"), 3).when((text == "") | text.rlike(r"^\s"), 0).otherwise(4)


def features(kind: str, m: Column) -> Column:
    """Codes of a candidate's format and context, as a struct; none tells base spans from other proposals by definition."""
    t, digits = m["text"], _digits(m["text"])
    n = F.length(digits)
    words = F.regexp_replace(F.regexp_replace(t, r"(?i)[ (\[{<]+(?:at|@)[ )\]}>]+|@", "@"), r"(?i)[ (\[{<]+(?:dot|\.)[ )\]}>]+|\.", ".")
    labels = F.split(F.substring_index(words, "@", -1), "[.]")
    if kind == "email":
        groups, size, sound = F.size(labels), F.lit(0), F.element_at(labels, -1).rlike("^[A-Za-z]{2,6}$")
    else:
        parts = F.filter(F.split(t, "[^0-9]+"), lambda x: x != "")
        groups, size = F.size(parts), n
        sound = {"ip": valid("ip", F.array_join(parts, ".")), "card": F.when(n.between(13, 19), luhn(digits)).otherwise(False), "phone": n.between(8, 15)}[kind]
    hint = F.when(m["before"].rlike(rf"(?i)\b(?:{_HINT[kind]})(?:\W+\w+){{0,2}}\W*$"), 2).when(m["before"].rlike(rf"(?i)\b(?:{_OTHER})(?:\W+\w+)?\W*$"), 3).when(m["before"].rlike(r"[:=]\s*$"), 1)
    return F.struct(
        F.least(groups, F.lit(CODES["groups"] - 1)).alias("groups"),
        F.when(size < 4, 0).when(size < 8, 1).when(size < 10, 2).when(size < 12, 3).when(size < 16, 4).when(size == 16, 5).when(size < 20, 6).otherwise(7).alias("size"),
        F.coalesce(sound, F.lit(False)).cast("int").alias("sound"),
        _code(F.right(m["before"], F.lit(1))).alias("before"),
        _code(F.left(m["after"], F.lit(1))).alias("after"),
        F.coalesce(hint, F.lit(0)).alias("hint"),
    )


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``__base`` (sorted by kind as listed, then start), ``__known`` (kind and features of these) and ``__more`` (other proposals with features)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    gate = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9](?:[ -]?[0-9]){15}"), "phone": t.rlike(r"\+[0-9]")}
    wide_gate = {"email": t.rlike(r"(?i)[(\[{< ](?:at|@)[)\]}> ]|@ "), "ip": t.rlike(r"(?i)[0-9] ?[(\[{]? ?(?:\. |\.[)\]}]|dot)|[0-9] \."), "card": t.rlike("[0-9]{4}[ ./_\u2013-]{0,2}[0-9]{4}"), "phone": t.rlike(r"[0-9][ ().\/-]{1,2}[0-9]{2}")}
    raw, names = [], []
    for k in KINDS:
        for name, patterns, when in (("b", [BASE[k]], gate[k]), ("w", WIDE[k], wide_gate[k])):
            for i, pattern in enumerate(patterns):
                found, gaps = spans.find(t, pattern, when)
                names.append(f"{name}_{k}_{i}")
                raw += [found.alias(f"__{names[-1]}"), gaps.alias(f"__g_{names[-1]}")]
    df = docs.select(*kept, *raw)
    df = df.select(*kept, *[spans.placed(F.col(f"__{n}"), F.col(f"__g_{n}")).alias(f"__{n}") for n in names])
    base = [F.filter(f"__b_{k}_0", _each(lambda m, k: valid(k, m["text"]), k)).alias(f"__b_{k}_0") for k in KINDS]
    df = df.select(*kept, *base, *[f"__{n}" for n in names if n.startswith("w")])

    def more(k: str, column: str) -> Column:
        whole = BASE[k].replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "").replace("(?<![0-9])", "")
        own = F.filter(column, lambda m: ~(m["text"].rlike(f"^(?:{whole})$") & valid(k, m["text"])))
        return F.transform(own, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), features(k, m).alias("f")))

    tagged = F.concat(*[F.transform(f"__b_{k}_0", _each(lambda m, k: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end")), k)) for k in KINDS])
    known = F.concat(*[F.transform(f"__b_{k}_0", _each(lambda m, k: F.struct(F.lit(k).alias("kind"), features(k, m).alias("f")), k)) for k in KINDS])
    return df.select(*kept, tagged.cast(_SPAN).alias("__base"), known.alias("__known"), F.concat(*[more(n[2:-2], f"__{n}") for n in names if n.startswith("w")]).alias("__more"))


@dataclass
class Trees:
    """Boosted trees of two levels: (feature, bound, (feature, bound, low, high), (feature, bound, low, high))."""

    start: float
    trees: list[tuple]
    thresholds: dict[str, float]


def fit(cells: list[tuple[str, tuple[int, ...], int, int]], rounds: int = 40, rate: float = 0.4, precision: float = 0.9, prior: float = 20) -> Trees:
    """Fit to (kind, codes, base spans and other proposals, base spans); all kinds' known positives weigh ``prior`` rows in each kind."""
    rows = [((KINDS.index(k), *codes), n, hits) for k, codes, n, hits in cells]
    if not sum(r[2] for r in rows):
        return Trees(0.0, [], dict.fromkeys(KINDS, math.inf))
    total, good = sum(r[1] for r in rows), sum(r[2] for r in rows)
    start = math.log((good + 1) / (total - good + 1))
    scores, trees = [start] * len(rows), []
    tops = (len(KINDS), *CODES.values())

    def leaf(g: float, h: float) -> float:
        return rate * g / (h + 1.0)

    def split(members: list[int], grads: list[tuple[float, float]]) -> tuple[float, int, int]:
        g, h = sum(grads[i][0] for i in members), sum(grads[i][1] for i in members)
        best = (-1.0, 0, tops[0])
        for f, top in enumerate(tops):
            sums = [[0.0, 0.0] for _ in range(top)]
            for i in members:
                sums[rows[i][0][f]][0] += grads[i][0]
                sums[rows[i][0][f]][1] += grads[i][1]
            a = b = 0.0
            for bound in range(1, top):
                a, b = a + sums[bound - 1][0], b + sums[bound - 1][1]
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, f, bound)
        return best

    for _ in range(rounds):
        grads = []
        for (_, n, hits), s in zip(rows, scores):
            p = 1 / (1 + math.exp(-s))
            grads.append((hits - n * p, n * p * (1 - p)))
        everything = list(range(len(rows)))
        _, f, bound = split(everything, grads)
        sides = []
        for side in ([i for i in everything if rows[i][0][f] < bound], [i for i in everything if rows[i][0][f] >= bound]):
            _, f2, bound2 = split(side, grads)
            values = []
            for part in ([i for i in side if rows[i][0][f2] < bound2], [i for i in side if rows[i][0][f2] >= bound2]):
                value = leaf(sum(grads[i][0] for i in part), sum(grads[i][1] for i in part))
                values.append(value)
                for i in part:
                    scores[i] += value
            sides.append((f2, bound2, *values))
        trees.append((f, bound, *sides))
    chance = [1 / (1 + math.exp(-s)) for s in scores]  # of being a known positive
    common = sum(r[2] * c for r, c in zip(rows, chance)) / good
    thresholds = dict.fromkeys(KINDS, math.inf)
    for number, kind in enumerate(KINDS):
        own = [i for i, (codes, _, _) in enumerate(rows) if codes[0] == number]
        known = sum(rows[i][2] for i in own)
        share = (sum(rows[i][2] * chance[i] for i in own) + prior * common) / (known + prior)  # of all positives that are known
        seen = right = 0.0
        for i in sorted(own, key=lambda i: -scores[i]):
            more, personal = rows[i][1] - rows[i][2], min(1.0, chance[i] / share)
            seen, right = seen + more, right + more * personal
            if personal < 0.5 or right < precision * seen:
                break
            thresholds[kind] = scores[i] - 1e-6
    return Trees(start, trees, thresholds)


def score(trees: Trees, kind: Column, f: Column) -> Column:
    """Sum of the trees' leaves for a candidate, as a SQL expression."""
    number = F.coalesce(*[F.when(kind == k, i) for i, k in enumerate(KINDS)])
    codes = [number, *[f[name] for name in CODES]]
    total = F.lit(trees.start)
    for g, bound, low, high in trees.trees:
        low, high = (F.when(codes[s[0]] < s[1], F.lit(float(s[2]))).otherwise(float(s[3])) for s in (low, high))
        total = total + F.when(codes[g] < bound, low).otherwise(high)
    return total


def learn(scanned: DataFrame) -> Trees:
    """Count base spans and other proposals by their codes and fit the trees to the counts, whose number the codes bound."""
    base = F.transform("__known", lambda m, i: m.withField("start", F.col("__base")[i]["start"]).withField("end", F.col("__base")[i]["end"]))
    rows = [scanned.select("__row", F.explode(c).alias("m")).select("__row", "m.kind", "m.start", "m.end", "m.f", F.lit(known).alias("known")) for c, known in ((base, 1), ("__more", 0))]
    # a proposal that overlaps a base span, of whatever kind, is that span or part of it, and counts as neither
    reach, following = spans.around(["__row"], ["start", "known"], F.col("known") == 1)
    apart = (F.col("known") == 1) | ((F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end")))
    all_rows = rows[0].unionByName(rows[1]).withColumn("apart", apart).filter("apart").select("kind", "f.*", "known")
    cells = all_rows.groupBy("kind", *CODES).agg(F.count("*").alias("n"), F.sum("known").alias("hits")).orderBy("kind", *CODES).collect()
    return fit([(r["kind"], tuple(r[c] for c in CODES), r["n"], r["hits"]) for r in cells])


def find_pii(docs: DataFrame, text: str = "text", trees: Trees | None = None, keep_text: bool = False) -> DataFrame:
    """``docs`` (without ``text`` unless ``keep_text``) with ``base`` and ``spans`` (arrays of kind, start, end; by kind as listed, then start).

    ``spans`` holds all base spans and those added. Null texts have none. Repeated rows and null keys are rows like
    others, and an empty table gives none. Columns named base or spans are replaced.
    """
    kept = [c for c in docs.columns if c not in ("base", "spans") and (keep_text or c != text)]
    scanned = scan(docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text")), "__text")
    scanned = scratch.table(scanned.withColumn("__row", F.monotonically_increasing_id()), "pii")
    trees = trees or learn(scanned)
    threshold = lambda m: F.coalesce(*[F.when(m["kind"] == k, F.lit(v)) for k, v in trees.thresholds.items()], F.lit(math.inf))
    accepted = F.filter(F.transform("__more", lambda m: m.withField("score", score(trees, m["kind"], m["f"]) - threshold(m)).dropFields("f")), lambda m: m["score"] >= 0)
    judged = scanned.withColumn("__more", accepted)
    touched = judged.filter(F.size("__more") > 0)
    base = touched.select("__row", F.explode("__base").alias("m")).select("__row", "m.*", F.lit(math.inf).alias("score"))
    rows = touched.select("__row", F.explode("__more").alias("m")).select("__row", "m.*").unionByName(base)
    # spans that overlap, directly or through others, stand together; the best proposal stays unless there is a base span
    order = Window.partitionBy("__row").orderBy("start", F.desc("score"), "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", (F.coalesce(reach, F.lit(0)) <= F.col("start")).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.row_number().over(Window.partitionBy("__row", "island").orderBy(F.desc("score"), "start", "end", "kind"))
    added = rows.withColumn("place", best).filter((F.col("place") == 1) & (F.col("score") < math.inf))
    added = added.groupBy("__row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("__added"))
    plain = [F.col(f"`{c}`") for c in kept]
    rank = lambda s: F.coalesce(*[F.when(s["kind"] == k, i) for i, k in enumerate(KINDS)])
    keyed = F.transform(F.concat("__base", F.coalesce("__added", F.array().cast(_SPAN))), lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    # only rows with accepted proposals are shuffled
    some = touched.join(added, "__row", "left").select(*plain, F.col("__base").alias("base"), ordered.cast(_SPAN).alias("spans"))
    return some.unionByName(judged.filter(F.size("__more") <= 0).select(*plain, F.col("__base").alias("base"), F.col("__base").alias("spans")))


def redact(docs: DataFrame, text: str = "text", mark: str = "[private]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``."""
    name = {c: f"__c{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with the result's
    found = find_pii(docs.toDF(*name.values()), name[text], keep_text=True)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return spans.cut_out(found.withColumn("spans", by_start), name[text], "spans", mark).select(*[F.col(n).alias(c) for c, n in name.items()])
