"""Places of regular-expression matches, in SQL functions only.

Spark returns the matches of a pattern but not where they are. They follow from the texts between them: a match starts
where the lengths of all that stands before it end. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = 512
_CUT = 1024


def running_sums(lengths: Column) -> Column:
    """Array of sums of the first 1, 2, ... entries; summed by blocks, so the work grows about linearly."""
    return _running(lengths, lambda a, x: a + x)


def running_max(values: Column) -> Column:
    """Array of the largest of the first 1, 2, ... entries, which are not negative."""
    return _running(values, lambda a, x: F.greatest(a, x))


def _running(lengths: Column, add: Callable[[Column, Column], Column]) -> Column:
    size = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(_BLOCK)), lambda at: F.slice(lengths, at + 1, _BLOCK))
    total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), add))
    before = F.aggregate(total, F.array(F.lit(0)), lambda a, x: F.array_append(a, add(F.element_at(a, -1), x)))
    own = F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, start: F.slice(F.aggregate(b, F.array(start), lambda a, x: F.array_append(a, add(F.element_at(a, -1), x))), 2, _BLOCK))
    return F.flatten(own)


def placed(found: Column, gaps: Column) -> Column:
    """Matches and the texts around them -> array<struct<start, end, text, before, after>>.

    ``before`` and ``after`` are up to 24 and 2 characters between this match and its neighbours.
    """
    n = F.size(found)
    steps = F.zip_with(found, F.slice(gaps, 1, n), lambda m, g: F.length(m) + F.length(g))
    ends = running_sums(steps)
    around = F.zip_with(F.slice(gaps, 1, n), F.slice(gaps, 2, n), lambda b, a: F.struct(F.right(b, F.lit(24)).alias("before"), F.left(a, F.lit(2)).alias("after")))
    both = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("text")))
    joined = F.zip_with(both, around, lambda m, a: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), a["before"].alias("before"), a["after"].alias("after")))
    return F.when(n > 0, joined).otherwise(F.array().cast("array<struct<start:int,end:int,text:string,before:string,after:string>>"))


def find(text: Column, pattern: str, when: Column | None = None) -> tuple[Column, Column]:
    """All matches of ``pattern`` and the texts between them, to select before :func:`placed`; none unless ``when``."""
    none = F.array().cast("array<string>")
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return (found, gaps) if when is None else (F.when(when, found).otherwise(none), F.when(when, gaps).otherwise(none))


def around(group: list[str], order: list[str], chosen: Column) -> tuple[Column, Column]:
    """For rows of spans (start, end): the largest end of the chosen ones before, and the least start of those after.

    Both are running aggregates, the second in reverse order, so that the work grows with the rows of a group.
    """
    forth = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return F.max(F.when(chosen, F.col("end"))).over(forth), F.min(F.when(chosen, F.col("start"))).over(back)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs with these fields, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def cut_out(df: DataFrame, text: str, spans: str, mark: str) -> DataFrame:
    """``df`` with the union of ``spans``, sorted by start, replaced by ``mark`` in ``text``.

    The union follows from the running maximum of the ends. What stays is taken from the text's blocks of 1,024
    characters, so that no piece is looked for from the text's start and the work grows with text and spans.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    some = F.size(spans) > 0
    none = F.array().cast("array<string>")
    parts = df.select(
        *cols,
        F.when(some, F.regexp_extract_all(F.col(f"`{text}`"), F.lit("(?s).{1,%d}" % _CUT), F.lit(0))).otherwise(none).alias("__blocks"),
        F.transform(spans, lambda s: s["start"]).alias("__starts"),
        running_max(F.transform(spans, lambda s: s["end"])).alias("__reach"),
    )
    first = F.transform("__starts", lambda s, i: F.when((i == 0) | (F.try_element_at("__reach", F.greatest(i, F.lit(1))) < s), s))
    last = F.transform("__reach", lambda e, i: F.when((i + 1 == F.size("__reach")) | (e < F.try_element_at("__starts", i + 2)), e))
    given = lambda values: F.filter(values, lambda v: v.isNotNull())
    parts = parts.select(*cols, "__blocks", F.concat(F.array(F.lit(0)), given(last)).alias("__from"), F.concat(given(first), F.array(F.length(f"`{text}`"))).alias("__to"))

    def piece(a: Column, z: Column) -> Column:
        i, j = F.floor(a / _CUT).cast("int"), F.floor((z - 1) / _CUT).cast("int")
        block = lambda k: F.coalesce(F.try_element_at("__blocks", k + 1), F.lit(""))
        one = F.substring(block(i), a - i * _CUT + 1, z - a)
        more = F.concat(F.substring(block(i), a - i * _CUT + 1, F.lit(_CUT)), F.array_join(F.slice("__blocks", i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(block(j), F.lit(1), z - j * _CUT))
        return F.when(z <= a, "").when(i == j, one).otherwise(more)

    cut = F.array_join(F.zip_with("__from", "__to", piece), mark)
    return parts.select(*[F.when(some, cut).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
