"""Fidelity of a derived text to its source, and outcomes of model attempts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import content_words, for_comparison
from docloom.sources import shared


MANY = 200  # fixed value: from so many words on, those that are more than a hundredth of a text begin no block


def _runs(matches: DataFrame) -> DataFrame:
    """Each segment's runs of matches along a diagonal: where one begins, its length, and its best part of words that may begin a block."""
    diagonal = ["id", "alo", "blo", (F.col("i") - F.col("j")).alias("__d")]
    line = Window.partitionBy("id", "alo", "blo", F.col("i") - F.col("j")).orderBy("i")
    marked = matches.withColumn("run", F.col("i") - F.row_number().over(line))
    inner = Window.partitionBy("id", "alo", "blo", F.col("i") - F.col("j"), "often").orderBy("i")
    marked = marked.withColumn("part", F.when(~F.col("often"), F.col("i") - F.row_number().over(inner)))
    parts = marked.groupBy(*diagonal, "run", "part").agg(F.count("*").alias("n"), F.min("i").alias("i"), F.min("j").alias("j"))
    core = F.when(F.col("part").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("i").alias("i"), F.col("j").alias("j")))
    return parts.groupBy("id", "alo", "blo", "__d", "run").agg(F.sum("n").alias("size"), F.min("i").alias("i"), F.min("j").alias("j"), F.min(core).alias("core"))


def matching_words(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, matched): words in matching blocks of the word lists ``a`` and ``b``, for pairs that share a word.

    The longest block of equal words is taken, of several the one that begins first in ``a``, then in ``b``; then the same
    left and right of it, until nothing matches. In a list ``b`` of MANY words a frequent one begins no block but may
    extend one. All pairs go through a round together: what matches is a table of positions, a block is a run along a
    diagonal, and a round keeps the positions left and right of each segment's block. So rounds are as many as blocks are
    nested, not as there are pairs, and no text is a task of its own.
    """
    name = pairs.withColumn("id", F.struct(*key))
    left = name.select("id", F.posexplode(a).alias("i", "w"))
    right = name.select("id", F.size(b).alias("nb"), F.posexplode(b).alias("j", "w"))
    uses = right.groupBy("id", "w", "nb").agg(F.count("*").alias("uses")).select("id", "w", ((F.col("nb") >= MANY) & (F.col("uses") > F.floor(F.col("nb") / 100) + 1)).alias("often"))
    matches = left.join(right.select("id", "j", "w"), ["id", "w"]).join(uses, ["id", "w"]).select("id", F.lit(0).alias("alo"), F.lit(0).alias("blo"), "i", "j", "often")
    matches = shared.table(matches, "matches")
    done = []
    while matches.head(1):
        runs = _runs(matches)
        # without a word that may begin a block, one may still stand where the segment begins
        usable = runs.filter(F.col("core").isNotNull() | ((F.col("i") == F.col("alo")) & (F.col("j") == F.col("blo"))))
        order = F.struct(F.coalesce(F.col("core"), F.struct(F.lit(0).cast("long").alias("n"), F.col("i").alias("i"), F.col("j").alias("j"))).alias("core"), F.col("size"), F.col("i").alias("bi"), F.col("j").alias("bj"))
        best = shared.table(usable.groupBy("id", "alo", "blo").agg(F.min(order).alias("o")).select("id", "alo", "blo", "o.size", "o.bi", "o.bj"), "blocks")
        done.append(best)
        kept = matches.join(best, ["id", "alo", "blo"])
        before = (F.col("i") < F.col("bi")) & (F.col("j") < F.col("bj"))
        after = (F.col("i") >= F.col("bi") + F.col("size")) & (F.col("j") >= F.col("bj") + F.col("size"))
        place = lambda low, at: F.when(before, F.col(low)).otherwise((F.col(at) + F.col("size")).cast("int"))
        rest = shared.table(kept.filter(before | after).select("id", place("alo", "bi").alias("alo"), place("blo", "bj").alias("blo"), "i", "j", "often"), "matches")
        shared.drop(matches)
        matches = rest
    blocks = reduce(DataFrame.unionByName, done) if done else matches.select("id", F.lit(0).cast("long").alias("size"))
    return blocks.groupBy("id").agg(F.sum("size").alias("matched")).select("id.*", "matched")


def sequence_ratio(pairs: DataFrame, key: list[str], a: str, b: str, out: str = "ratio") -> DataFrame:
    """``pairs`` with twice the words in matching blocks over all words, in order; two empty lists are equal.

    ``key`` names columns that are not null and tell the pairs apart.
    """
    found = matching_words(pairs, key, a, b)
    words = F.size(a) + F.size(b)
    ratio = F.when(words == 0, 1.0).otherwise(2.0 * F.coalesce(F.col("matched"), F.lit(0)) / words)
    return pairs.join(found, key, "left").withColumn(out, ratio).drop("matched")


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct words over all; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def added_penalty(original: Column, derived: Column) -> Column:
    """1 up to 5 % of distinct words that the source lacks, then down to 0.4."""
    share = F.size(F.array_except(derived, original)) / F.greatest(F.size(F.array_distinct(original)), F.lit(1))
    return F.when(share > 0.05, F.greatest(F.lit(0.4), 1 - 3 * share)).otherwise(1.0)


def truncation_penalty(original: Column, derived: Column) -> Column:
    """1 from 80 % of the source's words on, else down to 0.3."""
    ratio = F.when(F.size(original) > 0, F.size(derived) / F.size(original)).otherwise(1.0)
    return F.when(ratio < 0.8, F.greatest(F.lit(0.3), 1 - 2 * (0.8 - ratio))).otherwise(1.0)


def fidelity(pairs: DataFrame, key: list[str], original: str, derived: str) -> DataFrame:
    """``pairs`` with jaccard, added, truncated, sequence and score = (0.7 sequence + 0.3 jaccard) x penalties; a null derived text scores 0."""
    w = pairs.withColumn("__o", content_words(F.col(original))).withColumn("__d", content_words(F.col(derived)))
    w = w.withColumns({"jaccard": jaccard(F.col("__o"), F.col("__d")), "added": added_penalty(F.col("__o"), F.col("__d")), "truncated": truncation_penalty(F.col("__o"), F.col("__d"))})
    w = sequence_ratio(w, key, "__o", "__d", "sequence")
    score = (0.7 * F.col("sequence") + 0.3 * F.col("jaccard")) * F.col("added") * F.col("truncated")
    return w.withColumn("score", F.when(F.col(derived).isNull(), 0.0).otherwise(score)).drop("__o", "__d")


def decide(scores: DataFrame, valid: str, score: str, threshold: float = 0.15) -> DataFrame:
    """``scores`` with is_valid and message: the structure holds and the score is at least 1 - threshold."""
    enough = F.col(score) >= 1 - threshold - 1e-12
    message = F.when(~F.col(valid), "invalid structure").when(~enough, "content differs").otherwise("ok")
    return scores.withColumn("is_valid", F.col(valid) & enough).withColumn("message", message)


def word_diff(pairs: DataFrame, original: str, derived: str) -> DataFrame:
    """``pairs`` with the distinct words that the derived text lacks and those it adds, sorted."""
    words = lambda c: F.array_distinct(F.filter(F.split(for_comparison(F.coalesce(F.col(c), F.lit(""))), " "), lambda w: w != ""))
    w = pairs.withColumn("__o", words(original)).withColumn("__d", words(derived))
    return w.withColumn("removed", F.array_sort(F.array_except("__o", "__d"))).withColumn("added", F.array_sort(F.array_except("__d", "__o"))).drop("__o", "__d")


def content_diff(original: Column, derived: Column) -> Column:
    """Unified diff of the texts cleaned for comparison, which are a line each; empty if they are equal."""
    a, b = for_comparison(F.coalesce(original, F.lit(""))), for_comparison(F.coalesce(derived, F.lit("")))
    span = lambda text: F.when(text == "", "0,0").otherwise("1")
    line = lambda sign, text: F.when(text != "", F.concat(F.lit("\n" + sign), text)).otherwise("")
    return F.when(a == b, "").otherwise(F.concat(F.lit("--- original\n+++ llm_extracted\n@@ -"), span(a), F.lit(" +"), span(b), F.lit(" @@"), line("-", a), line("+", b)))


def first_success(attempts: DataFrame, key: str, priority: str, model: str, output: str, success: str, tokens: str) -> DataFrame:
    """For each key the output and model of the successful attempt of lowest priority, the models tried up to it, and their tokens.

    Keys without success keep null output and model, and all attempts.
    """
    best = attempts.groupBy(key).agg(F.min(F.when(F.col(success), F.struct(priority, model, output))).alias("b"), F.array_sort(F.collect_list(F.struct(priority, model, tokens))).alias("all"))
    tried = F.filter("all", lambda a: F.col("b").isNull() | (a[priority] <= F.col(f"b.{priority}")))
    return best.select(key, F.col(f"b.{model}").alias("model"), F.col(f"b.{output}").alias("output"), F.transform(tried, lambda a: a[model]).alias("attempts"), F.aggregate(tried, F.lit(0).cast("long"), lambda s, a: s + a[tokens].cast("long")).alias("tokens"))


def with_fallback(texts: DataFrame, corrected: DataFrame, key: str, text: str) -> DataFrame:
    """``texts`` with the corrected output where there is one, else the text itself, model 'none' and 0 tokens."""
    good = corrected.filter(F.col("output").isNotNull()).select(key, "output", F.col("model").alias("__m"), F.col("tokens").alias("__t"))
    joined = texts.join(good, key, "left")
    return joined.withColumn(text, F.coalesce("output", text)).withColumn("model_used", F.coalesce("__m", F.lit("none"))).withColumn("tokens_used", F.coalesce("__t", F.lit(0).cast("long"))).drop("output", "__m", "__t")
