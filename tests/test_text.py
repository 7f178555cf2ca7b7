import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("exact", [False, True])
def test_html(spark, exact):
    convert = T.html_to_text_exact if exact else T.html_to_text
    html = "<!DOCTYPE html><div>Uno<b>dos <i>tres</i></b>fin<br/>x\u00c2\u00a0y</div><script>no()</script><!-- no --><p>&lt;a&gt; &amp;amp; \u201cq\u201d \u200bz</p>\n\n\n\n\n<p>a\t\t b</p>"
    assert one(spark, html, convert) == "Unodos tres fin\nx y\n\n<a> &amp; \u201cq\u201d z\n\na b"
    assert one(spark, None, convert) is None


def test_whitespace_is_idempotent(spark):
    raw = " a\u00a0\u2003b \n \n\n\n c\u0007d \t "
    once = one(spark, raw, T.normalize_whitespace)
    assert once == "a b\n\nc d"
    assert one(spark, once, T.normalize_whitespace) == once


def test_repair(spark):
    assert one(spark, "a—b–c … nº `x´ àÙ “q”", T.repair) == "a-b-c ... n° 'x' áÚ “q”"
    assert one(spark, "“q” ‘r’", lambda c: T.repair(c, straight_quotes=True)) == "\"q\" 'r'"
    assert {(r["char"], r["n"]) for r in one(spark, "——à", T.repair_counts)} == {("—", 2), ("à", 1)}


@pytest.mark.parametrize(("text", "number"), [("5", 5), (" 5 ", 5), ("+7", 7), ("5 bis", -1), ("", -1), (None, -1)])
def test_numbers(spark, text, number):
    assert one(spark, text, T.number_or) == number


def test_buckets(spark):
    sizes = [None, 0, 1, 499, 500, 199_999, 200_000]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long").select("i", T.length_bucket(F.col("n")).alias("b")).withColumn("r", T.bucket_rank(F.col("b"))).orderBy("i").collect()
    assert [r["b"] for r in rows] == ["No text", "Empty (0 chars)", "1-499 chars", "1-499 chars", "500-999 chars", "150K-200K chars", "200K+ chars"]
    assert [r["r"] for r in rows] == [1, 2, 3, 3, 4, 17, 18]


def test_words(spark):
    assert one(spark, "Artículo 5° — El texto, (nuevo) 12. y fin.", T.content_words) == ["el", "texto", "(nuevo", "fin"]
    assert one(spark, "```json\n{\"a\": 1}\n```", T.unfence) == '{"a": 1}'


def test_exact_pages_are_parsed_in_small_batches():
    from pyspark.util import PythonEvalType

    assert T._parsed.evalType == PythonEvalType.SQL_BATCHED_UDF  # no Arrow batch of ten thousand pages
