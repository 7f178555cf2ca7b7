"""Text cleaning, repair, routing and measuring, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Length buckets as (upper bound, label) from one character on.
LENGTH_BUCKETS = (
    (500, "1-499 chars"), (1000, "500-999 chars"), (2000, "1K-2K chars"), (3000, "2K-3K chars"), (5000, "3K-5K chars"), (7500, "5K-7.5K chars"),
    (10000, "7.5K-10K chars"), (15000, "10K-15K chars"), (20000, "15K-20K chars"), (30000, "20K-30K chars"), (50000, "30K-50K chars"),
    (75000, "50K-75K chars"), (100000, "75K-100K chars"), (150000, "100K-150K chars"), (200000, "150K-200K chars"), (None, "200K+ chars"),
)
NO_TEXT, EMPTY = "No text", "Empty (0 chars)"
BUCKET_ORDER = (NO_TEXT, EMPTY, *(label for _, label in LENGTH_BUCKETS))
# Single characters repaired, and those that become several.
REPAIRS = {"—": "-", "–": "-", "―": "-", "−": "-", "´": "'", "`": "'", "º": "°", "À": "Á", "à": "á", "È": "É", "è": "é", "Ì": "Í", "ì": "í", "Ò": "Ó", "ò": "ó", "Ù": "Ú", "ù": "ú"}
LONG_REPAIRS = {"…": "..."}
STRAIGHT_QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'"}
UNICODE_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Tags that break lines, and those after which a space stands.
BLOCK_TAGS = ("p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "nav", "aside", "blockquote", "pre", "hr", "ul", "ol", "li", "dl", "dt", "dd")
INLINE_TAGS = ("b", "i", "em", "strong", "span", "a", "u", "sub", "sup", "code", "kbd", "samp", "var", "small", "big", "tt")
ENTITIES = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}  # & last: it must not make new entities
_BLANKS = r"[\p{Zs}\p{Cc}\p{Cf}\p{Co}]"  # spaces, controls, format and private characters
BLANK, ODD_BLANK = rf"[[^!-~\n]&&{_BLANKS}]", rf"[[^ -~\n]&&{_BLANKS}]"  # those but line breaks, and those that are no plain space


def primary_text(updated: Column, original: Column) -> Column:
    """Updated text if not null, else the original; an empty string counts as present."""
    return F.coalesce(updated, original)


def text_source(updated: Column, original: Column, names: tuple[str, str] = ("texto_norma_actualizado", "texto_norma")) -> Column:
    return F.when(updated.isNotNull(), names[0]).when(original.isNotNull(), names[1]).otherwise("no_text")


def length_bucket(n: Column) -> Column:
    """Label of a length; null is no text."""
    out = F.when(n.isNull(), NO_TEXT).when(n == 0, EMPTY)
    for bound, label in LENGTH_BUCKETS:
        out = out.otherwise(label) if bound is None else out.when(n < bound, label)
    return out


def bucket_rank(label: Column) -> Column:
    """Place of a bucket label in the report, from 1."""
    return F.array_position(F.array(*map(F.lit, BUCKET_ORDER)), label).cast("int")


def strip(text: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def is_valid(text: Column, least: int = 10) -> Column:
    """Non-null and more than ``least`` characters without the white space around."""
    return F.coalesce(F.length(strip(text)) > least, F.lit(False))


def blank_to_null(text: Column) -> Column:
    return F.when(strip(text) != "", text)


def summary_or_title(summary: Column, title: Column) -> Column:
    """The summary, or the title where the summary is blank and the title is not."""
    return F.coalesce(blank_to_null(summary), blank_to_null(title), summary)


def route(updated: Column, original: Column, summary: Column) -> Column:
    """Which field of a record goes on: updated_text, original_text, summary_only or no_valid_text."""
    return F.when(is_valid(updated), "updated_text").when(is_valid(original), "original_text").when(is_valid(summary), "summary_only").otherwise("no_valid_text")


def repair(text: Column, straight_quotes: bool = False) -> Column:
    """Characters that recognition often gets wrong replaced; curly quotes only on request."""
    single = REPAIRS | (STRAIGHT_QUOTES if straight_quotes else {})
    out = F.translate(text, "".join(single), "".join(single.values()))
    for old, new in LONG_REPAIRS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def repair_counts(text: Column) -> Column:
    """array<struct<char, n>> of the repairable characters that occur."""
    each = F.array(*[F.struct(F.lit(c).alias("char"), (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("long").alias("n")) for c in (*REPAIRS, *LONG_REPAIRS)])
    return F.filter(each, lambda r: r["n"] > 0)


def fix_double_encoding(text: Column) -> Column:
    """An NBSP that was encoded twice becomes one."""
    return F.replace(text, F.lit("\u00c2\u00a0"), F.lit("\u00a0"))


def normalize_whitespace(text: Column) -> Column:
    """Unicode spaces and controls become spaces, runs collapse within lines, at most one empty line stays."""
    out = F.regexp_replace(text, rf"(?: {BLANK}|{ODD_BLANK}){BLANK}*+", " ")  # single spaces are passed over
    out = F.regexp_replace(out, r" ?+(\n) ?+(?:(\n) ?+)?+(?:\n ?+)*+", "$1$2")
    return F.btrim(out, F.lit(" \n"))


def html_to_text(html: Column, keep_noncontent: bool = False) -> Column:
    """Markup to text: a line break at either end of block tags, a space after inline ones, entities decoded.

    Then whitespace, then repairs. Comments, doctype, script and style go, unless ``keep_noncontent`` leaves the text of
    scripts and styles.
    """
    plain = fix_double_encoding(html)
    out = F.regexp_replace(plain, r"(?s)<!--.*?-->|<![^>]*>", "")
    if not keep_noncontent:
        out = F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?:[ \t\n/][^>]*)?>", "\n")
    out = F.regexp_replace(out, rf"(?i)</(?:{'|'.join(INLINE_TAGS)})[ \t\n]*>", " ")
    out = F.regexp_replace(out, r"</?[A-Za-z][^>]*>", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.when(html.contains("<") | html.contains("&"), out).otherwise(plain)  # most texts have no markup
    return repair(normalize_whitespace(out))


def purify(html: Column) -> Column:
    """Clean text, or null where nothing is left."""
    once = F.transform(F.array(html_to_text(html)), lambda t: F.when(t != "", t))  # the text is used twice, but made once
    return F.when(strip(html) != "", F.element_at(once, 1))


class _Structured(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in ("script", "style")
        if tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_endtag(tag) if tag in BLOCK_TAGS else None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCK_TAGS:
            self.parts.append("\n")
        elif tag in INLINE_TAGS:
            self.parts.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


@F.udf(StringType(), useArrow=False)  # a hundred pages at a time; an Arrow batch would hold ten thousand
def _parsed(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Structured()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)


def html_to_text_exact(html: Column) -> Column:
    """Like :func:`html_to_text`, by a parser that knows all entities and unclosed tags."""
    return repair(normalize_whitespace(_parsed(fix_double_encoding(html))))


def lenient_date(text: Column) -> Column:
    """ISO date or timestamp (``Z`` too) to a date, else null."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")).cast("date"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def strict_date(text: Column) -> Column:
    """``yyyy-MM-dd`` to a date, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def number_or(text: Column, default: int = -1) -> Column:
    """Trimmed text as an int, ``default`` where it isn't one."""
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(default))


def unfence(text: Column) -> Column:
    """Content of a fenced JSON block, or the text itself, trimmed."""
    return strip(F.regexp_replace(strip(text), r"(?s)^```(?:json)?[ \n]*|[ \n]*```$", ""))


def content_words(text: Column) -> Column:
    """Lower-case words without article headers, bare numbers, dashes, single characters and one trailing sign."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike(r"^(?:art[ií]culo|art\.|[0-9]+[°.]*|[-–—]+)$"))
    cleaned = F.transform(kept, lambda w: F.regexp_replace(w, r"[^a-z0-9_áéíóúüñàèìòùâêîôûäëïöçß]$", ""))
    return F.filter(cleaned, lambda w: w != "")


def for_comparison(text: Column) -> Column:
    """Lower case without headings, rules and degree signs, white space collapsed."""
    out = F.regexp_replace(F.lower(text), r"^texto norma(?: actualizado)?:[ \t-\r]*", "")
    out = F.regexp_replace(out, r"[ \t-\r]+", " ")
    out = F.regexp_replace(out, r"-{2,}", "")
    return F.trim(F.regexp_replace(out, r"[°.][ ]*", " "))


def node_text(title: Column, body: Column) -> Column:
    """Text of a division to embed: title and body, trimmed; null if blank."""
    return F.nullif(F.trim(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(body, F.lit("")))), F.lit(""))


def token_estimate(text: Column, overhead: int = 0) -> Column:
    return (F.floor(F.length(text) / 3) + overhead).cast("long")


def brief(text: Column, most: int = 200) -> Column:
    """First ``most`` characters, with dots if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def coalesce_fields(names: Sequence[str]) -> Column:
    """First of the columns that isn't blank."""
    return F.coalesce(*[blank_to_null(F.col(n)) for n in names])
