"""Profiles, samples, listings, cleaning and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import profile, sampling
from docloom.plans.registry import query
from docloom.plans.views import NORMAS, normas, table

_CASES = "\n".join(f"when character_count < {bound} then '{label}'" for bound, label in T.LENGTH_BUCKETS if bound) + "\nelse '200K+ chars' end"
_RANKS = "case character_range " + " ".join(f"when '{label}' then {i}" for i, label in enumerate(T.BUCKET_ORDER, 1)) + " end"
LENGTHS = f"""{NORMAS},
text_lengths as (select infoleg_id, titulo_sumario, length(coalesce(texto_norma_actualizado, texto_norma)) character_count,
  case when texto_norma_actualizado is not null then 'texto_norma_actualizado' when texto_norma is not null then 'texto_norma' else 'no_text' end text_source from normas),
categorized as (select *, case when text_source = 'no_text' then 'No text' when character_count = 0 then 'Empty (0 chars)' {_CASES} character_range from text_lengths)"""
_DISTRIBUTION = f"""select character_range, count(*) norm_count, round(count(*) * 100.0 / sum(count(*)) over (), 2) percentage, min(character_count) min_chars, max(character_count) max_chars,
  round(avg(character_count), 0) avg_chars, {_RANKS} bucket_order from categorized"""


@query("p1_primary_text", f"with {LENGTHS} select infoleg_id, character_count, text_source from categorized")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    return profile.with_length(normas(spark, sf)).select("infoleg_id", "character_count", "text_source")


@query("p2_length_bucket", f"with {LENGTHS} select infoleg_id, character_range from categorized")
def p2(spark: SparkSession, sf: str) -> DataFrame:
    return profile.with_length(normas(spark, sf)).select("infoleg_id", "character_range")


@query("p3_bucket_order", f"with {LENGTHS} select distinct character_range, {_RANKS} bucket_order from categorized")
def p3(spark: SparkSession, sf: str) -> DataFrame:
    buckets = profile.with_length(normas(spark, sf)).select("character_range").distinct()
    return buckets.withColumn("bucket_order", T.bucket_rank(F.col("character_range"))).orderBy("bucket_order")


@query("p4_one_title", f"with {NORMAS} select infoleg_id, titulo_sumario from normas where titulo_sumario = 'FR' order by 1")
def p4(spark: SparkSession, sf: str) -> DataFrame:
    return profile.titled(normas(spark, sf), ["FR"])


@query("p5_titles", f"with {NORMAS} select infoleg_id, titulo_sumario from normas where titulo_sumario in ('DE', 'ES') order by 1")
def p5(spark: SparkSession, sf: str) -> DataFrame:
    return profile.titled(normas(spark, sf), ["DE", "ES"])


@query("p6_one_size", f"with {LENGTHS} select infoleg_id, coalesce(character_count, 0) character_count, text_source from categorized where infoleg_id = 9")
def p6(spark: SparkSession, sf: str) -> DataFrame:
    return profile.size_of(normas(spark, sf), 9)


_SPACE = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


@query("p7_valid_text", f"with {NORMAS} select infoleg_id, coalesce(length(trim(texto_norma, {_SPACE})) > 10, false) valid, coalesce(length(trim(texto_resumido, {_SPACE})) > 10, false) valid_summary from normas")
def p7(spark: SparkSession, sf: str) -> DataFrame:
    return normas(spark, sf).select("infoleg_id", T.is_valid(F.col("texto_norma")).alias("valid"), T.is_valid(F.col("texto_resumido")).alias("valid_summary"))


_SUMMARY = f"coalesce(case when trim(texto_resumido, {_SPACE}) <> '' then texto_resumido end, case when trim(titulo_resumido, {_SPACE}) <> '' then titulo_resumido end, texto_resumido)"


@query("p8_summary_fallback", f"with {NORMAS} select infoleg_id, {_SUMMARY} summary from normas")
def p8(spark: SparkSession, sf: str) -> DataFrame:
    return normas(spark, sf).select("infoleg_id", T.summary_or_title(F.col("texto_resumido"), F.col("titulo_resumido")).alias("summary"))


@query(
    "p9_route",
    f"""with {NORMAS} select infoleg_id, case when length(trim(texto_norma_actualizado, {_SPACE})) > 10 then 'updated_text' when length(trim(texto_norma, {_SPACE})) > 10 then 'original_text'
  when length(trim({_SUMMARY}, {_SPACE})) > 10 then 'summary_only' else 'no_valid_text' end primary_field from normas""",
)
def p9(spark: SparkSession, sf: str) -> DataFrame:
    summary = T.summary_or_title(F.col("texto_resumido"), F.col("titulo_resumido"))
    return normas(spark, sf).select("infoleg_id", T.route(F.col("texto_norma_actualizado"), F.col("texto_norma"), summary).alias("primary_field"))


def _replaced(text: str, pairs: dict[str, str]) -> str:
    for old, new in pairs.items():
        text = f"replace({text}, '{old}', '{new.replace(chr(39), chr(39) * 2)}')"
    return text


def _sql_repair(text: str) -> str:
    single = "".join(T.REPAIRS.values()).replace("'", "''")
    return _replaced(f"translate({text}, '{''.join(T.REPAIRS)}', '{single}')", T.LONG_REPAIRS)


def _sql_spaces(text: str) -> str:
    out = f"translate({text}, '{T.UNICODE_SPACES}', '{' ' * len(T.UNICODE_SPACES)}')"
    for pattern, new in ((r"[\x00-\x09\x0b-\x1f\x7f-\x9f]|\p{Cf}|\p{Co}", "' '"), (" +", "' '"), (" ?\\n ?", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), ("^[ \\n]+|[ \\n]+$", "''")):
        out = f"regexp_replace({out}, '{pattern}', {new}, 'g')"
    return out


def _sql_html(text: str) -> str:
    out = f"replace({text}, chr(194) || chr(160), chr(160))"
    blocks, inline = "|".join(T.BLOCK_TAGS), "|".join(T.INLINE_TAGS)
    for pattern, new in (
        ("(?s)<!--.*?-->|<![^>]*>", "''"),
        ("(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "''"),
        (f"(?i)</?(?:{blocks})(?:[ \\t\\n/][^>]*)?>", "chr(10)"),
        (f"(?i)</(?:{inline})[ \\t\\n]*>", "' '"),
        ("</?[A-Za-z][^>]*>", "''"),
    ):
        out = f"regexp_replace({out}, '{pattern}', {new}, 'g')"
    out = _replaced(out, {e: c for e, c in T.ENTITIES.items()})
    return _sql_repair(_sql_spaces(out))


@query("p10_html_to_text", f"select page_id, {_sql_html('html')} as clean from pages")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("clean"))


@query("p10_html_exact")
def p10_exact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.html_to_text_exact(F.col("html")).alias("clean"))


@query("p11_repair", f"select doc_id, {_sql_repair('text')} repaired from documents")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.repair(F.col("text")).alias("repaired"))


@query("p12_whitespace", f"select page_id, {_sql_spaces('html')} as clean from pages")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.normalize_whitespace(F.col("html")).alias("clean"))


@query("p13_double_encoding", "select page_id, length(replace(replace(html, ' ', chr(194) || chr(160)), chr(194) || chr(160), chr(160))) n from pages")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    twice = F.replace(F.col("html"), F.lit(" "), F.lit("\u00c2\u00a0"))  # as a page looks whose spaces were encoded twice
    return table(spark, sf, "pages").select("page_id", F.length(T.fix_double_encoding(twice)).cast("long").alias("n"))


_CHARS = ", ".join(f"('{c}')" for c in (*T.REPAIRS, *T.LONG_REPAIRS))


@query("p14_repair_counts", f"""select "char", sum(length(text) - length(replace(text, "char", ''))) n, count(*) docs from documents, (values {_CHARS}) v("char") where contains(text, "char") group by 1""")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    each = table(spark, sf, "documents").select(F.explode(T.repair_counts(F.col("text"))).alias("r"))
    return each.groupBy("r.char").agg(F.sum("r.n").alias("n"), F.count("*").alias("docs"))


@query("p15_purify", f"with {NORMAS} " + "select infoleg_id, " + ", ".join(f"case when trim({c}, {_SPACE}) <> '' then nullif({_sql_html(c)}, '') end {c}" for c in ("texto_norma", "texto_norma_actualizado", "texto_resumido")) + " from normas")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    return normas(spark, sf).select("infoleg_id", *[T.purify(F.col(c)).alias(c) for c in ("texto_norma", "texto_norma_actualizado", "texto_resumido")])


@query(
    "p16_dates",
    """with raw as (select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d') when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when 2 then strftime(ts, '%Y-%m-%d %H:%M:%S') else event_type end t, ts from events)
  select event_id, case when event_id % 4 < 3 then cast(ts as date) end parsed, case when event_id % 4 = 0 then cast(ts as date) end strict from raw""",
)
def p16(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("case event_id % 4 when 0 then date_format(ts, 'yyyy-MM-dd') when 1 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") when 2 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') else event_type end")
    rows = table(spark, sf, "events").select("event_id", raw.alias("t"))
    return rows.select("event_id", T.lenient_date(F.col("t")).alias("parsed"), T.strict_date(F.col("t")).alias("strict"))


@query(
    "p19_unfence",
    r"""select conv_id, turn, json_extract_string(trim(regexp_replace(trim(concat('```json', chr(10), '{"role": "', role, '", "turn": ', turn, '}', chr(10), '```')), '(?s)^```(?:json)?[ \n]*|[ \n]*```$', '', 'g')), '$.role') role from conversations""",
)
def p19(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.concat(F.lit('```json\n{"role": "'), "role", F.lit('", "turn": '), F.col("turn").cast("string"), F.lit("}\n```"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.get_json_object(T.unfence(answer), "$.role").alias("role"))


SQL_WORDS = r"""list_filter(list_transform(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[ \t-\r]+'),
  lambda w: length(w) > 1 and not regexp_matches(w, '^(?:art[ií]culo|art\.|[0-9]+[°.]*|[-–—]+)$')), lambda w: regexp_replace(w, '[^a-z0-9_áéíóúüñàèìòùâêîôûäëïöçß]$', '')), lambda w: w <> '')"""


@query("p20_content_words", f"select doc_id, len({SQL_WORDS.format('text')}) n, md5(array_to_string({SQL_WORDS.format('text')}, ' ')) digest from documents")
def p20(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select("doc_id", T.content_words(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(
    "p21_for_comparison",
    r"""select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('Texto Norma: ' || text), '^texto norma(?: actualizado)?:[ \t-\r]*', ''), '[ \t-\r]+', ' ', 'g'), '-{2,}', '', 'g'), '[°.][ ]*', ' ', 'g'), ' ')) digest from documents""",
)
def p21(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.for_comparison(F.concat(F.lit("Texto Norma: "), "text"))).alias("digest"))


@query("p26_document_text", f"with {NORMAS} select infoleg_id, md5(coalesce(case when trim(texto_norma_actualizado, {_SPACE}) <> '' then texto_norma_actualizado end, case when trim(texto_norma, {_SPACE}) <> '' then texto_norma end)) body, case when trim(texto_resumido, {_SPACE}) <> '' then texto_resumido end summary from normas")
def p26(spark: SparkSession, sf: str) -> DataFrame:
    return normas(spark, sf).select("infoleg_id", F.md5(T.coalesce_fields(["texto_norma_actualizado", "texto_norma"])).alias("body"), T.blank_to_null(F.col("texto_resumido")).alias("summary"))


@query("p29_token_estimate", "select conv_id, turn, cast(length(text) // 3 + 500 as bigint) tokens, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end brief from conversations")
def p29(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text"), 500).alias("tokens"), T.brief(F.col("text")).alias("brief"))


@query("a1_length_distribution", f"with {LENGTHS} {_DISTRIBUTION} group by character_range order by bucket_order")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return profile.length_distribution(normas(spark, sf))


def _shares(column: str) -> str:
    return f"with {NORMAS} select coalesce({column}, 'NULL') {column}, count(*) norm_count, round(count(*) * 100.0 / sum(count(*)) over (), 2) percentage from normas group by 1"


@query("a2_by_type", _shares("tipo_norma"))
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return profile.count_by(normas(spark, sf), "tipo_norma")


@query("a3_by_title", _shares("titulo_sumario"))
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return profile.count_by(normas(spark, sf), "titulo_sumario")


@query("a4_title_distribution", f"with {LENGTHS} {_DISTRIBUTION} where titulo_sumario = 'EN' group by character_range")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return profile.length_distribution(normas(spark, sf).filter("titulo_sumario = 'EN'"))


_QUOTAS = ", ".join(f"('{k}', {v})" for k, v in sampling.LENGTH_QUOTAS.items())


@query("w5_length_sample", f"with {LENGTHS}, ranked as (select *, row_number() over (partition by character_range order by infoleg_id) rn from categorized) select infoleg_id, character_range, character_count from ranked join (values {_QUOTAS}) q(k, n) on k = character_range where rn <= n")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    rows = profile.with_length(normas(spark, sf)).select("infoleg_id", "character_range", "character_count")
    return sampling.by_quota(rows, "character_range", sampling.LENGTH_QUOTAS, [F.col("infoleg_id")])


@query("w6_one_of_each", f"with {LENGTHS} select infoleg_id, character_range from categorized qualify row_number() over (partition by character_range order by md5(infoleg_id || 'seed')) = 1")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    rows = profile.with_length(normas(spark, sf)).select("infoleg_id", "character_range")
    return sampling.by_quota(rows, "character_range", dict.fromkeys(T.BUCKET_ORDER, 1), [sampling.shuffled(F.col("infoleg_id"), "seed")])


_TYPES = {"src0": 5, "src1": 2} | {f"src{i}": 1 for i in range(2, 20)}


@query(
    "w7_type_sample",
    f"with {NORMAS} select infoleg_id, tipo_norma from normas join (values {', '.join(f'({chr(39)}{k}{chr(39)}, {v})' for k, v in _TYPES.items())}) q(k, n) on k = tipo_norma qualify row_number() over (partition by tipo_norma order by infoleg_id) <= n",
)
def w7(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.by_quota(normas(spark, sf).select("infoleg_id", "tipo_norma"), "tipo_norma", _TYPES, [F.col("infoleg_id")])


@query("w9_listing", f"with {NORMAS} select infoleg_id, tipo_norma, (select count(*) from normas where jurisdiccion = 'Nacional') total from normas where jurisdiccion = 'Nacional' order by infoleg_id limit 50")
def w9(spark: SparkSession, sf: str) -> DataFrame:
    rows = normas(spark, sf).select("infoleg_id", "tipo_norma", "jurisdiccion")
    return sampling.listing(rows, {"jurisdiccion": "Nacional", "tipo_norma": None}, "infoleg_id", 50, ("jurisdiccion",))


@query("w10_distinct_ids", "select distinct try_cast(case when event_id % 7 = 0 then event_type else cast(user_id as varchar) end as bigint) source_id from events where event_id % 7 <> 0")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "events").selectExpr("case when event_id % 7 = 0 then event_type else cast(user_id as string) end source_id")
    return sampling.distinct_ids(hits, "source_id")


@query("w11_by_id", f"with {NORMAS} select * from normas where infoleg_id = 12")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    return normas(spark, sf).filter("infoleg_id = 12")


@query("s11_scan", f"with {NORMAS} select infoleg_id, tipo_norma, titulo_sumario, titulo_resumido, jurisdiccion, publicacion from normas")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    return normas(spark, sf).select("infoleg_id", "tipo_norma", "titulo_sumario", "titulo_resumido", "jurisdiccion", "publicacion")
