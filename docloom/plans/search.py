"""Vector and keyword search, context, and fidelity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import ann, embed, keywords, search, verify
from docloom.plans import views
from docloom.plans.corpus import SQL_WORDS
from docloom.plans.registry import query
from docloom.plans.views import ARTICLES, DIVISIONS, NORMAS, table
from docloom.sources import records, shared


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _first(spark: SparkSession, sf: str) -> list[float]:
    return _docs(spark, sf).orderBy("id").first()["embedding"]


_VECTORS = "docs as (select vec_id id, cast(embedding as double[]) e, label from embeddings), one as (select e q from docs order by id limit 1)"


@query("k1_cosine_top_k", f"with {_VECTORS} select id, label, round(list_cosine_similarity(e, q) + 1, 6) score from docs, one order by list_cosine_similarity(e, q) desc, id limit 10")
def k1(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(_docs(spark, sf), _first(spark, sf)).withColumn("score", F.round("score", 6))


@query("k2_filtered_top_k", f"with {_VECTORS} select id, label, round(list_cosine_similarity(e, q) + 1, 6) score from docs, one where label = 3 order by list_cosine_similarity(e, q) desc, id limit 5")
def k2(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(_docs(spark, sf), _first(spark, sf), 5, {"label": 3}).withColumn("score", F.round("score", 6))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")


_BATCH = """ranked as (select q.id query_id, d.id, list_cosine_similarity(d.e, q.e) c, row_number() over (partition by q.id order by list_cosine_similarity(d.e, q.e) desc, d.id) "rank" from docs d, docs q where q.id % 100 = 0)"""


@query("k5_batch_top_k", f'with {_VECTORS}, {_BATCH} select query_id, id, round(c, 6) score, "rank" from ranked where "rank" <= 10')
def k5(spark: SparkSession, sf: str) -> DataFrame:
    return search.batch_top_k(_docs(spark, sf), _queries(spark, sf)).withColumn("score", F.round("score", 6))


def _vector_index(spark: SparkSession, sf: str) -> str:
    """Built by the first search of a program, read by all others."""
    return shared.once(spark, f"vectors {spark.sparkContext.applicationId} {sf}", lambda path: ann.build(_docs(spark, sf), path))


@query("k4_approximate_top_k")
def k4(spark: SparkSession, sf: str) -> DataFrame:
    return ann.top_k(spark, _vector_index(spark, sf), _queries(spark, sf))


@query("k4_recall")
def k4_recall(spark: SparkSession, sf: str) -> DataFrame:
    exact = search.batch_top_k(_docs(spark, sf), _queries(spark, sf)).select("query_id", "id")
    found = k4(spark, sf).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def _question(spark: SparkSession, sf: str) -> list[str]:
    return sorted(set(search_words(table(spark, sf, "benchmark").orderBy("item_id").first()["text"])))


def search_words(text: str) -> list[str]:
    """Words of one query text, split like the documents' terms."""
    import re

    return [w for w in re.split("[^a-z0-9áéíóúüñàèìòùâêîôûäëïöçß]+", text.lower()) if w]


_TERMS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9áéíóúüñàèìòùâêîôûäëïöçß]+'), lambda t: t <> '')"
_FIELDS = {"titulo_sumario": "titulo_sumario", "titulo_resumido": "titulo_resumido", "purified_texto_norma": "texto_norma", "purified_texto_norma_actualizado": "texto_norma_actualizado", "observaciones": "texto_resumido", "structured_texto_norma": "texto_norma || ' fin'", "structured_texto_norma_actualizado": "texto_norma_actualizado || ' fin'"}
_PLAIN = "translate({0}, 'áéíóúüñàèìòùâêîôûäëïöçß', 'ABCDEFGHIJKLMNOPQRSTUVW')"  # DuckDB counts edits of bytes
_ALLOWED = "case when length(word) <= 2 then 0 when length(word) <= 5 then 1 else 2 end"
_KEYWORD = f"""with {NORMAS}, q as (select distinct unnest({_TERMS.format('text')}) word from (select text from benchmark order by item_id limit 1)),
fields as ({' union all '.join(f"select infoleg_id id, '{f}' field, {keywords.BOOSTS[f]} boost, {_TERMS.format(c)} t from normas" for f, c in _FIELDS.items())}),
stats as (select field, count(*) n, avg(len(t)) avg_len from fields where len(t) > 0 group by 1),
tokens as materialized (select id, field, boost, l, term, count(*) tf from (select id, field, boost, len(t) l, unnest(t) term from fields) group by all),
near as (select word, term, levenshtein({_PLAIN.format('word')}, {_PLAIN.format('term')}) edits from (select distinct term from tokens), q where abs(length(word) - length(term)) <= {_ALLOWED}),
chosen as (select word, term, 1.0 - edits / least(length(word), length(term)) weight from near where edits <= {_ALLOWED} qualify row_number() over (partition by word order by edits, term) <= 50),
df as (select field, term, count(*) df from tokens group by all),
scored as (select id, field, boost, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))) s from tokens join chosen using (term) join df using (field, term) join stats using (field) group by all)
select id, round(max(boost * s), 6) score from scored group by id order by score desc, id limit 10"""


def _keyword_index(spark: SparkSession, sf: str) -> keywords.KeywordIndex:
    """Built by the first question of a program, read by all others."""
    docs = views.normas(spark, sf).selectExpr("infoleg_id id", *[f"{c} {f}" for f, c in _FIELDS.items()])
    path = shared.once(spark, f"keywords {spark.sparkContext.applicationId} {sf}", lambda path: keywords.build_index(docs, path))
    return keywords.KeywordIndex(spark, path, "id", keywords.BOOSTS)


@query("k6_keyword", _KEYWORD)
def k6(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.search(_keyword_index(spark, sf), _question(spark, sf))


@query(
    "k7_fuzzy_terms",
    f"""with vocab as (select distinct unnest({_TERMS.format('text')}) term from documents), q as (select distinct unnest({_TERMS.format('text')}) word from (select text from benchmark order by item_id limit 1))
select word, term, levenshtein({_PLAIN.format('word')}, {_PLAIN.format('term')}) edits from vocab, q where levenshtein({_PLAIN.format('word')}, {_PLAIN.format('term')}) <= {_ALLOWED}""",
)
def k7(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = table(spark, sf, "documents").select(F.explode(keywords.terms(F.col("text"))).alias("term"))
    return keywords.expand_fuzzy(vocabulary, _question(spark, sf))


@query(
    "k8_highlight",
    r"""with p as (select doc_id, list_transform(range(1, greatest(length(text), 1) + 1, 150), lambda i: regexp_extract_all(substr(text, i, 150), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) f from documents)
select doc_id, array_to_string(list_transform(list_slice(list_filter(f, lambda x: list_has_any(list_transform(x, lambda t: lower(t)), ['tion', 'the', 'une'])), 1, 3),
  lambda x: array_to_string(list_transform(x, lambda t: case when lower(t) in ('tion', 'the', 'une') then '<em>' || t || '</em>' else t end), '')), '|') fragments from p""",
)
def k8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(search.highlight(F.col("text"), ["the", "tion", "une"]), "|").alias("fragments"))


@query(
    "p22_vector_ids",
    f"""with {DIVISIONS}, hits as (select 'n' || norma_id || '_d' || id doc_id, 'division' kind, cast(id as varchar) entity from divisions union all select 'n' || norma_id || '_summarized', 'summarized_text', "name" from divisions where order_index = 1)
select doc_id, kind, cast(entity as bigint) entity from hits where kind = 'division'""",
)
def p22(spark: SparkSession, sf: str) -> DataFrame:
    nodes = views.divisions(spark, sf)
    hits = nodes.selectExpr("norma_id", "'division' kind", "cast(id as string) entity").unionByName(nodes.filter("order_index = 1").selectExpr("norma_id", "'summarized_text' kind", "name entity"))
    named = hits.withColumn("doc_id", search.vector_doc_id(F.col("norma_id"), F.col("kind"), F.col("entity"))).drop("norma_id")
    return search.parse_hits(named, "kind", "entity")


@query("p23_metadata", f"with {NORMAS} select infoleg_id source_id, coalesce(tipo_norma, '') tipo_norma, coalesce(jurisdiccion, '') jurisdiccion, cast(publicacion as varchar) sancion, coalesce(try_cast(titulo_resumido as bigint), 0) nro_boletin, titulo_sumario from normas")
def p23(spark: SparkSession, sf: str) -> DataFrame:
    return search.metadata(views.normas(spark, sf).withColumnsRenamed({"publicacion": "sancion", "titulo_resumido": "nro_boletin"}))


@query("p24_without_embedding", """select vec_id, '{"label":' || label || ',"articles":[{"n":1,"articles":[{"n":2}]}],"by_name":{"a":{"n":' || vec_id || '}}}' node from embeddings""")
def p24(spark: SparkSession, sf: str) -> DataFrame:
    article = F.struct(F.lit(1).alias("n"), "embedding", F.array(F.struct("embedding", F.lit(2).alias("n"))).alias("articles"))
    node = F.struct("label", "embedding", F.array(article).alias("articles"), F.create_map(F.lit("a"), F.struct(F.col("vec_id").alias("n"), "embedding")).alias("by_name"))
    bare = records.without_field(table(spark, sf, "embeddings").select("vec_id", node.alias("node"), "embedding"))
    return bare.select("vec_id", F.to_json("node").alias("node"))


@query("p25_node_text", f"""with {DIVISIONS} select id, nullif(trim(concat_ws(' ', nullif(case when order_index % 2 = 0 then "name" else '' end, ''), nullif(body, '')), ' '), '') t from divisions""")
def p25(spark: SparkSession, sf: str) -> DataFrame:
    from docloom.functions.text import node_text

    title = F.when(F.col("order_index") % 2 == 0, F.col("name")).otherwise("")
    return views.divisions(spark, sf).select("id", node_text(title, F.col("body")).alias("t"))


@query("p30_vector_stats", "select vec_id, len(embedding) dims, list_min(embedding) min_value, list_max(embedding) max_value, round(list_sum(cast(embedding as double[])) / len(embedding), 6) avg_value, embedding[5] fifth from embeddings")
def p30(spark: SparkSession, sf: str) -> DataFrame:
    out = search.vector_stats(table(spark, sf, "embeddings"), "vec_id")
    return out.select("vec_id", "dims", "min_value", "max_value", "avg_value", F.col("first_values")[4].alias("fifth"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Five records for each question: the nearest vectors' ids are record ids."""
    hits = search.batch_top_k(_docs(spark, sf), _queries(spark, sf), 5).select("query_id", F.col("id").alias("infoleg_id"), "rank")
    return hits.join(views.normas(spark, sf), "infoleg_id").join(_listed_articles(spark, sf), "infoleg_id", "left")


def _listed_articles(spark: SparkSession, sf: str) -> DataFrame:
    """The first twelve divisions of each record; a context shows ten."""
    articles = views.divisions(spark, sf).filter("order_index <= 12").groupBy(F.col("norma_id").alias("infoleg_id")).agg(F.array_sort(F.collect_list(F.struct("order_index", "name", "body"))).alias("a"))
    return articles.select("infoleg_id", F.transform("a", lambda x: F.struct(x["name"].alias("ordinal"), x["body"].alias("body"))).alias("articles"))


_CONTEXT = f"""{NORMAS}, {DIVISIONS}, {_VECTORS}, {_BATCH},
found as (select query_id, "rank" r, row_number() over (partition by query_id order by "rank") i, n.* from ranked join normas n on n.infoleg_id = id where "rank" <= 5),
lines as (select norma_id, coalesce(string_agg('  • Artículo ' || "name" || ': ' || body || chr(10), '' order by order_index) filter (body <> '' and order_index <= 10), '') l from divisions group by 1)"""


@query(
    "p27_context",
    f"""with {_CONTEXT} select query_id, md5(string_agg(chr(10) || '--- Norma ' || i || ' ---' || chr(10) || 'Tipo: ' || coalesce(tipo_norma, 'N/A') || chr(10) || 'Título: ' || coalesce(nullif(titulo_resumido, ''), titulo_sumario) || chr(10)
  || 'Jurisdicción: ' || coalesce(jurisdiccion, 'N/A') || chr(10) || case when coalesce(texto_resumido, '') <> '' then 'Resumen: ' || texto_resumido || chr(10) else '' end
  || case when l is not null then chr(10) || 'Artículos relevantes:' || chr(10) || l else '' end, chr(10) order by i)) digest from found left join lines on norma_id = infoleg_id group by 1""",
)
def p27(spark: SparkSession, sf: str) -> DataFrame:
    return search.format_context(_hits(spark, sf), "query_id", "rank").select("query_id", F.md5("context").alias("digest"))


@query(
    "p28_short_context",
    f"""with {_CONTEXT} select query_id, md5(string_agg('Documento ' || infoleg_id || ': ' || titulo_sumario || case when texto_norma is not null then chr(10) || 'Contenido: ' || substr(texto_norma, 1, 500) || '...' else '' end, chr(10) || chr(10) order by i)) digest,
  string_agg(infoleg_id, ',' order by i) sources from found where i <= 3 group by 1""",
)
def p28(spark: SparkSession, sf: str) -> DataFrame:
    out = search.short_context(_hits(spark, sf), "query_id", "rank", F.col("texto_norma"))
    return out.select("query_id", F.md5("context").alias("digest"), F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"))


_BLOCKS = """string_agg(chr(10) || '--- Norma ' || i || ' ---' || chr(10) || 'Tipo: ' || coalesce(tipo_norma, 'N/A') || chr(10) || 'Título: ' || coalesce(nullif(titulo_resumido, ''), titulo_sumario) || chr(10)
  || 'Jurisdicción: ' || coalesce(jurisdiccion, 'N/A') || chr(10) || case when coalesce(texto_resumido, '') <> '' then 'Resumen: ' || texto_resumido || chr(10) else '' end
  || case when l is not null then chr(10) || 'Artículos relevantes:' || chr(10) || l else '' end, chr(10) order by i)"""


@query(
    "k9_question_context",
    f"""with {_CONTEXT}, contexts as (select query_id, {_BLOCKS} context, string_agg(infoleg_id, ',' order by i) ids, count(*) n from found left join lines on norma_id = infoleg_id where query_id % 300 <> 0 group by 1)
select id query_id, coalesce(ids, '') norma_ids, md5(coalesce(context, '')) digest, case when n is null then 'No documents found. Were they loaded?' else '' end answer,
  case when n is null then 'No similar documents found' else 'Successfully retrieved context with ' || n || ' normas' end message from docs left join contexts on query_id = id where id % 100 = 0""",
)
def k9(spark: SparkSession, sf: str) -> DataFrame:
    """Every third question has a vector of zeros, which is near to nothing."""
    asked = _queries(spark, sf).withColumn("embedding", F.when(F.col("query_id") % 300 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    index = _docs(spark, sf).withColumn("source_id", F.col("id").cast("string"))
    out = search.question_context(asked, index, views.normas(spark, sf), _listed_articles(spark, sf))
    return out.select("query_id", F.array_join(F.transform("norma_ids", lambda i: i.cast("string")), ",").alias("norma_ids"), F.md5("context").alias("digest"), "answer", "message")


@query(
    "u1_hash_embedding",
    r"""with w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t-\r]+'), lambda t: t <> '')) w from documents),
counts as (select doc_id, cast(('0x' || substr(md5(w), 1, 15)) as bigint) % 64 slot, count(*) n from w group by all),
vectors as (select d.doc_id, s slot, coalesce(n, 0) / sqrt(sum(coalesce(n, 0) * coalesce(n, 0)) over (partition by d.doc_id)) x from (select doc_id from documents) d, (select unnest(range(0, 64)) s) left join counts c on c.doc_id = d.doc_id and c.slot = s)
select doc_id, string_agg(cast(round(x * 1000000) as bigint), ',' order by slot) embedding from vectors group by 1""",
)
def u1(spark: SparkSession, sf: str) -> DataFrame:
    vectors = embed.hash_embedding(table(spark, sf, "documents"), "doc_id", "text")
    return vectors.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("embedding"))


_PAIRS = f"""pairs as (select a.conv_id, b.turn, {SQL_WORDS.format('a.text')} o, {SQL_WORDS.format('b.text')} d from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn - 1)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as a derivation of the one before it."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("original")).join(c.select("conv_id", "turn", F.col("text").alias("derived")), ["conv_id", "turn"])


def _words(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf)
    return p.select("conv_id", "turn", verify.content_words(F.col("original")).alias("o"), verify.content_words(F.col("derived")).alias("d"))


_UNION, _BOTH = "len(list_distinct(list_concat(o, d)))", "len(list_intersect(list_distinct(o), list_distinct(d)))"


@query("v2_jaccard", f"with {_PAIRS} select conv_id, turn, round(case when {_UNION} = 0 then 1 else {_BOTH} / {_UNION} end, 9) jaccard from pairs")
def v2(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf).select("conv_id", "turn", F.round(verify.jaccard(F.col("o"), F.col("d")), 9).alias("jaccard"))


@query("v3_added_penalty", f"with {_PAIRS}, s as (select conv_id, turn, (len(list_distinct(d)) - {_BOTH}) / greatest(len(list_distinct(o)), 1) r from pairs) select conv_id, turn, round(case when r > 0.05 then greatest(0.4, 1 - 3 * r) else 1 end, 9) penalty from s")
def v3(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf).select("conv_id", "turn", F.round(verify.added_penalty(F.col("o"), F.col("d")), 9).alias("penalty"))


_HALF = f"halves as (select doc_id, {SQL_WORDS.format('text')} o, {SQL_WORDS.format('substr(text, 1, length(text) // 2)')} d from documents)"


@query("v4_truncation", f"with {_HALF}, s as (select doc_id, case when len(o) > 0 then len(d) / len(o) else 1 end r from halves) select doc_id, round(case when r < 0.8 then greatest(0.3, 1 - 2 * (0.8 - r)) else 1 end, 9) penalty from s")
def v4(spark: SparkSession, sf: str) -> DataFrame:
    half = F.expr("substr(text, 1, cast(length(text) div 2 as int))")
    w = table(spark, sf, "documents").select("doc_id", verify.content_words(F.col("text")).alias("o"), verify.content_words(half).alias("d"))
    return w.select("doc_id", F.round(verify.truncation_penalty(F.col("o"), F.col("d")), 9).alias("penalty"))


@query("v1_sequence_ratio")
def v1(spark: SparkSession, sf: str) -> DataFrame:
    return verify.sequence_ratio(_words(spark, sf), ["conv_id", "turn"], "o", "d").select("conv_id", "turn", "ratio")


@query("v5_fidelity")
def v5(spark: SparkSession, sf: str) -> DataFrame:
    return verify.fidelity(_pairs(spark, sf), ["conv_id", "turn"], "original", "derived").select("conv_id", "turn", "sequence", "jaccard", "added", "truncated", "score")


@query("v6_decision", """select event_id, event_type <> 'error' and "value" >= 70 - 1e-9 is_valid, case when event_type = 'error' then 'invalid structure' when "value" < 70 - 1e-9 then 'content differs' else 'ok' end message from events""")
def v6(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "events").select("event_id", (F.col("event_type") != "error").alias("valid"), (F.col("value") / 100).alias("score"))
    return verify.decide(scores, "valid", "score", 0.3).select("event_id", "is_valid", "message")


_CMP = r"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^texto norma(?: actualizado)?:[ \t-\r]*', ''), '[ \t-\r]+', ' ', 'g'), '-{{2,}}', '', 'g'), '[°.][ ]*', ' ', 'g'), ' '), ' '), lambda w: w <> ''))"


@query(
    "v7_word_diff",
    f"with p as (select a.conv_id, b.turn, {_CMP.format('a.text')} o, {_CMP.format('b.text')} d from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn - 1) select conv_id, turn, array_to_string(list_sort(list_filter(o, lambda w: not list_contains(d, w))), ' ') removed, array_to_string(list_sort(list_filter(d, lambda w: not list_contains(o, w))), ' ') added from p",
)
def v7(spark: SparkSession, sf: str) -> DataFrame:
    return verify.word_diff(_pairs(spark, sf), "original", "derived").select("conv_id", "turn", F.array_join("removed", " ").alias("removed"), F.array_join("added", " ").alias("added"))


_LINE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^texto norma(?: actualizado)?:[ \t-\r]*', ''), '[ \t-\r]+', ' ', 'g'), '-{{2,}}', '', 'g'), '[°.][ ]*', ' ', 'g'), ' ')"


@query(
    "v7_content_diff",
    f"""with p as (select a.conv_id, b.turn, {_LINE.format("coalesce(a.text, '')")} o, {_LINE.format("coalesce(b.text, '')")} d from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn - 1)
select conv_id, turn, case when o = d then '' else '--- original' || chr(10) || '+++ llm_extracted' || chr(10) || '@@ -' || case when o = '' then '0,0' else '1' end || ' +' || case when d = '' then '0,0' else '1' end || ' @@'
  || case when o <> '' then chr(10) || '-' || o else '' end || case when d <> '' then chr(10) || '+' || d else '' end end diff from p""",
)
def v7_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("conv_id", "turn", verify.content_diff(F.col("original"), F.col("derived")).alias("diff"))


_ATTEMPTS = """attempts as (select user_id, row_number() over (partition by user_id order by event_type, event_id) p, event_type model, 'out' || event_id output, event_type <> 'error' success, cast(floor("value") as bigint) tokens from (select *, row_number() over (partition by user_id, event_type order by event_id) n from events) where n = 1 and (user_id % 5 <> 0 or event_type = 'error')),
best as (select user_id, min(p) filter (success) b from attempts group by 1),
chosen as (select user_id, max(model) filter (p = b) model, max(output) filter (p = b) output, string_agg(model, ',' order by p) filter (b is null or p <= b) attempts, sum(tokens) filter (b is null or p <= b) tokens from attempts join best using (user_id) group by 1)"""


def _chosen(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    rows = table(spark, sf, "events").withColumn("n", first).filter("n = 1 and (user_id % 5 <> 0 or event_type = 'error')")
    attempts = rows.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_type", "event_id")).alias("p"), F.col("event_type").alias("model"), F.concat(F.lit("out"), F.col("event_id").cast("string")).alias("output"), (F.col("event_type") != "error").alias("success"), F.floor("value").cast("long").alias("tokens"))
    return verify.first_success(attempts, "user_id", "p", "model", "output", "success", "tokens")


@query("v8_first_success", f"with {_ATTEMPTS} select user_id, model, output, attempts, cast(tokens as bigint) tokens from chosen")
def v8(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf).withColumn("attempts", F.array_join("attempts", ","))


@query("v9_fallback", f"with {_ATTEMPTS} select doc_id user_id, coalesce(output, text) text, coalesce(case when output is not null then model end, 'none') model_used, cast(case when output is not null then tokens else 0 end as bigint) tokens_used from documents left join chosen on user_id = doc_id")
def v9(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("user_id"), "text")
    return verify.with_fallback(texts, _chosen(spark, sf), "user_id", "text")


def _single_spaces() -> object:
    return lambda text: " ".join(text.split())


def _one_division() -> object:
    import json

    return lambda text: json.dumps({"divisions": [{"name": "all", "ordinal": "1", "title": None, "body": text, "articles": [], "divisions": []}]})


@query("u2_correct", r"select conv_id, turn, 'spaces' model, trim(regexp_replace(text, '[ \t\n]+', ' ', 'g')) output, true success from conversations")
def u2(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return embed.correct(rows, "text", _single_spaces, "spaces").select("conv_id", "turn", "attempt.*")


@query("u3_structure", "select conv_id, turn, md5(text) body from conversations")
def u3(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return embed.structure(rows, "text", _one_division).select("conv_id", "turn", F.md5(F.get_json_object("tree", "$.divisions[0].body")).alias("body"))
