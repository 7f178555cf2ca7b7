"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, labelled, language, lattice, lexical, neardup, packing, pii, quality, quotes, secrets, sequences, spans, toxicity, whitening
from docloom.sources import shared


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public vocabulary that the queries pack with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path(), with_ids=False)


def _count(array: str, kind: str) -> Column:
    return F.size(F.filter(array, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(spans.listed(F.col("base")), 256)
    return found.select("doc_id", *[_count("base", k) for k in pii.KINDS], digest.alias("base_sha256"), spans.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    digest = F.sha2(spans.listed(F.col("base")), 256)
    counts = [_count("base", k) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, digest.alias("base_sha256"), spans.listed(F.col("spans")).alias("spans"), F.col("live").cast("long").alias("n_live"), F.col("copied").cast("long").alias("n_copied"), F.size("spans").cast("long").alias("n_spans"))


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(_table(spark, sf_dir, "conversations"))


QUALITY_SAMPLE = TOXIC_SAMPLE = 4000  # labelled rows of each label learned from, at most


def quality_model(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> quality.Model:
    """Learned from labelled rows outside the held-out fold."""
    known = labels.filter(labelled.fold("doc_id", modulus) != held)
    rows = labelled.sample(docs, known, "doc_id", "text", "quality", QUALITY_SAMPLE)
    return quality.train(rows, labelled.totals(known, "doc_id", "quality"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, _table(spark, sf_dir, "labels"))
    rows = docs.withColumn("held_out", F.coalesce(labelled.fold("doc_id", 5) == 0, F.lit(False)))
    return quality.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    known = _table(spark, sf_dir, "labels").filter(labelled.fold("doc_id", 3) != 1)
    sample = labelled.sample(docs, known, "doc_id", "text", "toxic", TOXIC_SAMPLE)
    net = toxicity.train(sample, labelled.totals(known, "doc_id", "toxic"))
    rows = docs.withColumn("held_out", F.coalesce(labelled.fold("doc_id", 3) == 1, F.lit(False)))
    return toxicity.score(rows, net).select("doc_id", "held_out", "score", "predicted")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = labelled.fold("doc_id", 4) == 2
    model = language.train(docs.filter(~held))
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    return language.detect(rows, model, spans=False).select("doc_id", "held_out", "lang_pred", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"), keep_text=False)
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).select("doc_id", "class_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.link_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.rank(docs, _table(spark, sf_dir, "benchmark"))


def op13_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shared.new_path(spark, "sequences")
    sequences.write(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    return sequences.read(spark, folder, "doc_id", docs.schema["doc_id"].dataType)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_pack": op4_pack,
    "op5_quotes": op5_quotes,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_language": op8_language,
    "op9_ngram_join": op9_ngram_join,
    "op10_lattice": op10_lattice,
    "op11_whitening": op11_whitening,
    "op12_lexical": op12_lexical,
    "op13_sequences": op13_sequences,
}

_OP7 = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
items as (
  select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark where item_id is not null),
item_windows as (
  select distinct item_id, least(13, len(w)) n, array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) s from items where len(w) > 0)),
widths as (select distinct n from item_windows),
doc_windows as (
  select doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s from words, widths where len(w) >= n)),
hits as (select d.doc_id, d.s, d.n, i.item_id from doc_windows d join item_windows i on d.win = i.win and d.n = i.n),
hit_words as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(s, s + n)) p from hits) group by doc_id),
hit_items as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from hits) group by doc_id)
select w.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from words w left join hit_words using (doc_id) left join hit_items using (doc_id)
"""

_OP9 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
shingles as materialized (
  select distinct doc_id, array_to_string(list_slice(w, s, s + least(5, len(w)) - 1), ' ') g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) s from words where len(w) > 0)),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
links as materialized (
  select a.doc_id a, b.doc_id b
  from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 9 * count(*) >= 4 * (x.n + y.n)),
reach(id, root) as (select doc_id, doc_id from documents union select l.b, r.root from reach r join links l on l.a = r.id),
classes as (select id, min(root) class_id from reach group by id)
select c.id doc_id, class_id, coalesce(n, 0) n_links, c.id = class_id kept
from classes c left join (select a, count(*) n from links group by a) l on l.a = c.id
"""

_OP10 = """
with recursive v as (
  select vec_id, cast(embedding as double[]) e from embeddings
  where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links as materialized (
  select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, root) as (select vec_id, vec_id from embeddings union select l.b, r.root from reach r join links l on l.a = r.id),
classes as (select id, min(root) component_id from reach group by id)
select c.id vec_id, coalesce(n, 0) n_links, component_id, c.id = component_id kept
from classes c left join (select a, count(*) n from links group by a) l on l.a = c.id
"""

_OP5 = r"""
with recursive lines as (
  select conv_id, turn, role, l.i, l.x, length(regexp_replace(regexp_extract(l.x, '^\s*((?:>\s*)+)', 1), '[^>]', '', 'g')) lvl,
    regexp_replace(l.x, '^\s*((?:>\s*)+)', '') said
  from (select *, unnest(list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x, i: {'i': i, 'x': x})) l from conversations)),
keyed as (
  select *, trim(regexp_replace(lower(said), '\s+', ' ', 'g')) k, coalesce(lead(lvl) over w, 0) next_lvl, coalesce(lag(lvl) over w, 0) last_lvl
  from lines window w as (partition by conv_id, turn order by i)),
marked as (select *, lvl = 0 and next_lvl > 0 and regexp_matches(said, '^\s*(?:On|Am|Le|El) .{1,200}:\s*$') leads from keyed),
messages as (
  select conv_id, turn, role, coalesce(string_agg(said, chr(10) order by i) filter (lvl = 0 and not leads), '') own_text,
    count(*) filter (lvl > 0 and lvl <> last_lvl) n_passages, max(lvl) max_level
  from marked group by conv_id, turn, role),
own as (
  select *, sum(b) over (partition by conv_id, turn order by i) para
  from (select *, case when lag(i) over (partition by conv_id, turn order by i) = i - 1 then 0 else 1 end b from marked where lvl = 0 and not leads and k <> '')),
said as (
  select conv_id, turn, 0 r, string_agg(k, chr(10) order by i) x from own group by conv_id, turn, para
  union all select conv_id, turn, 0, string_agg(k, chr(10) order by i) from own group by conv_id, turn
  union all select conv_id, turn, 1, k || chr(10) || lead(k) over (partition by conv_id, turn order by i) from own
  union all select conv_id, turn, 2, k from own),
near as (select conv_id, r, x, min(turn) t from said where x is not null group by all),
far as (select r, x, min({'c': conv_id, 't': t}) f from near group by r, x),
quoted as (select *, sum(case when lvl <> last_lvl then 1 else 0 end) over (partition by conv_id, turn order by i) pid from marked),
passages as (select conv_id, turn, pid, lvl, list(k order by i) l from quoted where lvl > 0 and k <> '' group by all),
asked as (
  select conv_id, turn, pid, lvl, 0 r, array_to_string(l, chr(10)) x from passages
  union all select conv_id, turn, pid, lvl, 1, l[1] || chr(10) || l[2] from passages where len(l) > 1
  union all select conv_id, turn, pid, lvl, 2, l[1] from passages),
origins as (
  select q.conv_id, q.turn, q.pid, q.lvl, 2 * q.r + case when n.t < q.turn then 0 else 1 end place, case when n.t < q.turn then {'c': q.conv_id, 't': n.t} when f.f.c < q.conv_id then f.f end o
  from asked q left join near n on n.conv_id = q.conv_id and n.r = q.r and n.x = q.x left join far f on f.r = q.r and f.x = q.x),
linked as (select conv_id, turn, pid, lvl, arg_min(o, place) o from origins where o is not null group by conv_id, turn, pid, lvl),
votes as (select conv_id, turn, lvl, o, count(*) n from linked group by all),
best as (select conv_id, turn, arg_min(o, {'l': lvl, 'n': -n, 'o': o}) o, sum(n) n_linked from votes group by conv_id, turn),
parents as (
  select m.*, coalesce(n_linked, 0) n_linked, b.o, coalesce(b.o, case when lag(m.turn) over (partition by m.conv_id order by m.turn) is not null
    then {'c': m.conv_id, 't': lag(m.turn) over (partition by m.conv_id order by m.turn)} end) p
  from messages m left join best b on b.conv_id = m.conv_id and b.turn = m.turn),
up as (select conv_id, min(o.c) c from parents where o.c < conv_id group by conv_id),
climb(conv_id, thread) as (select distinct conv_id, conv_id from messages union select climb.conv_id, up.c from climb join up on up.conv_id = climb.thread),
threads as (select conv_id, min(thread) thread_id from climb group by conv_id)
select p.conv_id, p.turn, p.role, own_text, n_passages, cast(n_linked as bigint) n_linked, cast(max_level as bigint) max_level, p.p.c parent_conv, p.p.t parent_turn, thread_id,
  row_number() over (partition by thread_id order by p.conv_id, p.turn) "position"
from parents p join threads t on t.conv_id = p.conv_id
"""

_OP12 = r"""
with terms as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') t
  from documents),
docs as materialized (select doc_id, len(t) n, t, row_number() over () r from terms where len(t) > 0),
totals as (select count(*) nn, cast(sum(n) as bigint) ll from docs),
asked as materialized (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) term
  from benchmark where item_id is not null),
found as materialized (
  select r, doc_id, n, term, count(*) tf
  from (select r, doc_id, n, unnest(t) term from docs) where term in (select term from asked) group by all),
weights as (select term, cast(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) as bigint) w from found, totals group by term, nn),
scored as (
  select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) as bigint) score
  from asked join found using (term) join weights using (term), totals group by item_id, r, doc_id)
select item_id, cast("rank" as integer) "rank", doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) "rank" from scored where score > 0 and doc_id is not null) where "rank" <= 10
"""

ORACLE_SQL: dict[str, str] = {"op5_quotes": _OP5, "op7_decontaminate": _OP7, "op9_ngram_join": _OP9, "op10_lattice": _OP10, "op12_lexical": _OP12}
