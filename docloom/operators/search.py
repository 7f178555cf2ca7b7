"""Vector and keyword search, and the context built from hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources import shared

DEFAULT_K = 10
BLOCK_BYTES = 1 << 24  # of query vectors that go to every task at a time
_QUERIES, _ROWS = 512, 2048  # of a matrix of scores: 8 MB, of which a task makes a few copies
NO_HITS = "No documents found. Were they loaded?"  # fixed value


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def top_k(docs: DataFrame, query: list[float], k: int = DEFAULT_K, filters: dict[str, object] | None = None, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The ``k`` documents nearest to one query vector (default if not positive), score cosine + 1, the vector left out.

    Filters hold before the search, so k documents remain after them.
    """
    for name, value in (filters or {}).items():
        docs = docs.filter(F.col(name) == value)
    scored = docs.withColumn("score", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])) + 1.0).filter("score is not null").drop(vector)
    return scored.orderBy(F.desc("score"), key).limit(k if k > 0 else DEFAULT_K)


_FEW = 1024  # queries that are fetched without counting them first


def _query_blocks(queries: DataFrame, vector: str, query_key: str, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and vectors of the queries that have one, in blocks of about ``block_bytes``, whatever their number."""
    asked = queries.select(F.col(query_key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter((F.size("v") > 0) & F.col("k").isNotNull())
    rows = asked.limit(_FEW).toArrow()
    if len(rows) < _FEW and rows.nbytes <= block_bytes:
        if len(rows):
            yield rows.column("k").to_numpy(), np.stack(rows.column("v").to_numpy())
        return
    n, dims = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = -(-n * (dims or 0) * 8 // block_bytes)
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).toArrow()
        if len(rows):
            yield rows.column("k").to_numpy(), np.stack(rows.column("v").to_numpy())


def in_blocks(blocks: Iterator[tuple[np.ndarray, np.ndarray]], compared: Callable[[tuple[np.ndarray, np.ndarray]], tuple[DataFrame, Broadcast]]) -> DataFrame | None:
    """The rows that ``compared`` gives for each block of queries, with what it sent to the tasks; None without blocks.

    Of more than one block each is run and its few rows are written before the next is read, and what was sent goes, so
    the driver and the tasks hold one block at a time.
    """
    first, second = next(blocks, None), next(blocks, None)
    if first is None or second is None:
        return None if first is None else compared(first)[0]
    done = []
    for block in chain([first, second], blocks):
        rows, sent = compared(block)
        done.append(shared.table(rows, "block"))
        sent.destroy()
    return reduce(DataFrame.unionByName, done)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows and those with values that are no numbers become NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


class _Best:
    """The ``k`` largest scores of each query, with keys; ties go to the smaller key."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.keys = k, np.full((queries, 0), -np.inf), None

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        scores = np.where(np.isnan(scores), -np.inf, np.round(scores, 12))
        every = np.broadcast_to(keys, scores.shape)
        if self.keys is not None:
            scores, every = np.concatenate([self.scores, scores], axis=1), np.concatenate([self.keys, every], axis=1)
        if scores.shape[1] > 4 * self.k:  # all that reach the k-th largest score
            floor = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k, None]
            most = int((scores >= floor).sum(1).max())
            if most < scores.shape[1]:
                at = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                scores, every = np.take_along_axis(scores, at, 1), np.take_along_axis(every, at, 1)
        _, rank = np.unique(every, return_inverse=True)
        order = np.lexsort((rank.reshape(every.shape), -scores), axis=1)[:, : self.k]
        self.scores, self.keys = np.take_along_axis(scores, order, 1), np.take_along_axis(every, order, 1)


def _nearest(rows: DataFrame, block: tuple[np.ndarray, np.ndarray], k: int, key: str, query_key: str, query_kind: str, compare: Callable[[np.ndarray, np.ndarray], np.ndarray], read: Callable[[pa.Array], np.ndarray]) -> tuple[DataFrame, Broadcast]:
    """(query, key, score) and what was sent to the tasks: the best ``k`` of each task's rows (key, v) for each query of a block."""
    names, vectors = block
    kind = rows.schema[key].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast((names, vectors))  # a block of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = sent.value
        parts = [(at, _Best(len(names[at : at + _QUERIES]), k)) for at in range(0, len(names), _QUERIES)]
        for batch in batches:
            batch = batch.filter(pa.compute.and_(batch.column("v").is_valid(), batch.column("k").is_valid()))
            for row in range(0, batch.num_rows, _ROWS):
                part = batch.slice(row, _ROWS)
                keys, values = part.column("k").to_numpy(zero_copy_only=False), read(part.column("v"))
                for at, best in parts:
                    best.add(compare(vectors[at : at + _QUERIES], values), keys)
        for at, best in parts:
            if best.keys is not None:
                q, j = np.nonzero(best.scores > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(names[at + q]), pa.array(best.keys[q, j]), pa.array(best.scores[q, j])], [query_key, key, "score"])

    return rows.select(F.col(key).alias("k"), "v").mapInArrow(run, f"`{query_key}` {query_kind}, `{key}` {kind}, score double"), sent


def _first_k(scored: DataFrame, k: int, key: str, query_key: str) -> DataFrame:
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.stack(lists.to_numpy(zero_copy_only=False)) if len(lists) else np.zeros((0, 1))


def batch_top_k(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_K, vector: str = "embedding", key: str = "id", query_key: str = "query_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` documents nearest to each row of ``queries``: query_id, id, score, rank.

    A stated set of queries against all documents, cut into blocks of a fixed number of bytes. A block goes to every task,
    which compares it with its documents by matrix products and keeps the k best for each query, so only those are
    shuffled. Rows without vector or with a zero one are left out; all vectors have one length.
    """
    own = docs.select(key, F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    kind = queries.schema[query_key].dataType.simpleString()
    nearest = lambda block: _nearest(own, (block[0], _unit(block[1])), k, key, query_key, kind, lambda q, x: q @ _unit(x).T, _matrix)
    found = in_blocks(_query_blocks(queries, vector, query_key, block_bytes), nearest)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"`{query_key}` {kind}, `{key}` {docs.schema[key].dataType.simpleString()}, score double, rank int")
    return _first_k(found, k, key, query_key)


def highlight(text: Column, words: list[str], size: int = 150, most: int = 3) -> Column:
    """Up to ``most`` fragments of ``size`` characters with matches in <em>; fragments tile the text, so none overlap."""
    pattern = r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(sorted({w for w in words if w.isalnum()}, key=len, reverse=True)) + r")(?![\p{L}\p{N}_])"
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size)), lambda at: F.substring(text, at, size))
    hits = F.filter(pieces, lambda p: p.rlike(pattern))
    return F.transform(F.slice(hits, 1, most), lambda p: F.regexp_replace(p, pattern, "<em>$1</em>"))


def vector_doc_id(norm: Column, kind: Column, entity: Column) -> Column:
    """``n{norm}_d{id}``, ``n{norm}_a{id}`` or ``n{norm}_summarized``."""
    head = F.concat(F.lit("n"), norm.cast("string"), F.lit("_"))
    return F.when(kind == "division", F.concat(head, F.lit("d"), entity.cast("string"))).when(kind == "article", F.concat(head, F.lit("a"), entity.cast("string"))).when(kind == "summarized_text", F.concat(head, F.lit("summarized")))


def parse_hits(hits: DataFrame, kind: str = "document_type", entity: str = "document_id") -> DataFrame:
    """Hits of divisions and articles with a whole number as id."""
    out = hits.withColumn(entity, F.col(entity).try_cast("long"))
    return out.filter(F.col(kind).isin("division", "article") & F.col(entity).isNotNull())


def metadata(norms: DataFrame, bulletin: str = "nro_boletin") -> DataFrame:
    """What search documents carry of their record: missing texts '', the bulletin's number 0 if it is none."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return norms.select(F.col("infoleg_id").alias("source_id"), text("tipo_norma"), text("jurisdiccion"), text("sancion"), F.coalesce(F.col(bulletin).try_cast("long"), F.lit(0)).alias(bulletin), text("titulo_sumario"))


def vector_stats(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Length, first five values, least, most and mean of each vector."""
    total = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vectors.select(key, F.size(vector).cast("long").alias("dims"), F.slice(vector, 1, 5).alias("first_values"), F.array_min(vector).alias("min_value"), F.array_max(vector).alias("max_value"), F.round(F.try_divide(total, F.size(vector)), 6).alias("avg_value"))


# The wording of contexts.
def format_context(rows: DataFrame, group: str, rank: str) -> DataFrame:
    """group and ``context``: numbered blocks of a question's records with title, summary and at most ten articles.

    ``rows`` has tipo_norma, titulo_resumido, titulo_sumario, jurisdiccion, texto_resumido and articles (ordinal, body).
    """
    title = F.coalesce(F.nullif("titulo_resumido", F.lit("")), "titulo_sumario", F.lit("Sin título"))
    line = lambda a: F.when(F.coalesce(a["body"], F.lit("")) != "", F.concat(F.lit("  • Artículo "), F.coalesce(a["ordinal"], F.lit("N/A")), F.lit(": "), a["body"], F.lit("\n")))
    lines = F.array_join(F.filter(F.transform(F.slice("articles", 1, 10), line), lambda x: x.isNotNull()), "")
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(rank)))
    block = F.concat(
        F.lit("\n--- Norma "), F.col("__n").cast("string"), F.lit(" ---\nTipo: "), F.coalesce("tipo_norma", F.lit("N/A")), F.lit("\nTítulo: "), title, F.lit("\nJurisdicción: "), F.coalesce("jurisdiccion", F.lit("N/A")), F.lit("\n"),
        F.when(F.coalesce("texto_resumido", F.lit("")) != "", F.concat(F.lit("Resumen: "), "texto_resumido", F.lit("\n"))).otherwise(""),
        F.when(F.size("articles") > 0, F.concat(F.lit("\nArtículos relevantes:\n"), lines)).otherwise(""),
    )
    blocks = numbered.select(group, "__n", block.alias("b")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__n", "b"))).alias("b"))
    return blocks.select(group, F.array_join(F.transform("b", lambda x: x["b"]), "\n").alias("context"))


def question_context(questions: DataFrame, index: DataFrame, norms: DataFrame, articles: DataFrame, k: int = 5, filters: dict[str, object] | None = None) -> DataFrame:
    """From questions with vectors to context: query_id, norma_ids, context, answer and message, a row for each question.

    ``index`` holds the search documents (id, source_id, embedding and what ``filters`` compare); the ``k`` nearest that
    pass the filters are a question's hits. Their records, distinct and in order of the first hit, are joined with
    ``norms`` (infoleg_id and the fields of :func:`format_context`) and ``articles`` (infoleg_id, articles). A question
    without hits gets an empty context and says so.
    """
    for name, value in (filters or {}).items():
        index = index.filter(F.col(name) == value)
    hits = batch_top_k(index, questions, k).join(index.select("id", F.col("source_id").try_cast("long").alias("infoleg_id")), "id").filter("infoleg_id is not null")
    records = hits.groupBy("query_id", "infoleg_id").agg(F.min("rank").alias("rank"))
    full = records.join(norms, "infoleg_id").join(articles, "infoleg_id", "left")
    ids = full.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "infoleg_id"))), lambda r: r["infoleg_id"]).alias("norma_ids"))  # k at most
    rows = questions.select("query_id").join(format_context(full, "query_id", "rank").join(ids, "query_id"), "query_id", "left")
    none = F.col("norma_ids").isNull()
    message = F.when(none, "No similar documents found").otherwise(F.concat(F.lit("Successfully retrieved context with "), F.size("norma_ids").cast("string"), F.lit(" normas")))
    return rows.select("query_id", F.coalesce("norma_ids", F.array().cast("array<bigint>")).alias("norma_ids"), F.coalesce("context", F.lit("")).alias("context"), F.when(none, NO_HITS).otherwise("").alias("answer"), message.alias("message"))


def short_context(hits: DataFrame, group: str, rank: str, text: Column, most: int = 3, size: int = 500) -> DataFrame:
    """group, context (the first ``size`` characters of the best ``most`` hits) and source ids."""
    best = hits.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(rank))).filter(F.col("__n") <= most)
    block = F.concat(F.lit("Documento "), F.col("infoleg_id").cast("string"), F.lit(": "), F.coalesce("titulo_sumario", F.lit("")), F.when(text.isNotNull(), F.concat(F.lit("\nContenido: "), F.substring(text, 1, size), F.lit("..."))).otherwise(""))
    rows = best.select(group, F.struct("__n", block.alias("b"), "infoleg_id").alias("s")).groupBy(group).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select(group, F.array_join(F.transform("s", lambda x: x["b"]), "\n\n").alias("context"), F.transform("s", lambda x: x["infoleg_id"]).alias("sources"))
