"""Record JSON: schemas, reading from a cache, normalising payloads, and all forms of export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from docloom.functions.text import number_or, strict_date

NUMBERS = "array<struct<numero:string,dependencia:string,rama_digesto:string>>"
NORM = (
    f"infoleg_id bigint, jurisdiccion string, clase_norma string, tipo_norma string, sancion string, id_normas {NUMBERS}, publicacion string, titulo_sumario string, titulo_resumido string, observaciones string, nro_boletin string,"
    " pag_boletin string, texto_resumido string, texto_norma string, texto_norma_actualizado string, estado string, lista_normas_que_complementa array<bigint>, lista_normas_que_la_complementan array<bigint>"
)
_NORM_STRUCT = "struct<" + NORM.replace(", ", ",").replace(" ", ":") + ">"
ENVELOPE = (
    f"scraping_data struct<infoleg_response:{_NORM_STRUCT},scraper_metadata:struct<api_url:string,scraper_version:string,has_full_text:boolean,scraping_timestamp:string,from_cache:boolean>>,"
    " processing_data struct<purifications:map<string,string>,parsings:map<string,struct<structured_data:string>>,processor_metadata:struct<model_used:string,tokens_used:bigint,processing_timestamp:string>,"
    "embedder_metadata:struct<embedding_model_used:string,embedding_tokens_used:bigint,embedding_timestamp:string>,summarized_text_embedding:array<float>>"
)
_ENVELOPE_STRUCT = "struct<" + ENVELOPE.replace(", ", ",").replace("scraping_data struct", "scraping_data:struct").replace("processing_data struct", "processing_data:struct") + ">"
CACHED = f"cached_at string, cache_version string, data {_ENVELOPE_STRUCT}, _corrupt_record string"
# The payload's names of a record's fields.
PAYLOAD = {
    "id": "infoleg_id", "jurisdiccion": "jurisdiccion", "claseNorma": "clase_norma", "tipoNorma": "tipo_norma", "sancion": "sancion", "idNormas": "id_normas", "publicacion": "publicacion", "tituloSumario": "titulo_sumario",
    "tituloResumido": "titulo_resumido", "observaciones": "observaciones", "nroBoletin": "nro_boletin", "pagBoletin": "pag_boletin", "textoResumido": "texto_resumido", "textoNorma": "texto_norma",
    "textoNormaAct": "texto_norma_actualizado", "estado": "estado", "listaNormasQueComplementa": "lista_normas_que_complementa", "listaNormasQueLaComplementan": "lista_normas_que_la_complementan",
}
_LISTS = {"id_normas": NUMBERS, "lista_normas_que_complementa": "array<bigint>", "lista_normas_que_la_complementan": "array<bigint>"}


def read_cached(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records in cached JSON, and the rows skipped with a reason: ``bad JSON`` or ``no infoleg_id``."""
    raw = spark.read.schema(CACHED).option("mode", "PERMISSIVE").option("multiLine", multi_line).json(path)
    rows = raw.select(F.col("data.scraping_data.infoleg_response").alias("r"), "_corrupt_record")
    reason = F.when(F.col("_corrupt_record").isNotNull(), "bad JSON").when(F.col("r.infoleg_id").isNull(), "no infoleg_id")
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason is null").select("r.*"), marked.filter("reason is not null").select("reason", "_corrupt_record")


def wrap(norms: DataFrame, cached_at: str, version: str = "1.0") -> DataFrame:
    """Records as cache entries: cached_at, cache_version and data; dates as ISO text, lists that are JSON text parsed.

    The metadata say where the record is from and if there is a full text.
    """

    def field(c: str, kind: str) -> Column:
        if kind == "date":
            return F.date_format(c, "yyyy-MM-dd").alias(c)
        return F.from_json(c, _LISTS[c]).alias(c) if kind == "string" and c in _LISTS else F.col(c)

    full = F.coalesce(F.col("texto_norma") != "", F.lit(False))
    about = F.struct(F.concat(F.lit("migrator://postgres/"), F.col("infoleg_id").cast("string")).alias("api_url"), F.lit(version).alias("scraper_version"), full.alias("has_full_text"), F.lit(cached_at).alias("scraping_timestamp"), F.lit(False).alias("from_cache"))
    data = F.struct(F.struct(F.struct(*[field(c, kind) for c, kind in norms.dtypes if c != "id"]).alias("infoleg_response"), about.alias("scraper_metadata")).alias("scraping_data"))
    return norms.select(F.lit(cached_at).alias("cached_at"), F.lit(version).alias("cache_version"), data.alias("data"))


def without_field(df: DataFrame, name: str = "embedding") -> DataFrame:
    """``df`` without the fields called exactly ``name``, at every depth of structs, lists and map values."""

    def holds(kind: DataType) -> bool:
        if isinstance(kind, StructType):
            return any(f.name == name or holds(f.dataType) for f in kind.fields)
        return holds(kind.elementType) if isinstance(kind, ArrayType) else holds(kind.valueType) if isinstance(kind, MapType) else False

    def bare(value: Column, kind: DataType) -> Column:
        if not holds(kind):
            return value
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: bare(x, kind.elementType))
        if isinstance(kind, MapType):
            return F.transform_values(value, lambda _, x: bare(x, kind.valueType))
        kept = [f for f in kind.fields if f.name != name]
        return F.when(value.isNotNull(), F.struct(*[bare(value[f.name], f.dataType).alias(f.name) for f in kept]))

    return df.select(*[bare(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name != name])


def from_payload(payloads: DataFrame, column: str = "json") -> DataFrame:
    """API payloads (JSON text) as records: names in snake case, strict dates, missing lists empty; broken JSON gives nulls."""
    types = {"infoleg_id": "bigint", **_LISTS}
    schema = "struct<" + ",".join(f"{api}:{types.get(name, 'string')}" for api, name in PAYLOAD.items()) + ">"
    parsed = payloads.select(F.from_json(column, schema).alias("p"))
    out = []
    for api, name in PAYLOAD.items():
        value = F.col(f"p.{api}")
        if name in ("sancion", "publicacion"):
            value = strict_date(value)
        elif name in _LISTS:
            value = F.coalesce(value, F.array().cast(_LISTS[name]))
        out.append(value.alias(name))
    return parsed.select(*out)


def page_ids(pages: DataFrame) -> DataFrame:
    """Ids in landed result pages (day, page, count, limit, results): those that are set and not 0."""
    return pages.select("day", F.explode("results.id").alias("infoleg_id")).filter(F.coalesce("infoleg_id", F.lit(0)) != 0)


def missing_pages(pages: DataFrame) -> DataFrame:
    """Pages that a day's count and limit call for (one-based) but that have not landed."""
    need = pages.groupBy("day").agg(F.max("count").alias("count"), F.max("limit").alias("limit"))
    wanted = need.select("day", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.ceil(F.col("count") / F.col("limit")), F.lit(1)).cast("long"))).alias("page")).join(need.filter("count > 0").select("day"), "day", "left_semi")
    return wanted.join(pages.select("day", "page"), ["day", "page"], "left_anti")


def flat(docs: DataFrame) -> DataFrame:
    """Lists and structs as JSON text, nulls as ''."""
    text = lambda c, kind: F.to_json(c) if kind.startswith(("array", "struct", "map")) else F.col(c).cast("string")
    return docs.select(*[F.coalesce(text(c, kind), F.lit("")).alias(c) for c, kind in docs.dtypes])


def dump(docs: DataFrame, path: str, form: str) -> None:
    """Write documents as ``ndjson``, ``csv`` or ``parquet`` (snappy); the last two flat."""
    if form == "ndjson":
        docs.write.json(path)
    elif form == "csv":
        flat(docs).write.option("header", True).option("escape", '"').csv(path)
    elif form == "parquet":
        flat(docs).write.option("compression", "snappy").parquet(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def read_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An NDJSON dump without the index name; ``schema`` lists the source's fields."""
    return spark.read.schema(f"_id string, _index string, {schema}").json(path).drop("_index")


def log_failures(failures: DataFrame, path: str, text: str = "input") -> None:
    """Append failure records as JSON lines, their input cut to 1000 characters."""
    failures.withColumn(text, F.substring(text, 1, 1000)).write.mode("append").json(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a folder of JSON arrays; unique_id is the file's stem and the article's number. Broken files give no rows."""
    rows = spark.read.schema("article_number string, title string, body string, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    return rows.select(F.concat_ws("_", stem, "article_number").alias("unique_id"), "article_number", "title", "body", "_corrupt_record").filter("_corrupt_record is null and article_number is not null").drop("_corrupt_record")


def flat_norm(envelopes: DataFrame) -> DataFrame:
    """Envelopes as flat records: the payload's fields, purified texts, and the tree of the updated text, else of the original."""
    r = "scraping_data.infoleg_response"
    numbers = F.transform(F.col(f"{r}.id_normas"), lambda x: x.withField("numero", number_or(x["numero"])))
    purified = lambda k: F.try_element_at("processing_data.purifications", F.lit(k))
    tree = lambda k: F.try_element_at("processing_data.parsings", F.lit(k))["structured_data"]
    plain = [F.col(f"{r}.{c}").alias(c) for c in PAYLOAD.values() if c != "id_normas"]
    return envelopes.select(
        *plain,
        numbers.alias("id_normas"),
        purified("original_text").alias("purified_texto_norma"),
        purified("updated_text").alias("purified_texto_norma_actualizado"),
        F.coalesce(tree("updated_text"), tree("original_text")).alias("structured"),
        F.col("processing_data.processor_metadata.model_used").alias("model_used"),
        F.coalesce("processing_data.processor_metadata.tokens_used", F.lit(0)).alias("tokens_used"),
        F.col("processing_data.embedder_metadata.embedding_model_used").alias("embedding_model"),
    )
