"""From raw documents to packed training sequences: each stage works on all that the one before it kept.

Stages but the last return the columns of documents. Between stages rows are written as Parquet and read again, so a
lost executor costs the stage that runs, not the pipeline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, neardup, packing, quality, scratch, secrets
from docloom.llm.queries import quality_model, tokenizer_path


def _with_own_names(docs: DataFrame, used: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs``, of whose columns it sees the ``used`` ones by name and all others by a number.

    So no column of the documents, whatever it is called, meets one that an operator makes, and all come back unchanged.
    """
    hidden = [name if name in used else f"__column{i}" for i, name in enumerate(docs.columns)]
    return stage(docs.toDF(*hidden)).select(*hidden).toDF(*docs.columns)


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, learned on labelled documents of its input, does not reject.

    Null and empty texts are scored like others, equal texts alike, and repeated rows stay repeated. An empty table gives an
    empty one. All columns come back, whatever their names.
    """
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _with_own_names(docs, ("doc_id", "text"), lambda d: quality.score(d, model).filter("predicted = 1"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates.

    Of equal texts and of repeated rows one stays; rows without words, null texts too, all stay. An empty table gives an
    empty one. All columns come back, whatever their names.
    """
    return _with_own_names(docs, ("doc_id", "text"), neardup.keep_one)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not contain the benchmark beyond the contamination rule.

    Null and empty texts contain nothing and stay, as repeated rows do; an empty benchmark lets all pass. All columns come
    back, whatever their names.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_own_names(docs, ("doc_id", "text"), lambda d: decontaminate.decontaminate(d, benchmark).filter("not contaminated"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars to match.

    Null texts stay null, and repeated rows stay repeated; a null source owns nothing. All other columns come back
    unchanged, whatever their names.
    """

    def clean(d: DataFrame) -> DataFrame:
        found = secrets.redact(d.withColumn("__before", F.length("text")))
        size = F.when(F.col("__before") != F.length("text"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
        return found.withColumn("n_chars", size)

    return _with_own_names(docs, ("doc_id", "text", "source", "n_chars"), clean)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good_only),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: SQL cannot state the compression classifier, so no SQL states the pipeline's rows; tests compare it with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = scratch.table(docs, f"stage{number}")
    return docs
