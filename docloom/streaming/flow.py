"""Stages over streams of files, and the metrics of their logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from docloom.operators import store
from docloom.sources import shared

# Stages that log records name.
STAGES = (
    "startup", "shutdown", "health_check", "message_received", "message_sent", "queue_error", "processing", "processing_start", "processing_complete", "processing_failed", "cache_hit", "cache_miss", "cache_write",
    "cache_error", "api_request", "api_response", "api_error", "scraping", "purification", "llm_call", "verification", "embedding", "insertion", "storage_write", "storage_read", "storage_error",
)
# Messages a batch takes, its window in seconds, and how many run at once, by stage.
BATCHES = {"purifying": (1, 0, 10), "processing": (1, 0, 5), "embedding": (5, 5, 20), "inserting": (10, 10, 15)}
RECEIVES = 3  # fixed value: after so many a message is dead
LATEST = "168 hours"


def source(spark: SparkSession, path: str, schema: str, form: str = "parquet", stage: str | None = None) -> DataFrame:
    """A stream of files, each a message or some; ``stage`` sets how many a batch takes."""
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", BATCHES[stage][0]) if stage else reader).load(path)


def drain(stream: DataFrame, label: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream until all that is there is processed, and read its result from the shared folder.

    In append mode the file sink commits each batch once. In complete mode a batch replaces the whole result; each goes to
    a folder of its own, so a repeated batch overwrites only itself, and the one with the largest number is the result. A
    stream that is drained again with the same ``path`` goes on where it ended; without one the path is new.
    """
    spark = stream.sparkSession
    path = path or shared.new_path(spark, label)
    writer = stream.writeStream.option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")).start().awaitTermination()
    rows = _batches(spark, path, stream.schema)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == last).drop("batch") if last is not None else spark.createDataFrame([], stream.schema)


def _batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of all batches in a folder, with their numbers; none if there is no folder yet."""
    if not shared.exists(spark, path):
        return spark.createDataFrame([], StructType([*schema.fields, StructField("batch", LongType())]))
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", path).parquet(path)


def consume(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], stage: str, path: str) -> tuple[DataFrame, list[int]]:
    """Run a stage over all messages that are there: what it sent on, and how many messages each batch took.

    A batch takes the stage's number of messages at most (``source`` with the same stage), batches begin a window apart,
    and no more tasks than the stage allows work on one. A batch writes a folder of its own, so a repeated one changes
    nothing, and a stage that is run again with the same ``path`` takes only what is new.
    """
    size, window, most = BATCHES[stage]
    schema = transform(stream).schema

    def put(batch: DataFrame, number: int) -> None:
        transform(batch.coalesce(most)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.option("checkpointLocation", f"{path}-progress").trigger(processingTime=f"{window} seconds").foreachBatch(put).start()
    try:
        query.processAllAvailable()
        taken = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()
    return _batches(stream.sparkSession, path, schema).drop("batch"), taken


def parse_messages(raw: DataFrame, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Messages that parse, and the malformed ones."""
    fields = schema if schema.lower().startswith("struct") else f"struct<{schema.replace(' ', ':')}>"
    parsed = raw.withColumn("m", F.from_json(value, f"{fields[:-1]},_corrupt_record:string>", {"mode": "PERMISSIVE"}))
    bad = F.col("m").isNull() | F.col("m._corrupt_record").isNotNull()
    return parsed.filter(~bad).select(*[F.col(f"m.{f.split(':')[0]}") for f in fields[7:-1].split(",")]), parsed.filter(bad).select(value)


def dead_letters(attempts: DataFrame, key: str, ts: str = "ts", most: int = RECEIVES, forget: int = 4 * 86400, late: str = LATEST) -> DataFrame:
    """(key, receives) of each message when it is received for the ``most``-th time, once.

    The count of each key is state of the stream, so it survives a restart and a later receive emits nothing. A key that is
    not received for ``forget`` seconds of event time (column ``ts``), counted when the watermark of ``late`` passes,
    starts anew, so state doesn't grow with all messages ever seen. Null keys are one message. ``receives`` is ``most``,
    whatever the size of the batch that reached it.
    """
    schema = StructType([StructField(key, attempts.schema[key].dataType), StructField("receives", LongType())])

    def count(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before, last = state.get if state.exists else (0, 0)
        now = before
        for batch in batches:
            now += len(batch)
            last = max(last, int(batch["__ms"].max()))
        state.update((min(now, most), last))
        state.setTimeoutTimestamp(max(last + forget * 1000, state.getCurrentWatermarkMs() + 1))
        if before < most <= now:
            yield pd.DataFrame({key: pd.Series([name[0]], dtype=object if name[0] is None else None), "receives": [most]})

    rows = attempts.filter(F.col(ts).isNotNull()).withWatermark(ts, late).select(key, ts, F.unix_millis(ts).alias("__ms"))
    state = StructType([StructField("n", LongType()), StructField("last", LongType())])
    return rows.groupBy(key).applyInPandasWithState(count, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def dead_counts(attempts: DataFrame, key: str, most: int = RECEIVES) -> DataFrame:
    """(key, receives) of all messages received ``most`` times or more, with all their receives; drained in complete mode."""
    return attempts.groupBy(key).agg(F.count("*").alias("receives")).filter(F.col("receives") >= most)


def replay(requests: DataFrame, cache: Callable[[], DataFrame], key: str, path: str) -> DataFrame:
    """Stored records of requested ids with status ``replayed``, else a row with ``not_in_cache``; a row for each request.

    Each batch of requests is joined with the cache as it is then, which ``cache`` reads anew, so a later batch finds what was
    stored meanwhile. The side that may be large is not sent to all tasks; a request repeated in a batch is answered once.
    A batch that is repeated overwrites its own answers; with the same ``path`` only new requests are answered.
    """

    def put(batch: DataFrame, number: int) -> None:
        store.replay(batch.select(key), cache(), key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    schema = store.replay(cache().select(key).limit(0), cache(), key).schema
    requests.writeStream.option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return _batches(requests.sparkSession, path, schema).drop("batch")


def upsert_stream(stream: DataFrame, key: str, path: str, order: str | None = None, compact: int = 16) -> DataFrame:
    """A keyed table in ``path``, fed by a stream that may deliver twice; returns the table.

    Each batch adds its last row of each key, under the batch's number, so a batch that is repeated writes the same again
    and the rest of the table is not touched. After ``compact`` batches the rows so far become a new base. The folder
    tells which base and batches count, so a stream that is started again with the same path goes on where it ended.
    ``order`` picks the row that stays among those of one key; without it the later batch's.
    """
    spark = stream.sparkSession
    schema = StructType([*stream.schema.fields, StructField("__batch", LongType())])

    def put(batch: DataFrame, number: int) -> None:
        _last_rows(batch.withColumn("__batch", F.lit(number).cast("long")), key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")
        base, batches = _versions(spark, path)
        if len(batches) >= compact:
            _last_rows(_read_versions(spark, path, schema, base, batches), key, order).write.mode("overwrite").parquet(f"{path}/base={batches[-1]}")

    stream.writeStream.option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return _last_rows(_read_versions(spark, path, schema, *_versions(spark, path)), key, order).drop("__batch")


def _last_rows(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    by = F.struct(order, "__batch") if order else F.struct("__batch", *[c for c in rows.columns if c not in (key, "__batch")])
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), by).alias("r")).select("r.*")


def _versions(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """Number of the last complete base in a folder, and of the complete batches after it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "batch": []}
    for entry in files.listStatus(hadoop) if files.exists(hadoop) else []:
        kind, _, number = entry.getPath().getName().partition("=")
        if kind in found and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    base = max(found["base"], default=None)
    return base, sorted(n for n in found["batch"] if base is None or n > base)


def _read_versions(spark: SparkSession, path: str, schema: StructType, base: int | None, batches: list[int]) -> DataFrame:
    paths = [f"{path}/base={base}"] * (base is not None) + [f"{path}/batch={n}" for n in batches]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vocabulary(logs: DataFrame, stage: str = "stage") -> DataFrame:
    """Logs with ``is_known``: whether the record's stage is one that records may name."""
    return logs.withColumn("is_known", F.coalesce(F.col(stage).isin(*STAGES), F.lit(False)))


def on_time(logs: DataFrame, delay: str = LATEST, ts: str = "ts") -> DataFrame:
    """Logs with a watermark; stateful operators drop what is later than ``delay``."""
    return logs.withWatermark(ts, delay)


def windowed(logs: DataFrame, size: str, by: str, value: dict[str, Column], step: str | None = None, only: Column | None = None, ts: str = "ts") -> DataFrame:
    """Aggregates per window (start) and ``by``; sliding if ``step`` is given."""
    rows = logs if only is None else logs.filter(only)
    grouped = rows.groupBy(F.window(ts, size, step) if step else F.window(ts, size), F.col(by))
    return grouped.agg(*[v.alias(k) for k, v in value.items()]).select(F.col("window.start").alias("start"), by, *value)


def timeline(logs: DataFrame, only: Column) -> DataFrame:
    """Matching records with a formatted line."""
    return logs.filter(only).withColumn("line", F.format_string("[%s] %s: %s", F.col("service"), F.col("level"), F.col("infoleg_id").cast("string")))


def run_stage(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Consume a stream by a stage and read what it sent on."""
    return drain(transform(stream), label)
