"""Micro-batches of lines through the same plan as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.batch import Result, Store, run_records
from ..plans.semantic import MappingProvider
from ..sources.raw_records import parse_texts
from ..sources.sinks import is_done
from ..tables import cut
from .buffers import PROVIDER, flushed

# How many files a batch takes and how long it waits.
FILES, SECONDS = 50, 2.0
#: How often timers of held lines are looked at.
TICK = 0.5


def read_lines(spark: SparkSession, path: str, max_files: int = FILES) -> DataFrame:
    """A stream of (source, line) from the files of a folder."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    return lines.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))


def process_batch(store: Store, lines: DataFrame, provider: MappingProvider | None = None, batch: tuple[str, int] | None = None) -> Result:
    """(source, line): each line is routed and parsed by itself; one record_id from here to the table. A model is used but never fitted. A batch that the registry holds already isn't processed again."""
    if is_done(store.spark, store.at("registry"), batch):
        return Result()
    texts = cut(lines.where(F.length(F.trim("line")) > 0).withColumn("id", F.monotonically_increasing_id()).withColumnRenamed("line", "text"))
    parsed = parse_texts(texts.select("id", "text")).join(texts, "id")
    whole = F.coalesce(F.nullif(F.try_element_at("record", F.lit("raw_text")), F.lit("")), F.col("text"))
    record = F.map_concat(F.map_filter("record", lambda k, v: k != "raw_line"), F.create_map(F.lit("raw_line"), whole))
    record_id = F.substring(F.sha1(F.concat_ws(":", "source", F.col("at").cast("string"), "text")), 1, 16)
    raw = parsed.select(record_id.alias("record_id"), F.col("source").alias("log_source"), "format", record.alias("record"))
    return run_records(store, raw, provider, may_fit=False, batch=batch)


def start(store: Store, lines: DataFrame, checkpoint: str, provider: MappingProvider | None = None, available_now: bool = False, seconds: float = SECONDS, name: str = "stream", size: int | None = None, shards: int = 1) -> StreamingQuery:
    """Runs process_batch on each micro-batch, under ``name`` and the batch's number. A batch that runs again after a failure changes no table: what it had finished is skipped, what it had begun is overwritten.

    With ``size``, a source's lines are held until so many are there or the first has waited for ``seconds``, whatever the trigger brings at once.
    """
    if size is not None:
        store.spark.conf.set(*PROVIDER)
        lines, seconds = flushed(lines, size, seconds, shards).select("source", "line"), min(seconds, TICK)
    writer = lines.writeStream.foreachBatch(lambda frame, number: process_batch(store, frame, provider, (name, number)) and None).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()


def windowed_counts(events: DataFrame, time_col: str, key_col: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key, with late rows up to the watermark; works on streams and tables."""
    timed = events.withWatermark(time_col, late) if events.isStreaming else events
    return timed.groupBy(F.window(time_col, length).alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "key", "n")


def flush(query: StreamingQuery) -> None:
    """Waits until all that is there is processed."""
    query.processAllAvailable()


def health(query: StreamingQuery) -> dict:
    """Whether the stream runs, its last batch and rows, and what stopped it."""
    last, failed = query.lastProgress, query.exception()
    return {"active": query.isActive, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0, "error": str(failed) if failed else None}
