"""The corpus kept up as documents arrive: a file stream, micro-batches, replace by source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridquill.operators.context import build_documents


def latest(documents: DataFrame, key: str = "document_id", version: str = "batch") -> DataFrame:
    """Of each document the version that arrived last."""
    fields = [c for c in documents.columns if c != key]
    newest = documents.groupBy(key).agg(F.max_by(F.struct(*fields), version).alias("d"))
    return newest.select(key, "d.*")


def keep_up(pages: DataFrame, target: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] = build_documents) -> StreamingQuery:
    """Documents built from a stream of pages, appended to ``target`` with their batch number.

    A document arrives whole, so no state is kept between batches; a batch that is run again
    overwrites its own folder. Read the corpus with ``current``.
    """

    def write(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    return latest(spark.read.parquet(target)).drop("batch")


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Pages (document_id, page, text) from Parquet files as they are added."""
    return spark.readStream.schema("document_id string, page int, text string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window_start, event_type, n: events per window; later ones than ``late`` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    own = timed.withWatermark("ts", late) if events.isStreaming else timed
    out = own.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n")
