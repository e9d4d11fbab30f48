"""Streaming settings replay: the last value of each (tab, key), by event order.

A native streaming aggregation in update mode: ``max_by`` keeps one value and its
key ``(ts, event_id)`` for each (tab, key), so an event that arrives late loses to a
newer one by itself and no watermark is needed; the state is as large as the
settings that were ever set. Every micro-batch writes the pairs it changed into a
folder of its own, overwritten if the batch is retried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.operators.replay import settings_replay
from weblens.session import ensure_checkpoint_dir
from weblens.sources.log import log_from_events

SCHEMA = "tab long, key string, value string, ts timestamp"


def settings_stream(events: DataFrame) -> DataFrame:
    """Streaming DataFrame ``(tab, key, value, ts)`` of an event stream: the same
    aggregation as the batch replay."""
    return settings_replay(log_from_events(events))


def run_settings_stream(spark: SparkSession, source_dir: str, glob: str = "events.parquet", max_files: int = 1) -> DataFrame:
    """Replays the events in ``source_dir`` as a stream (availableNow):
    ``(tab, key, value)`` as the last micro-batch that changed it left it."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/settings_stream/{uuid.uuid4().hex[:12]}"
    schema = spark.read.option("pathGlobFilter", glob).parquet(source_dir).schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).parquet(source_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    # an empty first folder: a stream without any batch then reads as no rows
    spark.createDataFrame([], SCHEMA).write.parquet(f"{base}/out/batch_id=-1")
    q = (settings_stream(src).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.schema(f"{SCHEMA}, batch_id long").parquet(f"{base}/out")
    return out.groupBy("tab", "key").agg(F.max_by("value", "batch_id").alias("value"))
