"""Structured Streaming page feed: pages arrive as parquet files, each
micro-batch is turned into page snapshots and appended to a sink.

A page is one row and never spans micro-batches, so the per-page windows of
the tree builder are legal inside ``foreachBatch``. The batch job is the same
plan as the batch query; progress and output survive restarts through the
checkpoint location (under ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.functions import lists as L
from weblens.operators import elements as E
from weblens.operators import snapshot as S
from weblens.operators import tree
from weblens.session import ensure_checkpoint_dir
from weblens.sources.pages import enrich


def batch_nodes(pages: DataFrame, num_partitions: int) -> DataFrame:
    """The node table of one batch of pages."""
    return E.build_nodes(E.core_nodes(tree.build(tree.partition_pages(pages, num_partitions))))


def snapshot_batch(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Page snapshots of one batch of pages from its node table."""
    els = nodes.filter(F.col("kind") == "open").drop("text")
    txt = nodes.filter(F.col("kind") == "text")
    et = E.with_text(els.filter(F.col("tag").isin([*L.HEADING_TAGS, "title"])), txt)
    return S.page_snapshot(pages, els, et)


def run_page_feed(spark: SparkSession, source_dir: str, sink_dir: str | None = None,
                  checkpoint: str | None = None, rich: bool = False, glob: str | None = None) -> str:
    """Process every file currently in ``source_dir`` (optionally only names
    matching ``glob``; trigger availableNow) and return the sink directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = uuid.uuid4().hex[:12]
    sink_dir = sink_dir or f"{base}/page_feed/{run}/out"
    checkpoint = checkpoint or f"{base}/page_feed/{run}/ckpt"
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    schema = reader.parquet(source_dir).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    if glob:
        stream = stream.option("pathGlobFilter", glob)
    stream = stream.parquet(source_dir)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch, overwritten on retry: a re-run batch replaces
        # its own output instead of appending duplicates (idempotent sink)
        pages = batch.select("page_id", "url", "html")
        pages = enrich(pages) if rich else pages
        nodes = batch_nodes(pages, tree.partitions_for(pages, least)).persist(StorageLevel.MEMORY_AND_DISK)  # read seven times below
        try:
            snapshot_batch(pages, nodes).write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")
        finally:
            nodes.unpersist()

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink_dir


def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page feed over ``{sf_dir}/pages.parquet``, one file or a folder of files;
    returns the appended snapshots."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/pages.parquet")
    if path.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        out = run_page_feed(spark, f"{sf_dir}/pages.parquet")
    else:
        out = run_page_feed(spark, sf_dir, glob="pages.parquet")
    return spark.read.parquet(out).select("page_id", "snapshot")
