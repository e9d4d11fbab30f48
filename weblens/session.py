"""Spark session helpers."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PKG = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "weblens") -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on)."""
    master = master or os.environ.get("WEBLENS_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WEBLENS_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a ``local[*]`` session, where every task runs on this machine, may go
    without the setting; it then gets a scratch folder. On any other master a
    missing setting raises: files written to one machine's disk would be
    silently missing for the others."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not _is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        d = tempfile.mkdtemp(prefix="weblens-ckpt-")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder; deleted by the driver's
    file system client when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/weblens-scratch/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder, once, and
    read it back. A lost executor then costs a re-read, not a re-run, and every
    consumer sees the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows as one struct column ``row`` beside computed keys, so that a join
    can name its keys freely whatever the columns of ``df`` are called."""
    names = [f"`{c.replace('`', '``')}`" for c in df.columns]
    return df.select(F.struct(*names).alias("row"), *[c.alias(k) for k, c in keys.items()])


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), so that
    functions which run there import it whatever folder the driver started in."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(_PKG):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PKG)))
    tmp = tempfile.mkdtemp(prefix="weblens-pkg-")  # the driver's own; Spark copies the file to every executor
    path = os.path.join(tmp, "weblens_pkg.zip")
    with open(path, "wb") as out:
        out.write(buf.getvalue())
    atexit.register(_forget, path)
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def _forget(path: str) -> None:
    if os.path.exists(path):
        os.remove(path)
        os.rmdir(os.path.dirname(path))
