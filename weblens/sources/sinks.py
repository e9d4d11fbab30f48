"""Output sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_outputs(outputs: DataFrame, path: str) -> None:
    """Write ``(..., format, output)`` rows as parquet partitioned by format. Formats
    that ``outputs`` holds are replaced, the others under ``path`` stay; a job that is
    run again replaces its own rows."""
    outputs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("format").parquet(path)


def read_outputs(spark: SparkSession, path: str, formats: list[str] | None = None) -> DataFrame:
    """The written outputs; of some formats, without reading the others' files."""
    out = spark.read.parquet(path)
    return out if formats is None else out.filter(F.col("format").isin(formats))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Persist an intermediate table (e.g. the element table) in shared
    storage; later jobs read it instead of recomputing the tree."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
