"""A folder that all executors share, for what is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under the cluster's checkpoint folder; only a session on one machine may leave that unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file:///tmp/checkpoints"
    return f"{shared.rstrip('/')}/brindle-core-{uuid.uuid4().hex}"


def stored(df: DataFrame, file_rows: int = 0) -> tuple[DataFrame, str]:
    """``df`` as a table in a new folder, and the folder: its lineage ends there, and it outlives any executor.

    Large rows need a bound on ``file_rows``: a reader takes up to 4,096 rows of a file at once."""
    path = folder(df.sparkSession)
    writer = df.write
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows).option("compression", "zstd").option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str | None) -> None:
    """Delete a folder of ``stored``."""
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
