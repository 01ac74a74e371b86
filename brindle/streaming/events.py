"""Streams: windowed aggregates with watermarks, sessions, stateful spikes, and a queue of files. All additions of Spark's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.ml.custom import kernel_p


def windowed(events: DataFrame, time: str, width: str, slide: str | None = None, late: str = "1 hour", by: list[str] | None = None, value: str | None = None) -> DataFrame:
    """Counts and sums per tumbling or sliding window and key; rows later than ``late`` are dropped. Batch frames work alike."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(time, width, slide) if slide else F.window(time, width)
    sums = [F.coalesce(F.sum(value), F.lit(0.0)).alias(f"sum_{value}")] if value else []
    grouped = timed.groupBy(window.alias("window"), *(by or [])).agg(F.count(F.lit(1)).alias("count"), *sums)
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(by or []), "count", *[f"sum_{value}"] * bool(value))


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Runs of a key's events with gaps under ``gap``."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    grouped = timed.groupBy(F.session_window(time, gap).alias("session"), *by).agg(F.count(F.lit(1)).alias("count"))
    return grouped.select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), *by, "count")


def stream_spikes(events: DataFrame, key: str, column: str, order: str, history: int = 30, confidence: float = 99.0) -> DataFrame:
    """Spikes of each key's values, by the p-value that ``custom.spikes`` gives; the last ``history`` values are the state kept per key."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(order)
        found = []
        for v in rows[column].astype(float):
            found.append(1.0 if pd.isna(v) else kernel_p([x for x in past if x is not None], v))
            past = [*past, None if pd.isna(v) else v][-history:]
        state.update((past,))
        yield pd.DataFrame({key: k[0], "value": rows[column].astype(float).to_numpy(), "p_value": found, "alert": [p < 1 - confidence / 100 for p in found]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, value double, p_value double, alert boolean", "past array<double>", "append", "NoTimeout")


def file_queue(spark: SparkSession, path: str, schema: str, work: Callable[[DataFrame, int], None], checkpoint: str, per_batch: int = 1) -> StreamingQuery:
    """Files of a folder worked off in order, ``per_batch`` at a time, each exactly once by the checkpoint."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)
    return files.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
