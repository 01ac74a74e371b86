"""Sums of partitions' arrays: rows ``(key, part, sums)`` added up by key, in the order of the partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key int, part int, sums binary"
#: Partitions' sums up to so many bytes in all go to the driver without a fold by tasks.
DIRECT_BYTES = 32 << 20


def row(key: int, part: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int32()), "part": pa.array([part], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})


def partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _folding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up what comes in a row for the same key."""
    now, first, total = None, 0, None
    for batch in batches:
        for i in range(batch.num_rows):
            key, part = batch.column("key")[i].as_py(), batch.column("part")[i].as_py()
            sums = np.frombuffer(batch.column("sums")[i].as_buffer(), np.float64)
            if key == now:
                total = total + sums
                continue
            if now is not None:
                yield row(now, first, total)
            now, first, total = key, part, sums
    if now is not None:
        yield row(now, first, total)


def folded(rows: DataFrame, parts: int, keys: int, numbers: int) -> dict[int, np.ndarray]:
    """The sums of each key on the driver: ``keys`` arrays of ``numbers`` floats at most, however many partitions there are.

    Many or large partitions' arrays are added by tasks first, in groups of partitions and then all."""
    if parts * keys * numbers * 8 > DIRECT_BYTES:
        groups, tasks = math.ceil(math.sqrt(parts)), max(1, min(parts, keys))
        rows = rows.repartition(tasks * groups, "key", (F.col("part") / groups).cast("int")).sortWithinPartitions("key", "part").mapInArrow(_folding, SCHEMA)
        rows = rows.repartition(tasks, "key").sortWithinPartitions("key", "part").mapInArrow(_folding, SCHEMA)
    out: dict[int, np.ndarray] = {}
    for r in sorted(rows.collect(), key=lambda r: r["part"]):
        sums = np.frombuffer(r["sums"], np.float64)
        out[r["key"]] = out[r["key"]] + sums if r["key"] in out else sums.copy()
    return out
