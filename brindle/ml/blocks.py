"""Features and labels as a stored table of blocks, which the passes of a learner read again and again.

A block's numbers lie column by column, which compresses well, and no file holds more than ``FILE_BYTES`` of them: Spark
reads thousands of a file's rows at once, and each row here is a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from brindle.sources import scratch

SCHEMA = "x binary, y binary, rows int"
ROWS = 8_192
FILE_BYTES = 16 << 20


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def block() -> pa.RecordBatch:
        x, y = (np.concatenate(v) for v in zip(*held))
        held.clear()
        return pa.RecordBatch.from_pydict({"x": [x.tobytes(order="F")], "y": [y.tobytes()], "rows": pa.array([len(y)], pa.int32())})

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column(1).to_numpy(zero_copy_only=False)))
            if sum(len(y) for _, y in held) >= ROWS:
                yield block()
    if held:
        yield block()


def stored(df: DataFrame, features: int) -> tuple[DataFrame, str]:
    """The ``features`` vectors and double ``label`` of ``df`` as a table of blocks, and its folder."""
    blocks = df.select(vector_to_array("features").alias("x"), "label").mapInArrow(_packing, SCHEMA)
    return scratch.stored(blocks, max(1, FILE_BYTES // (8 * ROWS * (features + 1))))


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each block's ``x(rows, features)`` and ``y``."""
    for batch in batches:
        x, y, rows = (batch.column(c) for c in ("x", "y", "rows"))
        for i in range(batch.num_rows):
            n = rows[i].as_py()
            yield np.frombuffer(x[i].as_buffer(), np.float64).reshape(-1, n).T, np.frombuffer(y[i].as_buffer(), np.float64)
