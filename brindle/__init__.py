"""Spark-native analytics: typed modules compiled to lazy DataFrame plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it.

    Rows hold whole texts, so Arrow batches are held to 1,000 rows unless the session says otherwise."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    if context.applicationId not in _shipped:
        home = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp()  # executors fetch the archive from the driver as they start
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/{home.name}", "zip", home.parent, home.name))
        _shipped.add(context.applicationId)
