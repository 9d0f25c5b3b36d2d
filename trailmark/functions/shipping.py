"""Makes this package importable in Python workers, wherever they run, and keeps their batches small."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch: whole texts are long, and a batch stands in the memory of the JVM and of the worker at once.
BATCH_ROWS, _ROWS = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package to all workers of the session's application, once. Arrow batches get BATCH_ROWS rows where the session
    has Spark's default of 10 000."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as folder:
        copy = os.path.join(folder, "root", os.path.basename(package))
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="package-"), os.path.basename(package)), "zip", os.path.join(folder, "root"))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
