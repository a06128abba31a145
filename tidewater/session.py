"""Make this package importable on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Bytes of an Arrow batch, unless the session sets them: texts are long, and a batch is copied several times.
ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = "8m"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application, and bound this session's Arrow batches."""
    if spark.conf.get(ARROW, None) is None:
        spark.conf.set(ARROW, ARROW_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        home = tempfile.mkdtemp(prefix="tidewater-code-")
        copy = shutil.copytree(here, f"{home}/src/tidewater", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{home}/tidewater", "zip", os.path.dirname(copy)))
        _shipped.add(app)
    return spark
