"""Sends this package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


#: Rows of an Arrow batch: texts are long, so Spark's default would make batches of many megabytes.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python path, once for each application, and keeps Arrow batches small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)
