"""This package on the executors, for the operators whose tasks run Python, and a bound on their batches."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

# Rows come in batches of many thousands, which long texts or arrays of sentences would make
# large: a worker holds a batch several times over, as text, as Python objects and as a result.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def ship_package(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once for each application.

    Spark's own file server hands it out, so executors need no copy installed. Batches
    are bounded unless the session says how large they may be.
    """
    if not spark.conf.get(BATCH_BYTES[0], None):
        spark.conf.set(*BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
