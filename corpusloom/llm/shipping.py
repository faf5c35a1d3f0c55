"""Readies a session for Python workers: this package on the executors, batches bounded by bytes."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusloom.shipping import ship_package

# Rows come in batches of many thousands; long texts would make them large.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def ship(spark: SparkSession) -> None:
    """The package for this application's tasks, and a bound on the bytes of a batch that a worker holds."""
    spark.conf.set(*BATCH_BYTES)
    ship_package(spark)
