"""What Python workers are given at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Python workers get at most so many rows and bytes at a time, so that long texts don't fill their memory. The setting stays with the session, since plans run later."""
    for key, most in (("maxRecordsPerBatch", str(rows)), ("maxBytesPerBatch", size)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", most)
