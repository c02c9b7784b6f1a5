"""Arrow batches between the JVM and Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Long texts: Arrow batches are bounded by bytes, unless the session says otherwise. Workers then need the same memory for any texts."""
    if spark.conf.get(BATCH_BYTES, None) in (None, "-1", "67108864", "67108864b", "64MB", "64m"):
        spark.conf.set(BATCH_BYTES, str(8 << 20))
