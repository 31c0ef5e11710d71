"""How many rows go to Python at a time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Whole texts in a batch where a job of their own reads them.
TEXTS = 512

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside; whole texts are
    long, and a batch is held by Spark and by Python at the same time."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)
