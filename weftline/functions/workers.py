"""What keeps Python workers small: bounded Arrow batches, and freed memory that goes back to the system."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch at most: a batch stands in the JVM and in a worker at once, and texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold BATCH_ROWS rows and about BATCH_BYTES bytes at most."""
    for name, most in ((_ROWS, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        now = spark.conf.get(name).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def give_back() -> None:
    """Returns to the system what a worker has freed: it stays alive beside the executor's heap when its task is done."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass
