"""Arrow batches of bounded size, and Arrow's memory given back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: At most so many bytes of rows go to Python at once, whatever the length of the texts (a row at least).
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session has a smaller bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def freed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow or mapInPandas, with the task's Arrow memory given back at its end: workers stay for later
    tasks and stages, and Arrow's pool would keep what they have freed."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return task
