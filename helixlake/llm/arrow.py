"""Arrow-batched Python with bounded memory.

Batches are bounded by bytes, since texts vary from a word to a book; and workers, which Spark reuses
for stage after stage, hand freed memory back to the system when a task ends.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

Batches = Iterator[pa.RecordBatch]


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on a batch's bytes to BATCH_BYTES, unless it is lower."""
    now = spark.conf.get(_LIMIT)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


@lru_cache(maxsize=1)
def steady() -> None:
    """Once a process: blocks of a megabyte or more come from the system and go back to it when they are freed.
    By default that limit rises with the blocks freed, and large arrays then break up a heap that never shrinks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        ctypes.CDLL("libc.so.6").mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())


def hand_back() -> None:
    """Give freed memory back to the system, where the platform lets us."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Batches], Batches], schema) -> DataFrame:
    """df.mapInArrow(run, schema) within these bounds."""
    bound_batches(df.sparkSession)

    def tidy(batches: Batches) -> Batches:
        steady()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return df.mapInArrow(tidy, schema)
