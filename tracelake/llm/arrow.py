"""Streaming Arrow stages.

A stage is a function from a RecordBatch to a RecordBatch that runs in
``mapInArrow``. It reads the named columns only, so other columns of the
input, whatever their names and nulls, never matter.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracelake.session import share_code

#: Text that is worked on at a time in a worker; a longer text is a slice alone.
SLICE_BYTES = 4 << 20
#: Rows that Spark puts into one Arrow batch; bounds a worker's input.
BATCH_ROWS = 1_000


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``limit`` bytes (or list elements)."""
    values = batch.column(column)
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    start = size = 0
    for i, n in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def release() -> None:
    """Gives memory that is free back to the system: workers live on between
    tasks, and what an allocator keeps adds up over those of an executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def strings(column: pa.Array) -> list[str]:
    """Python strings; null is the empty one."""
    return [x or "" for x in column.to_pylist()]


def map_slices(
    df: DataFrame, column: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]
) -> DataFrame:
    """Applies ``make()`` (called once in a task) to slices of the input."""
    share_code(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, column):
                out = step(part)
                if out is not None:
                    yield out
            release()

    return df.mapInArrow(run, schema)
