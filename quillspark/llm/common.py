"""Shared plumbing: durable intermediate tables, table readers, ordered Arrow mapping."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.scratch import scratch, scratch_path, shared_dir, staged
from quillspark.sources.tables import table

__all__ = ["bounded_batches", "scratch", "scratch_path", "shared_dir", "slices", "staged", "table", "tagged"]


#: Bytes of an Arrow batch that goes to Python. Spark's own 64 MB are held by the JVM and the worker of every task at once.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches were bounded to BATCH_BYTES, unless they were already set smaller. Results don't depend on it."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", conf.get(name).strip().lower()).groups()
    if int(number) << 10 * " kmgt".index(unit or " ") > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def slices(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of some batches in slices of about ``most`` bytes as Python objects; a larger row stands alone."""
    for batch in batches:
        size = np.full(batch.num_rows, 100, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            elif pa.types.is_list(column.type):
                each = 500 if pa.types.is_struct(column.type.value_type) else 40
                size += each * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
        del batch
        pa.default_memory_pool().release_unused()


def tagged(name: str) -> Column:
    """A string column as a grouping key in which null differs from every text."""
    c = F.col(name).cast("string")
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c))
