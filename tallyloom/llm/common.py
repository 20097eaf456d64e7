"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


@cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Give memory that is free in this worker back to the system: workers live on from stage to stage beside the JVM."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def add_columns(df: DataFrame, ddl: str, fn: Callable[[pa.RecordBatch], list[list]]) -> DataFrame:
    """``df`` with the columns of ``ddl``, which ``fn`` computes for one Arrow batch at a time as lists of values.

    All columns of ``df`` are kept as they are, save those that ``ddl`` names (in whatever case): these are replaced.
    """
    new = fields(ddl)
    taken = {f.name.lower() for f in new}
    kept = [f.name for f in df.schema if f.name.lower() not in taken]
    schema = T.StructType([f for f in df.schema if f.name in kept] + list(new))
    kinds = [to_arrow_type(f.dataType) for f in new]
    names = kept + new.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array(values, kind) for values, kind in zip(fn(batch), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in kept] + made, names)
            del batch, made
        release()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; a null is an empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def chunks(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most_bytes`` of text each, so that a batch of very long texts stays small.

    A text is never cut: one longer than that is a part of its own.
    """
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + (size or 0) > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < len(sizes):
        yield batch.slice(start)
