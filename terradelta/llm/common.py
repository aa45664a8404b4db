"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import let_go, new_path, saved, small

__all__ = ["held", "let_go", "lone", "long_rows", "new_path", "parts", "saved", "small", "table", "texts", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (the path may be in any store)."""
    long_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_rows(spark: SparkSession) -> None:
    """Arrow batches for rows with whole texts: a few megabytes each, in the JVM and in its Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


_held: dict = {}


def held(owner: str, key: object, make: Callable[[], object]) -> object:
    """What a worker keeps between batches and tasks: one operator's memory at a time, as workers serve many in turn."""
    if _held.get("for") != (owner, key):
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)  # only some C libraries have it
        _held.update({"for": (owner, key), "it": make()})
    return _held["it"]


def texts(batch: pa.RecordBatch, name: str) -> Iterator[str | None]:
    """The strings of a column one by one, so that only one Python copy of a long text lives at a time."""
    for x in batch.column(batch.schema.get_field_index(name)):
        yield x.as_py()


def utf8(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column (null: empty), without decoding them."""
    column = batch.column(batch.schema.get_field_index(name))
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for x in binary:
        yield x.as_py() or b""


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what is made of a slice stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lone(batches: Iterator[pa.RecordBatch], owner: str, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """``parts`` for an operator that holds nothing between batches: what another has left in the worker is let go."""
    held(owner, None, lambda: None)
    return parts(batches, rows)
