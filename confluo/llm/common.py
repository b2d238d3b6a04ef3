"""Shared plumbing of the training-data operators: tables, shared scratch storage, UDF shipping."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import cut, scratch

__all__ = ["LOWER", "UPPER", "ascii_lower", "cut", "groups", "held_out", "scratch", "ship", "table", "trim", "worker_cache"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Pickle the functions of ``module`` by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_cache(key: Hashable, make: Callable[[], Any]) -> Any:
    """An object kept in the Python worker from task to task."""
    kept = sys.modules.setdefault("_confluo_worker", types.ModuleType("_confluo_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def groups(batches: Iterator[pa.RecordBatch], column: str, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, and of about ``size`` bytes in a column of texts; a longer text is one by itself."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b[column]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < b.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(at, to - at)
            at, before = to, int(ends[to - 1])


def trim() -> None:
    """Give memory that is free back to the system: the Python workers of an executor outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32(doc_id as text) mod 5 = 0. A null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


ship(__name__)
