"""Session settings of the text operators, and how their Python code runs in tasks."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

from tidemark.session import prepare

# Rows that Python gets at once: whole lines can be long, and pairs of lines twice as long.
BATCH_ROWS = "1000"


def prepare_text(spark: SparkSession) -> SparkSession:
    """Apply the required settings, the batch size for rows with whole lines, and the place of this code for workers."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    here = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:  # a cluster that ships the package with --py-files finds it without this
        environment["PYTHONPATH"] = os.pathsep.join([*paths, here])
    return prepare(spark)


def release() -> None:
    """Give memory back to the system at the end of a task; workers stay alive and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its allocator keeps what it wants
        pass


Batches = Iterator[pa.RecordBatch]


def tidy(function: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function over Arrow batches that gives its memory back when its task ends."""

    def run(batches: Batches) -> Batches:
        try:
            yield from function(batches)
        finally:
            release()

    return run
