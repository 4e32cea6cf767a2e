"""Blocks of lines: the unit in which the text operators ask other lines about what they share.

A block holds the whole lines of about two megabytes of one input partition, packed and compressed in one row of a table in the shared
checkpoint folder. Since the table is written once, a block has the same lines in the same order whenever it is read,
so a question ("does anyone else have these names?") can be answered by a bit per asked name, in asking order, instead
of by sending the names or the text back and forth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.settings import tidy
from tidemark.sources.scratch import materialise

BLOCK_BYTES = 2 << 20
NO_NUMBER = np.iinfo(np.int64).max  # stands for a missing line number, which is after all others


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def line_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    """Line numbers and UTF-8 bytes of a batch with columns line_number and line; a missing line is empty."""
    numbers = batch.column(0).fill_null(int(NO_NUMBER)).to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers, [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]


def number_column(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers, pa.int64(), mask=numbers == NO_NUMBER)


def chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows into stretches of about `limit` bytes; a longer row is a stretch of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def pack(lines: DataFrame, carry: str | None = None) -> DataFrame:
    """Write (line_number, line) as blocks: block_id, n_bytes, numbers, sizes, body.

    `carry` names a string column that is packed beside the lines: the column `carried` holds its values in their order.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            numbers, texts = line_rows(batch)
            lengths = [len(x) for x in texts]
            for lo, hi in chunks(lengths, BLOCK_BYTES):
                body = b"".join(texts[lo:hi])
                columns = {
                    "block_id": pa.array([block], pa.int64()),
                    "n_bytes": pa.array([len(body)], pa.int64()),
                    "numbers": pa.array([numbers[lo:hi].tobytes()], pa.binary()),
                    "sizes": pa.array([np.array(lengths[lo:hi], np.int64).tobytes()], pa.binary()),
                    "body": pa.array([squeeze(body, 5)], pa.binary()),  # moved several times
                }
                if carry:
                    columns["carried"] = pa.array([_pack_carried(batch.column(2).slice(lo, hi - lo))], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)
                block += 1

    rows = lines.select(
        F.col("line_number").cast("long"), F.col("line").cast("string"), *([F.col(carry).cast("string")] if carry else [])
    )
    schema = "block_id long, n_bytes long, numbers binary, sizes binary, body binary"
    return materialise(rows.mapInArrow(tidy(packed), schema + ", carried binary" * bool(carry)))


def _pack_carried(values: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([values.cast(pa.large_string())], ["carried"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return squeeze(sink.getvalue().to_pybytes(), 5)


def carried_column(data: bytes) -> pa.Array:
    """The values of a block's carried column, in the order of its lines."""
    with pa.ipc.open_stream(expand(data)) as stream:
        return stream.read_next_batch().column(0).cast(pa.string())


def buckets_for(blocks: DataFrame, bytes_each: int) -> int:
    """Number of buckets that leaves each about the given bytes of text; at least 32, so that all executors take part."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(32, -(-total // bytes_each))
