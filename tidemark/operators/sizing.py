"""How many pieces an ordered table is cut into: always from its measured number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.sources.scratch import materialise

ROWS_PER_BUCKET = 250_000
ROWS_PER_PART = 1_000_000


def buckets_for(rows: int) -> int:
    """The smallest power of two that leaves each bucket at most ROWS_PER_BUCKET rows on average."""
    wanted = -(-rows // ROWS_PER_BUCKET)
    return 1 << max(0, wanted - 1).bit_length()


def parts_for(rows: int) -> int:
    """Partitions of a sorted table: each is sorted in one task and holds the rows of a few buckets."""
    return max(1, -(-rows // ROWS_PER_PART))


def placed(df: DataFrame, buckets: int | None = None) -> tuple[DataFrame, int]:
    """Rows that can be read several times, and their number of buckets.

    Without a given number the rows are written once and counted, so the number follows what is there, not a guess from
    file sizes. The plan and its formulas are the same for any number; one bucket is merely a short list of buckets.
    """
    if buckets is not None:
        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("bucket count must be a power of two")
        return df, buckets
    stored = materialise(df)
    return stored, buckets_for(stored.count())
