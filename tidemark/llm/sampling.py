"""Samples of a fixed number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lowest_ranks(df: DataFrame, rank: str, count: int, order: tuple[str, ...] = ()) -> DataFrame:
    """The `count` rows of the lowest 64-bit hash ranks; ties by `order`.

    Rows far above the expected cut are dropped first, so that about twice the sample is put in order, however many tasks
    the table has. The table is counted for that and should be stored.
    """
    share = min(1.0, 2 * count / max(1, df.count()))
    cut = -(1 << 63) + int(share * ((1 << 64) - 1))
    near = df.where(F.col(rank) <= F.lit(cut)) if share < 1 else df
    return near.orderBy(rank, *order).limit(count)
