"""Running totals and rank selection over an order, without ever sorting everything in one task.

An un-partitioned window pulls the whole table into one task. The operators here first write the rows range-partitioned
and sorted by the order, and cut each partition into buckets of equal length by place. Any cut gives the same answer.
Work then happens per bucket, and one row per bucket carries the totals across. The number of buckets follows the
measured number of rows; there is no other plan for small input.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sizing import parts_for, placed
from tidemark.sources.scratch import materialise


def _order_value(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def with_buckets(df: DataFrame, order: Sequence[str], *, buckets: int) -> DataFrame:
    """Add ``_bucket``: buckets follow the order and hold the same number of rows, but for the last of a partition.

    Rows must be unique by order value within a key: rows of different keys with one value may fall into neighbouring
    buckets. The range partitioner's bounds come from a sample of at most a million rows, however many partitions there
    are; within a partition, places decide. Rows are stored, so the cut is made once.
    """
    if buckets == 1:
        return df.withColumn("_bucket", F.lit(0).cast("long"))
    rows = df.count()
    each = max(1, -(-rows // buckets))
    # The row counter starts each partition at a multiple of 2^33, so no bucket spans two partitions.
    return materialise(
        df.repartitionByRange(parts_for(rows), *order)
        .sortWithinPartitions(*order)
        .withColumn("_bucket", F.floor(F.monotonically_increasing_id() / F.lit(each)).cast("long"))
    )


def running_totals(
    df: DataFrame,
    *,
    order: Sequence[str],
    sums: Mapping[str, str],
    keys: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``{new_name: input_column}`` along ``order`` inside each key.

    Rows must be unique by keys and order; ``keys`` must be a bounded grid, such as scenarios.
    """
    keys = list(keys)
    df, buckets = placed(df, buckets)
    rows = with_buckets(df, order, buckets=buckets)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    offsets = totals.select(
        *keys, "_bucket", *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums]
    )
    joined = _join_on_grid(local, offsets, [*keys, "_bucket"])
    for name in sums:
        joined = joined.withColumn(name, F.col(name) + F.coalesce(F.col(f"_o_{name}"), F.lit(0))).drop(f"_o_{name}")
    return joined.drop("_bucket")


def select_ranks(
    df: DataFrame,
    *,
    value: Sequence[str],
    targets: Mapping[str, Callable[[Column], Column]],
    weight: str | None = None,
    keys: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """One row per key with, for each target, the value found at a zero-based rank.

    A target maps the total row count of the key to a rank. ``df`` holds distinct values per key; ``weight`` is
    how many original rows each stands for. Only buckets that contain a wanted rank are sorted. The output also
    carries ``_total``. Ranks outside the range give null. ``keys`` must be a bounded grid.
    """
    keys = list(keys)
    df, buckets = placed(df, buckets)
    rows = with_buckets(
        df.withColumn("_w", F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")),
        value,
        buckets=buckets,
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = _around_wanted_ranks(rows, keys, targets).withColumn("_end", F.col("_before") + F.sum("_w").over(inside))
    picked = [
        F.min(F.when(F.col("_end") > rank(F.col("_total")), _order_value(value))).alias(name)
        for name, rank in targets.items()
    ]
    return ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *picked)


def _around_wanted_ranks(
    rows: DataFrame, keys: list[str], targets: Mapping[str, Callable[[Column], Column]]
) -> DataFrame:
    """Rows of the buckets that contain a wanted rank, with the rows before the bucket and the total of the key."""
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.sum("_w").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_size").over(Window.partitionBy(*keys)))
    )
    wanted = F.lit(False)
    for rank in targets.values():
        at = rank(F.col("_total"))
        wanted = wanted | ((at >= F.col("_before")) & (at < F.col("_before") + F.col("_size")))
    # At most one bucket per target and key survives, so this side is tiny whatever the data size.
    chosen = F.broadcast(sizes.where(wanted).drop("_size"))
    return _join_on_grid(rows, chosen, [*keys, "_bucket"], how="inner")


def _join_on_grid(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    # Same columns as the preceding window, so the large side keeps its partitioning. Grid keys are never null.
    return left.join(right, on, how)
