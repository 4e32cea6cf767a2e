"""Hot-key handling shared by joins and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialise

# A key is hot when it holds more rows than one task should take. There are at most total / ROWS_PER_TASK hot keys, and
# the threshold never falls below total / MAX_HOT_KEYS, which holds the list to a size that can be broadcast; below
# 2e12 rows it plays no part.
MAX_HOT_KEYS = 1_000_000
ROWS_PER_TASK = 2_000_000
MIN_SLOTS = 1024
MAX_SLOTS = 1 << 20


def hot_keys(
    df: DataFrame, keys: Sequence[str], *, rows_per_task: int | None = None, max_hot_keys: int = MAX_HOT_KEYS
) -> DataFrame | None:
    """Keys too large for one task, with the number of ``_splits`` each should be cut into; None when there are none.

    A table with no more rows than a task should take has no hot key; this is counted, not guessed. Otherwise one job
    counts rows per hash slot of the keys, far fewer than there are keys, so that next to nothing is exchanged. A hot key
    makes its slot hot: only the keys of such slots are counted one by one, and at most ``max_hot_keys`` rows written.
    """
    size = df.count()
    if size <= (rows_per_task or ROWS_PER_TASK):
        return None
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    # At eight slots for each task's worth of rows, a slot without a hot key holds about an eighth of the limit.
    wanted = min(MAX_SLOTS, max(MIN_SLOTS, 8 * size // (rows_per_task or ROWS_PER_TASK)))
    slot = F.pmod(F.xxhash64(*keys), F.lit(wanted))
    slots = materialise(df.where(present).groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")))
    total = slots.agg(F.sum("_n").alias("_total"))
    limit = F.greatest(F.lit(rows_per_task or ROWS_PER_TASK), F.ceil(F.col("_total") / F.lit(max_hot_keys)))
    crowded = slots.crossJoin(F.broadcast(total)).where(F.col("_n") > limit).select("_slot", "_total")
    if crowded.isEmpty():
        return None
    counts = (
        df.where(present)
        .join(F.broadcast(crowded.drop("_total")), slot == F.col("_slot"), "left_semi")  # at most MAX_SLOTS rows
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    hot = (
        counts.crossJoin(F.broadcast(total))
        .where(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_splits"))
    )
    found = materialise(hot)
    return None if found.isEmpty() else found


def join_unique(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    spread: Column | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Join ``big`` with a table that has one row per key (or a few, fixed in number), cutting hot keys into pieces.

    Only the rows of ``small`` for hot keys are repeated (once per piece), so the extra volume is bounded by
    the number of pieces. ``spread`` chooses the piece of a row, such as a hash of identifying columns. The default is a
    row counter, which also spreads exact copies; ``big`` is then written first if it has a hot key, so that a task that
    runs again after a lost executor counts the same rows in the same order.
    """
    if how not in ("inner", "left"):
        raise ValueError("join_unique supports inner and left joins")
    hot = hot_keys(big, keys, rows_per_task=rows_per_task)
    if hot is None:
        return big.join(small, list(keys), how)
    if spread is None:
        big = materialise(big)
    hot = F.broadcast(hot)  # at most MAX_HOT_KEYS rows
    pieces = F.coalesce(F.col("_splits"), F.lit(1))
    left = (
        big.withColumn("_piece", F.monotonically_increasing_id() if spread is None else spread)
        .join(hot, list(keys), "left")
        .withColumn("_piece", F.pmod(F.col("_piece"), pieces).cast("int"))
        .drop("_splits")
    )
    right = (
        small.join(hot, list(keys), "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("_splits")
    )
    return left.join(right, [*keys, "_piece"], how).drop("_piece")
