"""Joins whose cardinality is part of the contract."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import join_unique


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``rows``, ``unique_keys``; equal numbers mean the key is unique."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("unique_keys")
    )


def unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """The rows as they are; a repeated key stops the plan that reads them.

    The check is a count over the key inside the plan. A join by the same key uses the same partitioning, so it adds no
    shuffle and no job. Rows with a null in the key match nothing and may repeat.
    """
    return _checked(df, keys, F.col("_n") == 1, f"{name} is not unique by {list(keys)}")


def _checked(df: DataFrame, keys: Sequence[str], rule: Column, message: str) -> DataFrame:
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counted = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.where(F.when(~present | rule, F.lit(True)).otherwise(F.raise_error(F.lit(message)))).drop("_n")


def one_to_one(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", *, keep_all_left: bool = False
) -> DataFrame:
    """Join in which a repeated key on either side stops the plan; optionally every left row must meet a right one."""
    if how not in ("inner", "left"):
        raise ValueError("one_to_one supports inner and left joins")
    left, right = unique(left, keys, "left side"), unique(right, keys, "right side")
    if not keep_all_left:
        return left.join(right, list(keys), how)
    joined = left.join(right.withColumn("_found", F.lit(True)), list(keys), "left")
    found = F.when(F.col("_found").isNotNull(), F.lit(True))
    return joined.where(found.otherwise(F.raise_error(F.lit(f"join lost rows: no partner by {list(keys)}")))).drop("_found")


def one_to_many(left: DataFrame, right: DataFrame, keys: Sequence[str], fan_out: int) -> DataFrame:
    """Left join in which every left key must be unique and meet exactly ``fan_out`` right rows; else the plan stops."""
    joined = unique(left, keys, "left side").join(right, list(keys), "left")
    return _checked(joined, keys, F.col("_n") == fan_out, f"a key does not have {fan_out} joined rows")


def matching(big: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``big`` whose key occurs in ``wanted`` (semi join), with hot keys of ``big`` cut into pieces."""
    return join_unique(big, wanted.select(*keys).distinct(), keys)


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a partner. Right keys are made distinct, and hot keys of ``left`` are cut into pieces."""
    known = right.select(*keys).distinct().withColumn("_known", F.lit(True))
    return join_unique(left, known, keys, "left").where(F.col("_known").isNull()).select(*left.columns)


def cardinality_change(source: DataFrame, output: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and unique keys before and after a step, in one row."""
    before = key_counts(source, keys).withColumnsRenamed({"rows": "source_rows", "unique_keys": "source_keys"})
    after = key_counts(output, keys).withColumnsRenamed({"rows": "output_rows", "unique_keys": "output_keys"})
    return before.crossJoin(after)


def compare_on_key(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """One row: keys on both sides, keys on one side only, and mismatches for each column (null-safe).

    Both sides must be unique by the keys: a repeated key stops the plan. Each side is collapsed by key first, so no key
    can multiply and a hot one arrives once per task.
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        values = F.min(F.struct(*columns))
        once = F.when(F.count(F.lit(1)) == 1, values).otherwise(F.raise_error(F.lit(f"a key is repeated: {list(keys)}")))
        return df.groupBy(*keys).agg(once.alias("_v")).select(
            *keys, *[F.col("_v")[c].alias(f"{prefix}{c}") for c in columns], F.lit(True).alias(f"{prefix}found")
        )

    joined = side(left, "_l_").join(side(right, "_r_"), list(keys), "full")
    on_left, on_right = F.col("_l_found").isNotNull(), F.col("_r_found").isNotNull()
    found = on_left & on_right
    return joined.agg(
        F.count_if(found).alias("matched_rows"),
        F.count_if(on_left & ~on_right).alias("unmatched_rows"),
        F.count_if(on_right & ~on_left).alias("extra_right_rows"),
        *[
            F.count_if(found & ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}"))).alias(f"{c}_mismatches")
            for c in columns
        ],
    )


def in_window(df: DataFrame, time: str, positive: Column) -> DataFrame:
    """Keep rows between the first and last time of the rows that satisfy ``positive``, both ends included."""
    bounds = df.where(positive).agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
    return (
        df.crossJoin(F.broadcast(bounds)).where(F.col(time).between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
    )
