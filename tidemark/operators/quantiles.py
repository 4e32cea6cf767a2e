"""Exact interpolated quantiles that stay distributed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import select_ranks


def exact_quantiles(
    df: DataFrame,
    *,
    value: str,
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles of the non-null values of ``value``, one row per key.

    The built-in ``percentile`` keeps a map of all distinct values of a group in one task. Here values are collapsed to
    counts and only the buckets around the wanted ranks are ordered. Keys without any value have no row; without keys
    there is always one row, with 0 ``value_rows`` and null quantiles if there is no value.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    targets = {}
    for name, p in probs.items():
        targets[f"_lo_{name}"] = lambda n, p=p: F.floor(F.lit(float(p)) * (n - 1).cast("double"))
        targets[f"_hi_{name}"] = lambda n, p=p: F.ceil(F.lit(float(p)) * (n - 1).cast("double"))
    ranks = select_ranks(counted, value=["_x"], targets=targets, weight="_c", keys=keys, buckets=buckets)
    outputs = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("_total") - 1).cast("double")
        share = position - F.floor(position).cast("double")
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outputs.append((low + (high - low) * share).alias(name))
    return ranks.select(*keys, F.coalesce("_total", F.lit(0)).alias("value_rows"), *outputs)


def unpivot_measures(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Turn measure columns into (``measure``, ``value``) rows so that one pass serves all of them."""
    wide = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
    return wide.unpivot(list(keys), list(measures), "measure", "value")


def finite_sum(value: Column) -> Column:
    """Sum of finite numbers: exact as a decimal where that has room for it, else the plain sum of doubles.

    The exact sum does not depend on how rows were partitioned; above 1e22 the last bits of the plain one may.
    """
    exact = F.try_sum(value.try_cast("decimal(38,16)")).cast("double")
    fits = F.coalesce(F.max(F.abs(value.cast("double"))) < F.lit(1e22), F.lit(True))
    return F.when(fits & exact.isNotNull(), exact).otherwise(F.sum(value.cast("double")))


def finite_summary(
    df: DataFrame, measures: Sequence[str], *, keys: Sequence[str] = (), probs: Mapping[str, float] | None = None
) -> DataFrame:
    """Count, mean, median and p90 of the finite values of each measure; an empty measure gives 0 and nulls."""
    probs = probs or {"median": 0.5, "p90": 0.9}
    keys = list(keys)
    tall = unpivot_measures(df, keys, measures).withColumn(
        "value",
        F.when(F.isnan("value") | (F.abs("value") == F.lit(float("inf"))), F.lit(None)).otherwise(F.col("value")),
    )
    basic = tall.groupBy(*keys, "measure").agg(
        F.count("value").alias("count"),
        (finite_sum(F.col("value")) / F.nullif(F.count("value"), F.lit(0))).alias("mean"),
    )
    quantiles = exact_quantiles(tall, value="value", probs=probs, keys=[*keys, "measure"]).drop("value_rows")
    return basic.join(quantiles, [*keys, "measure"], "left")
