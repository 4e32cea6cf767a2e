"""Class profiles, identity and clock audits, and rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quality import count_where
from tidemark.operators.quantiles import exact_quantiles, unpivot_measures
from tidemark.operators.scan import running_totals
from tidemark.operators.skew import join_unique

PROFILE_PROBS = {"p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99}


def class_profiles(df: DataFrame, features: Sequence[str], *, label: str = "label", scale: float = 1.0) -> DataFrame:
    """Per feature and class: rows, missing and zero shares, and quantiles of the finite values."""
    tall = unpivot_measures(df, [label], features).withColumn(
        "value",
        F.when(~(F.isnan("value") | (F.abs("value") == F.lit(float("inf")))), F.col("value") / F.lit(float(scale))),
    )
    keys = ["measure", label]
    shares = tall.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col("value").isNull().cast("double")).alias("missing_fraction"),
        F.avg(F.coalesce((F.col("value") == 0).cast("double"), F.lit(0.0))).alias("zero_fraction"),
    )
    quantiles = exact_quantiles(tall, value="value", probs=PROFILE_PROBS, keys=keys).drop("value_rows")
    return shares.join(quantiles, keys, "left")


def identity_audit(df: DataFrame, signer: str, creator: str, label: str = "label") -> DataFrame:
    """How often two identity columns are filled and equal; they are never treated as the same key."""
    filled = F.col(creator).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col(signer).isNotNull().cast("double")).alias("signer_nonnull_fraction"),
        F.count_if(filled).alias("creator_nonnull_rows"),
        F.avg(filled.cast("double")).alias("creator_nonnull_fraction"),
        F.avg(F.when(filled, F.coalesce((F.col(signer) == F.col(creator)).cast("double"), F.lit(0.0)))).alias(
            "signer_equals_creator_fraction"
        ),
        F.count_if(filled & (F.col(label) == 1)).alias("positive_creator_nonnull_rows"),
        F.count_if(filled & (F.col(label) == 0)).alias("negative_creator_nonnull_rows"),
    )


def clock_mismatch(
    df: DataFrame, *, stored_hour: str, stored_weekday: str, hour: str, weekday: str, label: str = "label"
) -> DataFrame:
    """Per class: stored clock columns that differ from the derived ones, and the hour offsets seen."""
    offset = F.pmod(F.col(stored_hour) - F.col(hour), F.lit(24))
    # A set of at most 24 values.
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("rows"),
        count_where(F.col(stored_hour) != F.col(hour)).alias("hour_mismatch_rows"),
        count_where(F.col(stored_weekday) != F.col(weekday)).alias("weekday_mismatch_rows"),
        F.array_join(F.sort_array(F.collect_set(offset.cast("int"))), ",").alias("hour_offsets"),
    )


def spearman(
    df: DataFrame, x: str, y: str, *, rows_per_task: int | None = None, buckets: int | None = None
) -> DataFrame:
    """Rank correlation with average ranks for ties, on rows where both values are present.

    Pairs are collapsed to counts, ranks come from running totals over distinct values, and a value shared by many
    pairs is joined in pieces.
    """
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    spread = F.xxhash64("_x", "_y")
    ranked = join_unique(pairs, _average_ranks(pairs, "_x", "_rx", buckets), ["_x"], spread=spread, rows_per_task=rows_per_task)
    ranked = join_unique(ranked, _average_ranks(pairs, "_y", "_ry", buckets), ["_y"], spread=spread, rows_per_task=rows_per_task)
    n, rx, ry = F.col("_n").cast("double"), F.col("_rx"), F.col("_ry")
    sums = ranked.agg(
        F.sum("_n").alias("rows"),
        *[
            F.sum(term.cast("decimal(38,4)")).cast("double").alias(name)  # ranks are halves, so the sums are exact
            for name, term in (("sx", n * rx), ("sy", n * ry), ("sxx", n * rx * rx), ("syy", n * ry * ry), ("sxy", n * rx * ry))
        ],
    )
    rows = F.col("rows").cast("double")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / rows
    spread_xy = F.sqrt(
        (F.col("sxx") - F.col("sx") * F.col("sx") / rows) * (F.col("syy") - F.col("sy") * F.col("sy") / rows)
    )
    return sums.select("rows", F.try_divide(cov, spread_xy).alias("spearman"))


def _average_ranks(pairs: DataFrame, value: str, rank: str, buckets: int | None) -> DataFrame:
    per_value = pairs.groupBy(value).agg(F.sum("_n").alias("_count"))
    ranked = running_totals(per_value, order=[value], sums={"_end": "_count"}, buckets=buckets)
    return ranked.select(value, (F.col("_end") - (F.col("_count") - 1) / F.lit(2.0)).alias(rank))
