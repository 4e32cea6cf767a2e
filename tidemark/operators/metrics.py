"""Population-weighted ranking metrics.

All of them start from the scores collapsed to one row per distinct score, so ties are handled once and the
ordered part is a bucketed running total. ``keys`` lets many variants be measured in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import running_totals
from tidemark.operators.sizing import placed

WEIGHT = "decimal(38,16)"


def pr_curve(
    scored: DataFrame,
    *,
    label: str = "label",
    score: str = "probability",
    weight: str = "population_weight",
    keys: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """One row per distinct score used as threshold: weighted true and false positives, precision, recall, F1."""
    keys = list(keys)
    w = F.col(weight).cast(WEIGHT)
    zero = F.lit(0).cast(WEIGHT)
    per_score = scored.groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(zero)).alias("_p"),
        F.sum(F.when(F.col(label) == 1, zero).otherwise(w)).alias("_q"),
    )
    # Scores are collapsed once; bounds, totals and positives all come from the stored rows.
    per_score, buckets = placed(per_score, buckets)
    totals = per_score.groupBy(*keys).agg(F.sum("_p").alias("_positives"))
    ranked = running_totals(
        per_score.withColumn("_down", -F.col("threshold")), order=["_down"], sums={"_tp": "_p", "_fp": "_q"}, keys=keys, buckets=buckets
    )
    # One row per variant.
    ranked = ranked.join(F.broadcast(totals), keys) if keys else ranked.crossJoin(F.broadcast(totals))
    tp, fp = F.col("_tp").cast("double"), F.col("_fp").cast("double")
    positives = F.col("_positives").cast("double")
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, positives), F.lit(1.0))
    return ranked.select(
        *keys,
        "threshold",
        tp.alias("true_positive_weight"),
        fp.alias("false_positive_weight"),
        (F.coalesce(F.try_divide(F.col("_p").cast("double"), positives), F.lit(0.0))).alias("recall_gain"),
        precision.alias("precision"),
        recall.alias("recall"),
        (F.lit(2.0) * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).alias("f1"),
    )


def average_precision(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Step-wise area: recall gained at a threshold times the precision there, without interpolation."""
    return curve.groupBy(*keys).agg(_area().alias("average_precision"))


def _area() -> Column:
    """Sum of the steps as decimals, so that it doesn't depend on the order in which tasks add them."""
    return F.sum((F.col("recall_gain") * F.col("precision")).cast("decimal(38,30)")).cast("double")


def best_f1(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Operating point with the largest F1; among equals the lowest threshold."""
    point = F.max_by(
        F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("threshold"))
    )
    return curve.groupBy(*keys).agg(point.alias("_b")).select(*keys, "_b.*")


def threshold_metrics(
    scored: DataFrame,
    threshold: float | str,
    *,
    label: str = "label",
    score: str = "probability",
    weight: str = "population_weight",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Weighted precision, recall and F1 when rows with ``score >= threshold`` are selected; 0 where undefined."""
    cut = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else F.col(threshold)
    w, positive, chosen = F.col(weight).cast(WEIGHT), F.col(label) == 1, F.col(score) >= cut
    total = lambda rule: F.sum(F.when(rule, w).otherwise(F.lit(0).cast(WEIGHT))).cast("double")
    sums = scored.groupBy(*keys).agg(
        total(chosen & positive).alias("_tp"),
        total(chosen & ~positive).alias("_fp"),
        total(~chosen & positive).alias("_fn"),
        F.max(cut).alias("threshold"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    return sums.select(
        *keys,
        "threshold",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def calibration(
    scored: DataFrame,
    *,
    label: str = "label",
    score: str = "probability",
    weight: str = "population_weight",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Weighted Brier score and weighted share of positives."""
    w, y = F.col(weight).cast("double"), F.col(label).cast("double")
    exact = lambda c: F.sum(c.cast(WEIGHT)).cast("double")
    error = (F.col(score) - y) * (F.col(score) - y)
    return scored.groupBy(*keys).agg(
        (exact(w * error) / exact(w)).alias("brier_score"), (exact(w * y) / exact(w)).alias("prevalence")
    )


def evaluate(
    scored: DataFrame,
    *,
    label: str = "label",
    score: str = "probability",
    weight: str = "population_weight",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Average precision, prevalence, Brier score and best operating point for each variant."""
    keys = list(keys)
    curve = pr_curve(scored, label=label, score=score, weight=weight, keys=keys)
    summary = curve.groupBy(*keys).agg(
        _area().alias("average_precision"),
        F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("threshold"))).alias("_b"),
    ).select(*keys, "average_precision", "_b.*")
    others = calibration(scored, label=label, score=score, weight=weight, keys=keys)
    return summary.join(others, keys) if keys else summary.crossJoin(others)
