"""Comparing selections and result tables, and decisions over result rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the scenarios a gate looks at.
ALL_OBSERVED = "all_observed_proxy"
GROSS_FEE = "gross"
MEDIAN_FEE = "training_median_fee"
P90_FEE = "training_p90_fee"

# The largest tolerated loss, and the decisions a gate can report.
NONINFERIORITY_MARGIN = 0.002
IMPROVES_ALL = "supported_improves_all_development_checks"
WITHIN_MARGIN = "retained_semantically_within_noninferiority_margin"
BEYOND_MARGIN = "rejected_exceeds_noninferiority_margin"
NOT_CONSISTENT = "rejected_not_consistent_across_development_checks"
NONINFERIOR = "supported_within_predeclared_noninferiority_margin"
INFERIOR = "rejected_proxy_exceeds_noninferiority_margin"
ONLY_DELAY_ZERO = "supported_only_requested_delay_zero_is_viable"
OTHER_DELAYS = "rejected_viable_delay_set_differs_from_zero_only"
POSITION_ROBUST = "supported_position_lag_remains_fee_robust_and_solvent"
POSITION_FAILS = "rejected_position_lag_fails_fee_robust_capital_criterion"
BACKTEST_SUPPORTED = "supported_on_predeclared_development_backtest_criterion"
BACKTEST_REJECTED = "rejected_on_predeclared_development_backtest_criterion"
FEASIBLE = "supported_fee_robust_position_lag_feasibility_on_development"
INFEASIBLE = "rejected_fee_robust_position_lag_feasibility_on_development"
CLOCK_FIX = "required_integrity_fix"
CLOCK_CONSISTENT = "already_consistent"
PROFITABLE = "supported_on_development_and_full_descriptive"
UNPROFITABLE = "rejected_recorded_fees_remove_development_profitability"


def selection_overlap(
    left: DataFrame, right: DataFrame, *, key: str = "token_address", weight: str = "population_weight"
) -> DataFrame:
    """Sizes, weights, intersection, union, differences and Jaccard index of two selections, in one row.

    The sides are stacked and flagged per key, so one exchange replaces a full outer join.
    """
    tagged = left.select(key, F.col(weight).alias("_lw"), F.lit(None).cast("double").alias("_rw")).unionAll(
        right.select(key, F.lit(None).cast("double").alias("_lw"), F.col(weight).alias("_rw"))
    )
    per_key = tagged.groupBy(key).agg(F.sum("_lw").alias("_lw"), F.sum("_rw").alias("_rw"))
    in_left, in_right = F.col("_lw").isNotNull(), F.col("_rw").isNotNull()
    sizes = per_key.agg(
        F.count_if(in_left).alias("left_rows"),
        F.coalesce(F.sum("_lw"), F.lit(0.0)).alias("left_weight"),
        F.count_if(in_right).alias("right_rows"),
        F.coalesce(F.sum("_rw"), F.lit(0.0)).alias("right_weight"),
        F.count_if(in_left & in_right).alias("intersection_rows"),
        F.count(F.lit(1)).alias("union_rows"),
        F.count_if(in_left & ~in_right).alias("left_only_rows"),
        F.count_if(in_right & ~in_left).alias("right_only_rows"),
    )
    return sizes.withColumn(
        "jaccard", F.try_divide(F.col("intersection_rows").cast("double"), F.col("union_rows").cast("double"))
    )


def side_by_side(
    left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str], *, names: tuple[str, str],
    same_keys: bool = True,
) -> DataFrame:
    """Two result tables on their scenario key with ``<right>_minus_<left>`` deltas.

    Key sets must be equal, else the plan stops; with ``same_keys`` off, a key of one side has nulls for the other.
    """
    a, b = names
    one = left.select(*keys, *[F.col(m).alias(f"{a}_{m}") for m in measures], F.lit(True).alias("_in_l"))
    two = right.select(*keys, *[F.col(m).alias(f"{b}_{m}") for m in measures], F.lit(True).alias("_in_r"))
    joined = one.join(two, list(keys), "full")
    complete = F.lit(not same_keys) | (F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull())
    deltas = [(F.col(f"{b}_{m}") - F.col(f"{a}_{m}")).alias(f"{b}_minus_{a}_{m}") for m in measures]
    guarded = joined.withColumn(
        "_ok", F.when(complete, F.lit(1)).otherwise(F.raise_error(F.lit("result grids differ")))
    ).where(F.col("_ok") == 1)
    return guarded.select(
        *keys, *[f"{a}_{m}" for m in measures], *[f"{b}_{m}" for m in measures], *deltas
    )


def results_match(left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Per row of a result table whether every measure equals the frozen table's, null-safe."""
    other = right.select(*keys, *[F.col(m).alias(f"_r_{m}") for m in measures], F.lit(True).alias("_found"))
    equal = F.col("_found").isNotNull()
    for m in measures:
        equal = equal & F.col(m).eqNullSafe(F.col(f"_r_{m}"))
    return left.join(other, list(keys), "full").select(*keys, F.coalesce(equal, F.lit(False)).alias("matches"))


def fold_summary(deltas: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    """Mean, median, extremes and number of positive deltas over folds (a handful of rows per variant)."""
    return deltas.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fold_count"),
        F.avg(value).alias("mean_delta"),
        F.median(value).alias("median_delta"),
        F.min(value).alias("minimum_delta"),
        F.max(value).alias("maximum_delta"),
        F.count_if(F.col(value) > 0).alias("positive_fold_count"),
    )


def improvement_gate(deltas: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    """Supported only when every check improves; retained when no loss exceeds the margin; otherwise rejected."""
    checks = deltas.groupBy(*keys).agg(
        F.bool_and(F.col(value) > 0).alias("improves_all"), F.min(value).alias("minimum_delta")
    )
    decision = (
        F.when(F.col("improves_all"), IMPROVES_ALL)
        .when(
            F.col("minimum_delta") >= -NONINFERIORITY_MARGIN, WITHIN_MARGIN
        )
        .otherwise(BEYOND_MARGIN)
    )
    return checks.withColumn("decision", decision)


def strict_improvement_gate(deltas: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    return deltas.groupBy(*keys).agg(
        F.when(F.bool_and(F.col(value) > 0), IMPROVES_ALL)
        .otherwise(NOT_CONSISTENT)
        .alias("decision")
    )


def noninferiority_gate(deltas: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    return deltas.groupBy(*keys).agg(
        F.when(F.min(value) >= -NONINFERIORITY_MARGIN, NONINFERIOR)
        .otherwise(INFERIOR)
        .alias("decision")
    )


def _one_row(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def _incomplete(text: str | None, message: str) -> Column:
    """What an incomplete grid gives: an error, or a decision text where the caller wants one."""
    return F.raise_error(F.lit(message)) if text is None else F.lit(text)


def delay_gate(grid: DataFrame, keys: Sequence[str] = (), *, incomplete: str | None = None) -> DataFrame:
    """Viable delays under median fees and all observed entries must be exactly zero.

    A grid without all three delays stops the plan, or gives ``incomplete`` as decision.
    """
    primary = grid.where(
        (F.col("execution_policy") == ALL_OBSERVED) & (F.col("fee_scenario") == MEDIAN_FEE)
    )
    viable = (
        (F.col("net_mean_return") > 0)
        & (F.col("net_median_return_unweighted") > 0)
        & ~F.col("insolvent_under_capital_model")
    )
    delay = F.col("requested_delay_slots").cast("int")
    sets = _one_row(
        primary,
        keys,
        {
            "_all": F.sort_array(F.collect_set(delay)),
            "_viable": F.sort_array(F.collect_set(F.when(viable, delay))),
        },
    )
    complete = F.col("_all") == F.array(F.lit(0), F.lit(1), F.lit(2))
    decision = F.when(
        ~complete, _incomplete(incomplete, "results must contain exactly the delays 0, 1 and 2")
    ).otherwise(
        F.when(F.col("_viable") == F.array(F.lit(0)), ONLY_DELAY_ZERO).otherwise(
            OTHER_DELAYS
        )
    )
    return sets.select(*keys, F.array_join("_viable", ",").alias("viable_delays"), decision.alias("decision"))


def position_gate(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median-fee mean and median must be positive and the capital path solvent."""
    rows = grid.where(F.col("fee_scenario") == MEDIAN_FEE)
    passed = (
        (F.col("net_mean_return") > 0)
        & (F.col("net_median_return_unweighted") > 0)
        & ~F.col("insolvent_under_capital_model")
    )
    counted = _one_row(rows, keys, {"_n": F.count(F.lit(1)), "all_checks_passed": F.bool_and(passed)})
    decision = F.when(
        F.col("_n") != 1, F.raise_error(F.lit("results must contain one median-fee row"))
    ).otherwise(
        F.when(F.col("all_checks_passed"), POSITION_ROBUST).otherwise(
            POSITION_FAILS
        )
    )
    return counted.select(*keys, "all_checks_passed", decision.alias("decision"))


def replica_comparison_gate(
    comparison: DataFrame, keys: Sequence[str] = (), *, names: tuple[str, str], incomplete: str | None = None
) -> DataFrame:
    """At least two delays improve, delay zero stays solvent, and no delay becomes newly insolvent."""
    a, b = names
    delay = F.col("requested_delay_slots").cast("int")
    checks = _one_row(
        comparison,
        keys,
        {
            "_all": F.sort_array(F.collect_set(delay)),
            "improved_delay_count": F.count_if(F.col(f"{b}_net_mean_return") > F.col(f"{a}_net_mean_return")),
            "zero_slot_solvent": F.bool_and(
                F.when(delay == 0, ~F.col(f"{b}_insolvent_under_capital_model")).otherwise(F.lit(True))
            ),
            "left_insolvent_delay_count": F.count_if(F.col(f"{a}_insolvent_under_capital_model")),
            "right_insolvent_delay_count": F.count_if(F.col(f"{b}_insolvent_under_capital_model")),
        },
    )
    passed = (
        (F.col("improved_delay_count") >= 2)
        & F.col("zero_slot_solvent")
        & (F.col("right_insolvent_delay_count") <= F.col("left_insolvent_delay_count"))
    )
    decision = F.when(
        F.col("_all") != F.array(F.lit(0), F.lit(1), F.lit(2)),
        _incomplete(incomplete, "comparison must contain exactly the delays 0, 1 and 2"),
    ).otherwise(
        F.when(passed, BACKTEST_SUPPORTED).otherwise(
            BACKTEST_REJECTED
        )
    )
    return checks.withColumn("decision", decision).drop("_all")


def fee_robust_gate(comparison: DataFrame, keys: Sequence[str] = (), *, names: tuple[str, str]) -> DataFrame:
    """Six checks over the gross, median-fee and p90-fee rows of a comparison."""
    a, b = names
    fee = F.col("fee_scenario")
    at = lambda scenario, rule: F.bool_or((fee == scenario) & rule)
    solvent = ~F.col(f"{b}_insolvent_under_capital_model")
    profit = F.col(f"{b}_net_mean_return") > 0
    median, p90 = MEDIAN_FEE, P90_FEE
    checks = _one_row(
        comparison,
        keys,
        {
            "_all": F.sort_array(F.collect_set(fee)),
            "median_fee_positive_net_mean": at(median, profit),
            "p90_fee_positive_net_mean": at(p90, profit),
            "median_fee_solvent": at(median, solvent),
            "p90_fee_solvent": at(p90, solvent),
            "median_fee_mean_improves": at(median, F.col(f"{b}_net_mean_return") > F.col(f"{a}_net_mean_return")),
            "median_fee_drawdown_improves": at(
                median, F.col(f"{b}_max_drawdown_fraction") < F.col(f"{a}_max_drawdown_fraction")
            ),
        },
    )
    passed = F.lit(True)
    for name in checks.columns:
        if name not in (*keys, "_all"):
            passed = passed & F.col(name)
    decision = F.when(
        F.col("_all") != F.array(F.lit(GROSS_FEE), F.lit(median), F.lit(p90)),
        F.raise_error(F.lit("comparison must contain exactly the three fee scenarios")),
    ).otherwise(
        F.when(passed, FEASIBLE).otherwise(
            INFEASIBLE
        )
    )
    return checks.withColumn("decision", decision).drop("_all")


def dominance_gate(importance: DataFrame, drops: DataFrame, name: str) -> DataFrame:
    """A group dominates when it ranks first, is positive in every fold and is the largest in every fold."""
    top = drops.groupBy("fold").agg(F.max_by("name", F.struct("delta", "name")).alias("_top"))
    every = top.agg(F.bool_and(F.col("_top") == name).alias("top_in_all_folds"))
    row = importance.where(F.col("name") == name)
    return row.crossJoin(every).select(
        "name",
        "rank",
        "top_in_all_folds",
        F.when(
            (F.col("rank") == 1)
            & (F.col("positive_fold_count") == F.col("fold_count"))
            & F.col("top_in_all_folds"),
            F.concat(F.lit("supported_"), "name", F.lit("_is_dominant")),
        )
        .otherwise(F.concat(F.lit("not_supported_"), "name", F.lit("_is_not_consistently_dominant")))
        .alias("decision"),
    )


def clock_gate(mismatch: DataFrame) -> DataFrame:
    total = mismatch.agg(
        F.sum("hour_mismatch_rows").alias("hour_mismatch_rows"),
        F.sum("weekday_mismatch_rows").alias("weekday_mismatch_rows"),
    )
    return total.withColumn(
        "decision",
        F.when(
            (F.col("hour_mismatch_rows") > 0) | (F.col("weekday_mismatch_rows") > 0), CLOCK_FIX
        ).otherwise(CLOCK_CONSISTENT),
    )


def profitability_gate(portfolio: DataFrame) -> DataFrame:
    profitable = (F.col("net_pnl_usd") > 0) & (F.col("net_mean_roi") > 0) & (F.col("net_median_roi") > 0)
    return portfolio.withColumn(
        "decision",
        F.when(profitable, PROFITABLE).otherwise(
            UNPROFITABLE
        ),
    )
