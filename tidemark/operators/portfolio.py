"""Overlapping positions, equity curves and scenario grids.

Scenario keys form a small fixed grid. Rows are first summed per key and time, so the ordered part of the work
grows with the number of distinct times, and it is scanned bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.scan import running_totals, with_buckets
from tidemark.operators.sizing import placed

MONEY = "decimal(38,16)"


def peak_level(
    rows: DataFrame, *, start: str, end: str, level: str, name: str, keys: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Largest sum of ``level`` over positions open at once; at one instant exits come before entries."""
    keys = list(keys)
    amount = F.col(level).cast(MONEY)
    changes = rows.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(start).alias("time"), F.lit(1).alias("kind"), amount.alias("change")),
                F.struct(F.col(end).alias("time"), F.lit(0).alias("kind"), (-amount).cast(MONEY).alias("change")),
            )
        ).alias("e"),
    ).select(*keys, "e.*")
    # Within one instant and kind the level only moves one way, so the peak is at the end of the group.
    steps = changes.groupBy(*keys, "time", "kind").agg(F.sum("change").alias("change"))
    levels = running_totals(steps, order=["time", "kind"], sums={"level": "change"}, keys=keys, buckets=buckets)
    return levels.groupBy(*keys).agg(F.greatest(F.max("level"), F.lit(0)).cast("double").alias(name))


def equity_curve(
    rows: DataFrame,
    *,
    time: str,
    pnl: str,
    initial: DataFrame,
    initial_column: str,
    keys: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Per key and time: equity, the running peak including the starting capital, and the drawdown.

    ``initial`` has one row per key with the starting capital.
    """
    keys = list(keys)
    per_time = rows.groupBy(*keys, F.col(time).alias("time")).agg(F.sum(F.col(pnl).cast(MONEY)).alias("pnl"))
    return _curve(per_time, initial.withColumnRenamed(initial_column, "_initial").select(*keys, "_initial"), keys, keys, buckets)


def _curve(
    per_time: DataFrame, initial: DataFrame, keys: list[str], initial_keys: list[str], buckets: int | None = None
) -> DataFrame:
    per_time, buckets = placed(per_time, buckets)
    bucketed = with_buckets(per_time, ["time"], buckets=buckets)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    local = bucketed.withColumn("_sum", F.sum("pnl").over(inside)).withColumn("_top", F.max("_sum").over(inside))
    pieces = local.groupBy(*keys, "_bucket").agg(F.sum("pnl").alias("_s"), F.max("_sum").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        pieces.withColumn("_offset", F.coalesce(F.sum("_s").over(before), F.lit(0)))
        .withColumn("_reached", F.max(F.col("_offset") + F.col("_m")).over(before))
        .select(*keys, "_bucket", "_offset", "_reached")
    )
    joined = local.join(carried, [*keys, "_bucket"])
    start = F.broadcast(initial)  # one row per scenario of a fixed grid
    with_start = joined.join(start, initial_keys) if initial_keys else joined.crossJoin(start)
    begin = F.col("_initial").cast(MONEY)
    equity = begin + F.col("_offset") + F.col("_sum")
    peak = F.greatest(begin, begin + F.col("_reached"), begin + F.col("_offset") + F.col("_top"))
    return with_start.select(
        *keys,
        "time",
        "_initial",
        equity.cast("double").alias("equity"),
        peak.cast("double").alias("peak"),
        (peak - equity).cast("double").alias("drawdown"),  # exact before it is rounded to a double
    )


def _finite(name: str) -> Column:
    value = F.col(name).cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit(f"{name} must be finite in every row"))).otherwise(value)


def worst_drawdown(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ending and minimum equity, insolvency, and the largest drawdown with its fraction of the peak at that time.

    The fraction uses the peak at the first row that reaches the largest drawdown and may exceed one.
    """
    worst = F.max_by(F.struct("drawdown", "peak"), F.struct("drawdown", -F.col("time")))
    summary = curve.groupBy(*keys).agg(
        F.max_by("equity", "time").alias("ending_equity_usd"),
        F.min("equity").alias("minimum_equity_usd"),
        (F.min("equity") < 0).alias("insolvent_under_capital_model"),
        worst.alias("_worst"),
    )
    return summary.select(
        *keys,
        "ending_equity_usd",
        "minimum_equity_usd",
        "insolvent_under_capital_model",
        F.col("_worst.drawdown").alias("max_drawdown_usd"),
        F.try_divide(F.col("_worst.drawdown"), F.col("_worst.peak")).alias("max_drawdown_fraction"),
    )


def portfolio_grid(
    rows: DataFrame,
    fees: Mapping[str, float],
    *,
    notional: float,
    keys: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Weighted fixed-notional results for each scenario key and fee scenario (name to basis points).

    ``rows``: keys, ``population_weight``, ``gross_return``, ``entry_block_time``, ``exit_target_time``.
    One pass sums weights and weighted returns per key and exit time; a fee shifts every return by the same amount,
    so the fee grid is laid over those sums and over the quantiles, never over the rows. A row without a finite return or
    weight stops the plan: it would count in the weight but not in the sum.
    """
    keys = list(keys)
    grid = [*keys, "fee_scenario"]
    rows = rows.withColumns({c: _finite(c) for c in ("population_weight", "gross_return")})
    w, gross = F.col("population_weight"), F.col("gross_return")
    shift = {name: float(bps) / 10_000.0 for name, bps in fees.items()}
    per_exit = rows.groupBy(*keys, F.col("exit_target_time").alias("time")).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(w.cast(MONEY)).alias("_w"),
        F.sum((w * gross).cast(MONEY)).alias("_wg"),
        *[
            F.sum(F.when(gross - F.lit(s) > 0, w).otherwise(F.lit(0.0)).cast(MONEY)).alias(f"_hit_{i}")
            for i, s in enumerate(shift.values())
        ],
    )
    scenario = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("fee_scenario"),
                    F.lit(float(fees[name])).alias("fee_bps"),
                    F.lit(s).alias("shift"),
                    F.col(f"_hit_{i}").alias("hit"),
                )
                for i, (name, s) in enumerate(shift.items())
            ]
        )
    )
    spread = per_exit.withColumn("_f", scenario).select(*keys, "_f.*", "time", "_rows", "_w", "_wg")
    basic = spread.groupBy(*grid, "fee_bps", "shift").agg(
        F.sum("_rows").alias("executed_sample_rows"),
        F.sum("_w").cast("double").alias("_w"),
        F.sum("_wg").cast("double").alias("_wg"),
        F.sum("hit").cast("double").alias("_hit"),
    )
    quantiles = exact_quantiles(
        rows, value="gross_return", probs={"_q50": 0.5, "_q90": 0.9, "_q99": 0.99}, keys=keys, buckets=buckets
    ).drop("value_rows")
    peaks = peak_level(
        rows, start="entry_block_time", end="exit_target_time", level="population_weight",
        name="max_concurrent_weighted_positions", keys=keys, buckets=buckets,
    )
    # Decimal products would lose scale; both sums are exact, so this product is the same on every run.
    pnl = (F.col("_wg").cast("double") - F.col("_w").cast("double") * F.col("shift")) * F.lit(float(notional))
    timeline = spread.select(*grid, "time", pnl.cast(MONEY).alias("pnl"))
    # One row per scenario key of a fixed grid.
    initial = peaks.select(
        *keys, (F.lit(float(notional)) * F.col("max_concurrent_weighted_positions")).alias("_initial")
    )
    drawdown = worst_drawdown(_curve(timeline, initial, grid, keys, buckets), grid)
    on_keys = lambda left, right: left.join(right, keys) if keys else left.crossJoin(right)
    joined = on_keys(on_keys(basic, quantiles), peaks).join(drawdown, grid)
    weight, mean = F.col("_w"), F.col("_wg") / F.col("_w")
    return joined.select(
        *grid,
        "fee_bps",
        "executed_sample_rows",
        weight.alias("executed_population_weight"),
        mean.alias("gross_mean_return"),
        F.col("_q50").alias("gross_median_return_unweighted"),
        F.col("_q90").alias("gross_p90_return_unweighted"),
        F.col("_q99").alias("gross_p99_return_unweighted"),
        (mean - F.col("shift")).alias("net_mean_return"),
        (F.col("_q50") - F.col("shift")).alias("net_median_return_unweighted"),
        (F.col("_hit") / weight).alias("net_hit_rate"),
        (weight * F.lit(float(notional))).alias("total_weighted_notional_usd"),
        ((F.col("_wg") - weight * F.col("shift")) * F.lit(float(notional))).alias("total_weighted_pnl_usd"),
        "max_concurrent_weighted_positions",
        (F.lit(float(notional)) * F.col("max_concurrent_weighted_positions")).alias("initial_capital_usd"),
        "ending_equity_usd",
        "minimum_equity_usd",
        "insolvent_under_capital_model",
        "max_drawdown_usd",
        "max_drawdown_fraction",
    )


def by_policy(rows: DataFrame) -> DataFrame:
    """Repeat each row for the execution policies it satisfies."""
    both = F.array(F.lit("all_observed_proxy"), F.lit("exact_target_slot_only"))
    one = F.array(F.lit("all_observed_proxy"))
    exact = F.col("wait_slots_beyond_target") == 0
    return rows.withColumn("execution_policy", F.explode(F.when(exact, both).otherwise(one)))
