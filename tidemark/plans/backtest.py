"""From selected decisions to a scenario grid: entries, exits, returns, portfolio results and a decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.derived import population_weight
from tidemark.operators.asof import first_at_or_after, first_in_slot_from, last_within_hold
from tidemark.operators.compare import (
    delay_gate,
    fee_robust_gate,
    replica_comparison_gate,
    selection_overlap,
    side_by_side,
)
from tidemark.operators.joins import in_window
from tidemark.operators.metrics import best_f1, pr_curve
from tidemark.operators.portfolio import by_policy, portfolio_grid
from tidemark.operators.quality import backtest_row_integrity, guarded, position_entry_integrity
from tidemark.operators.quantiles import exact_quantiles, unpivot_measures
from tidemark.operators.splits import require_both_classes, require_sealed, three_way_split
from tidemark.plans.models import ModelSpec, fit
from tidemark.sources.scratch import materialise


def select_above(
    scored: DataFrame, threshold: float | Column, *, time: str = "decision_time", start: object = None,
    holdout_start: object = None,
) -> DataFrame:
    """Rows whose score reaches the threshold inside the development window ``start <= time < holdout_start``."""
    rows = scored.where(F.col("probability") >= threshold)
    if start is not None:
        rows = rows.where(F.col(time) >= start)
    if holdout_start is not None:
        rows = rows.where(F.col(time) < holdout_start)
    return rows


def _eligible(hold_seconds: int, outcome_cutoff: int | Column) -> Column:
    return F.col("covered") & (F.col("entry_block_time") + F.lit(hold_seconds) < outcome_cutoff)


def mark_returns(
    entries: DataFrame, facts: DataFrame, *, hold_seconds: int, outcome_cutoff: int | Column, order: Sequence[str],
    payload: Sequence[str], every: bool = False,
) -> DataFrame:
    """Keep entries whose hold ends before the cutoff, mark the exit and compute the gross return.

    With ``every``, the other entries stay too, without exit and return.
    """
    eligible = _eligible(hold_seconds, outcome_cutoff)
    marked = last_within_hold(
        (entries if every else entries.where(eligible)).withColumn(
            "exit_target_time", F.col("entry_block_time") + F.lit(hold_seconds)
        ),
        facts, hold_seconds=hold_seconds, order=order, payload=payload, outcome_cutoff=outcome_cutoff, eligible=eligible,
    )
    return marked.withColumns(
        {
            "gross_return": F.col("exit_price_usd") / F.col("entry_price_usd") - 1,
            "mark_staleness_seconds": F.col("exit_target_time") - F.col("exit_block_time"),
        }
    )


def replica_backtest(
    selected: DataFrame, facts: DataFrame, fees: Mapping[str, float], *, notional: float, hold_seconds: int,
    outcome_cutoff: int | Column, order: Sequence[str], payload: Sequence[str], delays: Sequence[int] = (0, 1, 2),
) -> tuple[DataFrame, DataFrame]:
    """Marked rows and the delay x policy x fee grid with coverage and delay statistics.

    Entries and marks are one plan, so that the facts are exchanged once. The marked rows, which feed every column of the
    grid, are materialised. Every decision is attempted once for each delay.
    """
    marked = _replica_rows(
        selected, facts, hold_seconds=hold_seconds, outcome_cutoff=outcome_cutoff, order=order, payload=payload,
        delays=delays,
    )
    keys = ["requested_delay_slots", "execution_policy"]
    rows = by_policy(marked)
    attempts = selected.agg(
        F.count(F.lit(1)).alias("attempted_sample_rows"), F.sum("population_weight").alias("attempted_population_weight")
    ).select(F.explode(F.array(*[F.lit(d) for d in delays])).alias("requested_delay_slots"), "*")
    waits = exact_quantiles(
        unpivot_measures(rows, keys, ["actual_delay_slots", "wait_slots_beyond_target"]),
        value="value", probs={"median": 0.5, "p90": 0.9}, keys=[*keys, "measure"],
    )
    of = lambda measure, stat: F.max(F.when(F.col("measure") == measure, F.col(stat)))
    wait_columns = waits.groupBy(*keys).agg(
        *[of(m, s).alias(f"{m}_{s}") for m in ("actual_delay_slots", "wait_slots_beyond_target") for s in ("median", "p90")]
    )
    most = rows.groupBy(*keys).agg(
        F.max("actual_delay_slots").alias("actual_delay_slots_max"),
        F.max("wait_slots_beyond_target").alias("wait_slots_beyond_target_max"),
    )
    grid = (
        portfolio_grid(rows, fees, notional=notional, keys=keys)
        .join(attempts, "requested_delay_slots")
        .join(wait_columns, keys)
        .join(most, keys)
        .withColumns(
            {
                "coverage_rate_sampled": F.col("executed_sample_rows") / F.col("attempted_sample_rows"),
                "coverage_rate_population_weighted": F.col("executed_population_weight")
                / F.col("attempted_population_weight"),
            }
        )
    )
    return marked, grid


def _replica_rows(
    selected: DataFrame, facts: DataFrame, *, hold_seconds: int, outcome_cutoff: int | Column, order: Sequence[str],
    payload: Sequence[str], delays: Sequence[int] = (0, 1, 2),
) -> DataFrame:
    """Checked marked rows of all delays, written once."""
    marked = materialise(
        mark_returns(
            first_at_or_after(selected, facts, order=order, payload=payload, delays=delays), facts,
            hold_seconds=hold_seconds, outcome_cutoff=outcome_cutoff, order=order, payload=payload,
        )
    )
    return guarded(
        marked,
        backtest_row_integrity(marked, hold_seconds=hold_seconds, outcome_cutoff=outcome_cutoff, position=order),
        "backtest rows",
    )


def paired_replica_grid(
    selected: DataFrame, facts: DataFrame, fees: Mapping[str, float], *, selectors: str = "selectors", notional: float,
    hold_seconds: int, outcome_cutoff: int | Column, order: Sequence[str], payload: Sequence[str],
) -> DataFrame:
    """The delay x policy x fee grid of several selections, keyed by ``selector``.

    ``selected`` has each decision once, with the array of the selectors that chose it. Entries and exit marks are found
    once; only the marked rows are repeated for each selector.
    """
    marked = _replica_rows(
        selected, facts, hold_seconds=hold_seconds, outcome_cutoff=outcome_cutoff, order=order, payload=payload
    )
    rows = by_policy(marked.withColumn("selector", F.explode(selectors)))
    keys = ["selector", "requested_delay_slots", "execution_policy"]
    return portfolio_grid(rows, fees, notional=notional, keys=keys)


def position_backtest(
    selected: DataFrame, facts: DataFrame, fees: Mapping[str, float], *, position_lag: int, notional: float, hold_seconds: int,
    outcome_cutoff: int | Column, order: Sequence[str], payload: Sequence[str],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries with a position floor in the decision slot, marked rows and the fee grid."""
    entries, marked = _position_rows(
        selected, facts, position_lag=position_lag, hold_seconds=hold_seconds, outcome_cutoff=outcome_cutoff, order=order,
        payload=payload,
    )
    return entries, marked, portfolio_grid(marked, fees, notional=notional)


def _position_rows(
    selected: DataFrame, facts: DataFrame, *, position_lag: int, hold_seconds: int, outcome_cutoff: int | Column,
    order: Sequence[str], payload: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """All entries and the checked marked rows among them, found in one plan and written once."""
    found = first_in_slot_from(
        selected, facts, position_lag=position_lag, order=order, payload=payload, outcome_cutoff=outcome_cutoff
    )
    stored = materialise(
        mark_returns(
            found, facts, hold_seconds=hold_seconds, outcome_cutoff=outcome_cutoff, order=order, payload=payload,
            every=True,
        )
    )
    entries = stored.select(*found.columns)
    marked = stored.where(_eligible(hold_seconds, outcome_cutoff))
    marked = guarded(
        guarded(marked, position_entry_integrity(entries, position_lag), "position entries"),
        backtest_row_integrity(
            marked.withColumn("requested_delay_slots", F.lit(0)), hold_seconds=hold_seconds,
            outcome_cutoff=outcome_cutoff, position=order,
        ),
        "backtest rows",
    )
    return entries, marked


def fee_scenarios(behavior: DataFrame) -> dict[str, float]:
    """The three fee scenarios of one row of behaviour parameters."""
    row = behavior.select("roundtrip_median_bps", "roundtrip_p90_bps").first()
    return {
        "gross": 0.0,
        "training_median_fee": row["roundtrip_median_bps"],
        "training_p90_fee": row["roundtrip_p90_bps"],
    }


@dataclass(frozen=True)
class LearnedSetting:
    """What a backtest takes from the wallet's training events: fees, holding time, amount and position lag."""

    fees: dict[str, float]
    hold_seconds: int
    notional: float
    position_lag: int


def learned_setting(behavior: DataFrame, position: DataFrame) -> LearnedSetting:
    """Whole seconds and positions of the training medians; both tables have one row."""
    row, lag = behavior.first(), position.first()["median"]
    if row["hold_median"] is None or row["first_buy_notional_median"] is None or lag is None:
        raise ValueError("training events hold no closed position or no gap to learn from")
    return LearnedSetting(
        fee_scenarios(behavior), int(row["hold_median"]), float(row["first_buy_notional_median"]), int(lag)
    )


def paired_position_backtest(
    selected: DataFrame, facts: DataFrame, fees: Mapping[str, float], *, selectors: str = "selectors", position_lag: int,
    notional: float, hold_seconds: int, outcome_cutoff: int | Column, order: Sequence[str], payload: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """Marked rows and the fee grid of several selections, keyed by ``selector``.

    ``selected`` has each decision once, with the array of the selectors that chose it. Entries and exit marks are found
    once; only the marked rows are repeated for each selector.
    """
    _, marked = _position_rows(
        selected, facts, position_lag=position_lag, hold_seconds=hold_seconds, outcome_cutoff=outcome_cutoff, order=order,
        payload=payload,
    )
    rows = marked.withColumn("selector", F.explode(selectors)).drop(selectors)
    return rows, portfolio_grid(rows, fees, notional=notional, keys=["selector"])


def compare_positions(grid: DataFrame, *, names: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """The fee grids of two selectors side by side, and the decision of the six checks on them."""
    measures = ["net_mean_return", "net_median_return_unweighted", "net_hit_rate", "max_drawdown_fraction"]
    flag = "insolvent_under_capital_model"
    grid = materialise(grid.select("selector", "fee_scenario", *measures, flag))  # three rows for each selector
    left, right = (grid.where(F.col("selector") == n) for n in names)
    both = side_by_side(left, right, ["fee_scenario"], measures, names=names)
    for side, name in ((left, names[0]), (right, names[1])):
        both = both.join(side.select("fee_scenario", F.col(flag).alias(f"{name}_{flag}")), "fee_scenario")
    return both, fee_robust_gate(both, names=names)


def first_trade_gap(entries: DataFrame, position_lag: int) -> DataFrame:
    """Position gap between decision and first trade for entries in the decision slot, and the share beyond the lag."""
    gaps = entries.where(
        (F.col("requested_delay_slots") == 0) & (F.col("actual_delay_slots") == 0)
    ).select((F.col("entry_tx_index") - F.col("deploy_tx_index")).alias("gap"))
    basic = gaps.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("gap").alias("minimum"),
        F.max("gap").alias("maximum"),
        F.avg((F.col("gap") >= position_lag).cast("double")).alias("share_at_or_after_lag"),
    )
    return basic.crossJoin(
        exact_quantiles(gaps, value="gap", probs={"p10": 0.1, "median": 0.5, "p90": 0.9}).drop("value_rows")
    )


def position_coverage(entries: DataFrame) -> DataFrame:
    """Attempted and covered rows and weights of position entries, and the position gaps of the covered ones."""
    covered, weight = F.col("covered"), F.col("population_weight")
    basic = entries.agg(
        F.count(F.lit(1)).alias("attempted_sample_rows"),
        F.sum(weight).alias("attempted_population_weight"),
        F.count_if(covered).alias("covered_sample_rows"),
        F.coalesce(F.sum(F.when(covered, weight)), F.lit(0.0)).alias("covered_population_weight"),
        F.min("actual_position_delta").alias("minimum_delta"),
        F.max("actual_position_delta").alias("maximum_delta"),
    ).withColumns(
        {
            "coverage_rate_sampled": F.col("covered_sample_rows") / F.col("attempted_sample_rows"),
            "coverage_rate_population_weighted": F.col("covered_population_weight")
            / F.col("attempted_population_weight"),
        }
    )
    gaps = exact_quantiles(
        entries, value="actual_position_delta", probs={"median_delta": 0.5, "p90_delta": 0.9}
    ).drop("value_rows")
    return basic.crossJoin(gaps)


def validation_backtest(
    dataset: DataFrame, features: Sequence[str], spec: ModelSpec, facts: DataFrame, fees: Mapping[str, float], *,
    notional: float, hold_seconds: int, order: Sequence[str], payload: Sequence[str], start: object = None,
    time: str = "decision_time", incomplete: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit on the training part, select on validation at its best F1, trade the selection, and decide.

    ``dataset`` carries the decision position (``deploy_*``) next to features, label and ``decision_time`` in epoch
    seconds. The test part is never scored; its first time is the outcome cutoff. Returns the selection, the
    scenario grid and the decision; a grid without all delays stops the decision, or gives the text ``incomplete``.
    """
    split = materialise(three_way_split(in_window(dataset, time, F.col("label") == 1), time))
    require_both_classes(split, "split")
    cutoff = split.where(F.col("split") == "test").agg(F.min(time)).first()[0]
    model = fit(split.where(F.col("split") == "train"), features, spec)
    scored = materialise(
        model.score(split.where(F.col("split") == "validation")).withColumn("population_weight", population_weight())
    )
    threshold = best_f1(pr_curve(scored)).first()["threshold"]
    columns = ["token_address", time, "label", "deploy_block_time", "deploy_block_slot", "deploy_tx_index",
               "probability", "population_weight"]
    selected = materialise(
        select_above(scored, threshold, time=time, start=start, holdout_start=cutoff).select(*columns)
    )
    require_sealed(selected, time, cutoff)
    _, grid = replica_backtest(
        selected, facts, fees, notional=notional, hold_seconds=hold_seconds, outcome_cutoff=cutoff, order=order,
        payload=payload,
    )
    grid = materialise(grid)
    return selected, grid, delay_gate(grid, incomplete=incomplete)


def compare_selectors(
    raw: tuple[DataFrame, DataFrame], proxy: tuple[DataFrame, DataFrame], *, names: tuple[str, str] = ("raw", "proxy"),
    incomplete: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overlap of two selections, their median-fee results side by side, and the comparison decision."""
    keys = ["requested_delay_slots", "execution_policy", "fee_scenario"]
    measures = ["net_mean_return", "net_median_return_unweighted", "net_hit_rate", "max_drawdown_fraction"]
    flag = "insolvent_under_capital_model"
    both = side_by_side(raw[1], proxy[1], keys, measures, names=names, same_keys=incomplete is None)
    for side, name in ((raw[1], names[0]), (proxy[1], names[1])):
        both = both.join(side.select(*keys, F.col(flag).alias(f"{name}_{flag}")), keys, "left")
    primary = both.where(
        (F.col("execution_policy") == "all_observed_proxy") & (F.col("fee_scenario") == "training_median_fee")
    )
    return selection_overlap(raw[0], proxy[0]), both, replica_comparison_gate(
        primary, names=names, incomplete=incomplete
    )


def staleness(marked: DataFrame) -> DataFrame:
    """How old exit marks are relative to the fixed exit time."""
    quantiles = exact_quantiles(marked, value="mark_staleness_seconds", probs={"median": 0.5, "p90": 0.9})
    return quantiles.crossJoin(marked.agg(F.max("mark_staleness_seconds").alias("maximum"))).drop("value_rows")
