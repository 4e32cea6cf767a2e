from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.asof_queries import SLOT_ENTRIES_SQL, first_entries, marked_rows, slot_entries
from catalog.feature_queries import FEATURES, HISTORY, training_table
from catalog.registry import query
from catalog.wallet_queries import (
    CASHFLOW_SQL,
    LATENCY_SQL,
    PORTFOLIO_SQL,
    W,
    _PORTFOLIO_SELECT,
    rounded,
    rounded_portfolio,
    wallet_decisions,
)
from tidemark.operators import compare, portfolio
from tidemark.plans import backtest
from tidemark.plans.models import ModelSpec
from tidemark.sources.scratch import materialise
from tidemark.plans.wallet_report import head_to_head, wallet_portfolio

MARKED_SQL = f"{b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {b.first_entries_sql()}, {b.marks_sql()}"
KEYS = ["requested_delay_slots", "execution_policy"]
POLICY_SQL = """policy_rows AS (
    SELECT *, 'all_observed_proxy' AS execution_policy FROM marked
    UNION ALL SELECT *, 'exact_target_slot_only' FROM marked WHERE wait_slots_beyond_target = 0)"""
FEES_SQL = "fees(fee_scenario, fee_bps) AS (VALUES " + ", ".join(
    f"('{n}', {v}::DOUBLE)" for n, v in b.FEE_GRID.items()
) + ")"


def peaks_sql(rows: str, keys: str) -> str:
    return f"""changes AS (
    SELECT {keys}, entry_block_time AS t, 1 AS kind, population_weight AS c FROM {rows}
    UNION ALL SELECT {keys}, exit_target_time, 0, -population_weight FROM {rows}),
steps AS (SELECT {keys}, t, kind, sum(c) AS c FROM changes GROUP BY {keys}, t, kind),
levels AS (SELECT {keys}, sum(c) OVER (PARTITION BY {keys} ORDER BY t, kind ROWS UNBOUNDED PRECEDING) AS level FROM steps),
peaks AS (SELECT {keys}, greatest(max(level), 0) AS max_concurrent_weighted_positions FROM levels GROUP BY {keys})"""


def grid_sql(rows: str, keys: str) -> str:
    """Scenario grid computed scenario by scenario from the individual rows."""
    grid = f"{keys}, fee_scenario"
    return f"""{peaks_sql(rows, keys)},
net AS (SELECT r.*, f.*, gross_return - fee_bps / 10000.0::DOUBLE AS net_return FROM {rows} r CROSS JOIN fees f),
basic AS (
    SELECT {grid}, max(fee_bps) AS fee_bps, count(*) AS executed_sample_rows, sum(population_weight) AS executed_population_weight,
           sum(population_weight * gross_return) / sum(population_weight) AS gross_mean_return,
           quantile_cont(gross_return, 0.5) AS gross_median_return_unweighted,
           quantile_cont(gross_return, 0.9) AS gross_p90_return_unweighted,
           quantile_cont(gross_return, 0.99) AS gross_p99_return_unweighted,
           sum(population_weight * net_return) / sum(population_weight) AS net_mean_return,
           quantile_cont(net_return, 0.5) AS net_median_return_unweighted,
           sum(CASE WHEN net_return > 0 THEN population_weight ELSE 0 END) / sum(population_weight) AS net_hit_rate,
           sum(population_weight) * {b.NOTIONAL} AS total_weighted_notional_usd,
           sum(population_weight * net_return) * {b.NOTIONAL} AS total_weighted_pnl_usd
    FROM net GROUP BY {grid}),
per_time AS (SELECT {grid}, exit_target_time AS t, sum(population_weight * {b.NOTIONAL} * net_return) AS p
    FROM net GROUP BY {grid}, exit_target_time),
curve1 AS (SELECT p.*, {b.NOTIONAL} * k.max_concurrent_weighted_positions AS capital,
    {b.NOTIONAL} * k.max_concurrent_weighted_positions
        + sum(p) OVER (PARTITION BY {grid} ORDER BY t ROWS UNBOUNDED PRECEDING) AS equity
    FROM per_time p JOIN peaks k USING ({keys})),
curve AS (SELECT *, greatest(capital, max(equity) OVER (PARTITION BY {grid} ORDER BY t ROWS UNBOUNDED PRECEDING)) AS top
    FROM curve1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {grid} ORDER BY round(top - equity, 6) DESC, t) AS rn,
    row_number() OVER (PARTITION BY {grid} ORDER BY t DESC) AS last_rn, min(equity) OVER (PARTITION BY {grid}) AS low
    FROM curve),
ends AS (SELECT {grid}, equity AS ending_equity_usd, low AS minimum_equity_usd, low < 0 AS insolvent_under_capital_model
    FROM ranked WHERE last_rn = 1),
worsts AS (SELECT {grid}, top - equity AS max_drawdown_usd, (top - equity) / top AS max_drawdown_fraction FROM ranked WHERE rn = 1),
grid AS (SELECT *, {b.NOTIONAL} * max_concurrent_weighted_positions AS initial_capital_usd
    FROM basic JOIN peaks USING ({keys}) JOIN ends USING ({grid}) JOIN worsts USING ({grid}))"""


_G6 = ["gross_mean_return", "gross_median_return_unweighted", "gross_p90_return_unweighted", "gross_p99_return_unweighted",
       "net_mean_return", "net_median_return_unweighted", "net_hit_rate", "max_drawdown_fraction"]
_G3 = ["total_weighted_pnl_usd", "ending_equity_usd", "minimum_equity_usd", "max_drawdown_usd"]
_GRID_SELECT = ", ".join(
    ["fee_scenario", "fee_bps", "executed_sample_rows", "executed_population_weight", "total_weighted_notional_usd",
     "max_concurrent_weighted_positions", "initial_capital_usd", "insolvent_under_capital_model"]
    + [f"round({c}, 6) AS {c}" for c in _G6] + [f"round({c}, 3) AS {c}" for c in _G3]
)


def rounded_grid(df):
    return rounded(rounded(df, _G6), _G3, 3)


@query(
    "peak_concurrency",
    f"WITH {MARKED_SQL}, {POLICY_SQL}, {peaks_sql('policy_rows', ', '.join(KEYS))} SELECT * FROM peaks",
)
def peak_concurrency(spark, sf_dir):
    rows = portfolio.by_policy(materialise(marked_rows(spark, sf_dir)))
    return portfolio.peak_level(
        rows, start="entry_block_time", end="exit_target_time", level="population_weight",
        name="max_concurrent_weighted_positions", keys=KEYS,
    )


_CURVE_SQL = f"""{MARKED_SQL}, changes AS (
    SELECT requested_delay_slots, entry_block_time AS t, 1 AS kind, population_weight AS c FROM marked
    UNION ALL SELECT requested_delay_slots, exit_target_time, 0, -population_weight FROM marked),
steps AS (SELECT requested_delay_slots, t, kind, sum(c) AS c FROM changes GROUP BY ALL),
levels AS (SELECT requested_delay_slots, sum(c) OVER (PARTITION BY requested_delay_slots ORDER BY t, kind
    ROWS UNBOUNDED PRECEDING) AS level FROM steps),
capital AS (SELECT requested_delay_slots, greatest(max(level), 0) * {b.NOTIONAL} AS capital FROM levels GROUP BY ALL),
per_time AS (SELECT requested_delay_slots, exit_target_time AS "time", sum(population_weight * gross_return * {b.NOTIONAL}) AS p
    FROM marked GROUP BY ALL),
curve1 AS (SELECT p.requested_delay_slots, p."time", capital, capital + sum(p) OVER (PARTITION BY requested_delay_slots
    ORDER BY "time" ROWS UNBOUNDED PRECEDING) AS equity FROM per_time p JOIN capital USING (requested_delay_slots)),
curve AS (SELECT *, greatest(capital, max(equity) OVER (PARTITION BY requested_delay_slots ORDER BY "time"
    ROWS UNBOUNDED PRECEDING)) AS peak FROM curve1)"""


def _equity(spark, sf_dir):
    rows = materialise(marked_rows(spark, sf_dir)).withColumn(
        "pnl", F.col("population_weight") * F.col("gross_return") * F.lit(b.NOTIONAL)
    )
    peak = portfolio.peak_level(
        rows, start="entry_block_time", end="exit_target_time", level="population_weight", name="level",
        keys=["requested_delay_slots"],
    )
    initial = peak.select("requested_delay_slots", (F.col("level") * b.NOTIONAL).alias("capital"))
    return portfolio.equity_curve(
        rows, time="exit_target_time", pnl="pnl", initial=initial, initial_column="capital",
        keys=["requested_delay_slots"],
    )


@query(
    "equity_curve",
    f"""WITH {_CURVE_SQL} SELECT requested_delay_slots, "time", round(equity, 3) AS equity, round(peak, 3) AS peak,
    round(peak - equity, 3) AS drawdown FROM curve""",
)
def equity_curve(spark, sf_dir):
    return rounded(_equity(spark, sf_dir).drop("_initial"), ["equity", "peak", "drawdown"], 3)


@query(
    "equity_drawdown",
    f"""WITH {_CURVE_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY requested_delay_slots
        ORDER BY round(peak - equity, 6) DESC, "time") AS rn, row_number() OVER (PARTITION BY requested_delay_slots
        ORDER BY "time" DESC) AS last_rn, min(equity) OVER (PARTITION BY requested_delay_slots) AS low FROM curve)
    SELECT a.requested_delay_slots, round(z.equity, 3) AS ending_equity_usd, round(a.low, 3) AS minimum_equity_usd,
           a.low < 0 AS insolvent_under_capital_model, round(a.peak - a.equity, 3) AS max_drawdown_usd,
           round((a.peak - a.equity) / a.peak, 6) AS max_drawdown_fraction
    FROM ranked a JOIN ranked z USING (requested_delay_slots) WHERE a.rn = 1 AND z.last_rn = 1""",
)
def equity_drawdown(spark, sf_dir):
    worst = portfolio.worst_drawdown(_equity(spark, sf_dir), ["requested_delay_slots"])
    return rounded(
        rounded(worst, ["ending_equity_usd", "minimum_equity_usd", "max_drawdown_usd"], 3), ["max_drawdown_fraction"]
    )


_GRID_WITH = f"{MARKED_SQL}, {POLICY_SQL}, {FEES_SQL}, {grid_sql('policy_rows', ', '.join(KEYS))}"


@query("portfolio_grid", f"WITH {_GRID_WITH} SELECT {', '.join(KEYS)}, {_GRID_SELECT} FROM grid")
def portfolio_grid(spark, sf_dir):
    rows = portfolio.by_policy(materialise(marked_rows(spark, sf_dir)))
    return rounded_grid(portfolio.portfolio_grid(rows, b.FEE_GRID, notional=b.NOTIONAL, keys=KEYS))


# Backtest of decisions whose score (order value relative to 300000) reaches a threshold.
def _selected(spark, sf_dir, threshold=0.5):
    scored = b.deployments(spark, sf_dir).select(
        "token_address", "decision_time", "label",
        F.col("block_time").alias("deploy_block_time"), F.col("block_slot").alias("deploy_block_slot"),
        F.col("tx_index").alias("deploy_tx_index"),
        (F.col("o_totalprice") / (F.col("o_totalprice") + 300000.0)).alias("probability"),
        F.when(F.col("label") == 0, F.lit(25.0)).otherwise(F.lit(1.0)).alias("population_weight"),
    )
    return backtest.select_above(scored, threshold, start=820_454_400, holdout_start=b.CUTOFF)


def selected_sql(name: str, threshold: float) -> str:
    return f"""{name} AS (SELECT * FROM deployments WHERE o_totalprice / (o_totalprice + 300000.0::DOUBLE) >= {threshold}
    AND decision_time >= 820454400 AND decision_time < {b.CUTOFF})"""


_ATTEMPT_SQL = """attempts AS (SELECT requested_delay_slots, count(*) AS attempted_sample_rows,
    sum(population_weight) AS attempted_population_weight FROM entries GROUP BY requested_delay_slots),
waits AS (SELECT requested_delay_slots, execution_policy,
    quantile_cont(CAST(actual_delay_slots AS DOUBLE), 0.5) AS actual_delay_slots_median,
    quantile_cont(CAST(actual_delay_slots AS DOUBLE), 0.9) AS actual_delay_slots_p90,
    max(actual_delay_slots) AS actual_delay_slots_max,
    quantile_cont(CAST(wait_slots_beyond_target AS DOUBLE), 0.5) AS wait_slots_beyond_target_median,
    quantile_cont(CAST(wait_slots_beyond_target AS DOUBLE), 0.9) AS wait_slots_beyond_target_p90,
    max(wait_slots_beyond_target) AS wait_slots_beyond_target_max FROM policy_rows GROUP BY ALL)"""
_WAITS = [f"{m}_{s}" for m in ("actual_delay_slots", "wait_slots_beyond_target") for s in ("median", "p90")]


def _replica(spark, sf_dir):
    return backtest.replica_backtest(
        _selected(spark, sf_dir), b.trades(spark, sf_dir), b.FEE_GRID, notional=b.NOTIONAL,
        hold_seconds=b.HOLD_SECONDS, outcome_cutoff=b.CUTOFF, order=b.ORDER, payload=("price_usd", "price_sol"),
    )


def _replica_sql(threshold):
    return (
        f"{b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {selected_sql('chosen', threshold)}, {b.first_entries_sql('chosen')}, "
        f"{b.marks_sql()}, {POLICY_SQL}, {FEES_SQL}, {grid_sql('policy_rows', ', '.join(KEYS))}"
    )


@query(
    "replica_backtest",
    f"""WITH {_replica_sql(0.5)}, {_ATTEMPT_SQL}
    SELECT {', '.join(KEYS)}, {_GRID_SELECT}, attempted_sample_rows, attempted_population_weight,
           round(executed_sample_rows / attempted_sample_rows, 6) AS coverage_rate_sampled,
           round(executed_population_weight / attempted_population_weight, 6) AS coverage_rate_population_weighted,
           {', '.join(f'round({c}, 6) AS {c}' for c in _WAITS)}, actual_delay_slots_max, wait_slots_beyond_target_max
    FROM grid JOIN attempts USING (requested_delay_slots) JOIN waits USING ({', '.join(KEYS)})""",
)
def replica_backtest(spark, sf_dir):
    _, grid = _replica(spark, sf_dir)
    return rounded(rounded_grid(grid), [*_WAITS, "coverage_rate_sampled", "coverage_rate_population_weighted"])


_VIABLE = "net_mean_return > 0 AND net_median_return_unweighted > 0 AND NOT insolvent_under_capital_model"


@query(
    "replica_decision",
    f"""WITH {_replica_sql(0.5)}, viable AS (
    SELECT coalesce(string_agg(CAST(requested_delay_slots AS VARCHAR), ',' ORDER BY requested_delay_slots)
        FILTER (WHERE {_VIABLE}), '') AS viable_delays FROM grid
    WHERE execution_policy = 'all_observed_proxy' AND fee_scenario = 'training_median_fee')
    SELECT viable_delays, CASE WHEN viable_delays = '0' THEN 'supported_only_requested_delay_zero_is_viable'
        ELSE 'rejected_viable_delay_set_differs_from_zero_only' END AS decision FROM viable""",
)
def replica_decision(spark, sf_dir):
    return compare.delay_gate(_replica(spark, sf_dir)[1])


@query(
    "mark_staleness",
    f"""WITH {MARKED_SQL} SELECT round(quantile_cont(CAST(mark_staleness_seconds AS DOUBLE), 0.5), 3) AS median,
    round(quantile_cont(CAST(mark_staleness_seconds AS DOUBLE), 0.9), 3) AS p90, max(mark_staleness_seconds) AS maximum
    FROM marked""",
)
def mark_staleness(spark, sf_dir):
    return rounded(backtest.staleness(materialise(marked_rows(spark, sf_dir))), ["median", "p90"], 3)


_POSITION_SQL = f"""{b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {SLOT_ENTRIES_SQL}, {b.marks_sql('slot_entries')},
    one AS (SELECT *, 0 AS g FROM marked), {FEES_SQL}, {grid_sql('one', 'g')}"""


def _position(spark, sf_dir):
    return backtest.position_backtest(
        b.weighted_decisions(spark, sf_dir), b.trades(spark, sf_dir), b.FEE_GRID, position_lag=2,
        notional=b.NOTIONAL, hold_seconds=b.HOLD_SECONDS, outcome_cutoff=b.CUTOFF, order=b.ORDER,
        payload=("price_usd", "price_sol"),
    )


@query("position_backtest", f"WITH {_POSITION_SQL} SELECT {_GRID_SELECT} FROM grid")
def position_backtest(spark, sf_dir):
    return rounded_grid(_position(spark, sf_dir)[2])


@query(
    "position_decision",
    f"""WITH {_POSITION_SQL} SELECT {_VIABLE} AS all_checks_passed,
    CASE WHEN {_VIABLE} THEN 'supported_position_lag_remains_fee_robust_and_solvent'
        ELSE 'rejected_position_lag_fails_fee_robust_capital_criterion' END AS decision
    FROM grid WHERE fee_scenario = 'training_median_fee'""",
)
def position_decision(spark, sf_dir):
    return compare.position_gate(_position(spark, sf_dir)[2])


_COMPARED = ["net_mean_return", "net_median_return_unweighted", "net_hit_rate", "max_drawdown_fraction",
             "total_weighted_pnl_usd"]


_SELECTORS = (("raw", 0.4), ("proxy", 0.5))


def _two_grids(spark, sf_dir):
    narrow = [*KEYS, "fee_scenario", *_COMPARED, "insolvent_under_capital_model"]
    chosen = [F.when(F.col("probability") >= t, F.lit(n)) for n, t in _SELECTORS]
    selected = _selected(spark, sf_dir, min(t for _, t in _SELECTORS)).withColumn(
        "selectors", F.array_compact(F.array(*chosen))
    )
    grid = backtest.paired_replica_grid(
        selected, b.trades(spark, sf_dir), b.FEE_GRID, notional=b.NOTIONAL, hold_seconds=b.HOLD_SECONDS,
        outcome_cutoff=b.CUTOFF, order=b.ORDER, payload=("price_usd", "price_sol"),
    )
    # A result grid has 18 rows; materialising it keeps the backtest from running once per use.
    both = materialise(grid.select("selector", *narrow))
    raw, proxy = (both.where(F.col("selector") == n).select(*narrow) for n, _ in _SELECTORS)
    return raw, proxy


def _two_grids_sql():
    def renamed(text, suffix):
        names = ["chosen", "candidates", "entries", "eligible", "exits", "marked", "policy_rows", "changes", "steps",
                 "levels", "peaks", "net", "basic", "per_time", "curve1", "curve", "ranked", "ends", "worsts", "grid"]
        for n in names:
            text = re.sub(rf"(?<![\w.']){n}(?![\w'(])(?! =)", f"{n}_{suffix}", text)
        return text

    head = f"{b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {FEES_SQL}"
    parts = []
    for suffix, threshold in (("raw", 0.4), ("proxy", 0.5)):
        body = (
            f"{selected_sql('chosen', threshold)}, {b.first_entries_sql('chosen')}, {b.marks_sql()}, {POLICY_SQL}, "
            f"{grid_sql('policy_rows', ', '.join(KEYS))}"
        )
        parts.append(renamed(body, suffix))
    return ", ".join([head, *parts])


_BOTH = ", ".join(
    [f"round(r.{m}, 4) AS raw_{m}" for m in _COMPARED] + [f"round(p.{m}, 4) AS proxy_{m}" for m in _COMPARED]
    + [f"round(p.{m} - r.{m}, 4) AS proxy_minus_raw_{m}" for m in _COMPARED]
)


@query(
    "result_comparison",
    f"""WITH {_two_grids_sql()} SELECT requested_delay_slots, execution_policy, fee_scenario, {_BOTH}
    FROM grid_raw r JOIN grid_proxy p USING (requested_delay_slots, execution_policy, fee_scenario)""",
)
def result_comparison(spark, sf_dir):
    raw, proxy = _two_grids(spark, sf_dir)
    out = compare.side_by_side(raw, proxy, [*KEYS, "fee_scenario"], _COMPARED, names=("raw", "proxy"))
    return rounded(out, [c for c in out.columns if c not in (*KEYS, "fee_scenario")], 4)


@query(
    "comparison_decision",
    f"""WITH {_two_grids_sql()}, c AS (SELECT r.requested_delay_slots, p.net_mean_return > r.net_mean_return AS better,
        r.insolvent_under_capital_model AS ri, p.insolvent_under_capital_model AS pi
    FROM grid_raw r JOIN grid_proxy p USING (requested_delay_slots, execution_policy, fee_scenario)
    WHERE execution_policy = 'all_observed_proxy' AND fee_scenario = 'training_median_fee'),
    s AS (SELECT count(*) FILTER (WHERE better) AS improved_delay_count,
        bool_and(NOT pi) FILTER (WHERE requested_delay_slots = 0) AS zero_slot_solvent,
        count(*) FILTER (WHERE ri) AS left_insolvent_delay_count, count(*) FILTER (WHERE pi) AS right_insolvent_delay_count
    FROM c)
    SELECT *, CASE WHEN improved_delay_count >= 2 AND zero_slot_solvent
        AND right_insolvent_delay_count <= left_insolvent_delay_count
        THEN 'supported_on_predeclared_development_backtest_criterion'
        ELSE 'rejected_on_predeclared_development_backtest_criterion' END AS decision FROM s""",
)
def comparison_decision(spark, sf_dir):
    raw, proxy = _two_grids(spark, sf_dir)
    both = compare.side_by_side(raw, proxy, [*KEYS, "fee_scenario"], ["net_mean_return"], names=("raw", "proxy"))
    flags = raw.select(*KEYS, "fee_scenario", F.col("insolvent_under_capital_model").alias("raw_insolvent_under_capital_model"))
    flags = flags.join(
        proxy.select(*KEYS, "fee_scenario", F.col("insolvent_under_capital_model").alias("proxy_insolvent_under_capital_model")),
        [*KEYS, "fee_scenario"],
    )
    primary = both.join(flags, [*KEYS, "fee_scenario"]).where(
        (F.col("execution_policy") == "all_observed_proxy") & (F.col("fee_scenario") == "training_median_fee")
    )
    return compare.replica_comparison_gate(primary, names=("raw", "proxy"))


# Wallet tokens decided (first signup) in the first eight days, with outcomes before the boundary.
_WALLET_START, _WALLET_BOUNDARY = 1_704_067_200, 1_706_572_800


def _wallet_sql():
    flows, closed = CASHFLOW_SQL.split("closed AS (SELECT * FROM flows WHERE")
    dated = f"""joined AS (SELECT f.*, l.decision_time FROM flows f LEFT JOIN latency l USING (token_address)),
dated AS (SELECT *, last_event_time >= {_WALLET_BOUNDARY} AS crosses FROM joined
    WHERE decision_time >= {_WALLET_START} AND decision_time < {_WALLET_BOUNDARY}),
closed AS (SELECT * FROM dated WHERE NOT crosses AND"""
    return f"{W}, {LATENCY_SQL}, {flows}{dated}{closed}, {PORTFOLIO_SQL}"


@query(
    "wallet_portfolio",
    f"""WITH {_wallet_sql()}, summary AS (SELECT {_PORTFOLIO_SELECT}, min(decision_time) AS decision_time_start,
        max(decision_time) AS decision_time_end FROM closed)
    SELECT *, CASE WHEN net_pnl_usd > 0 AND net_mean_roi > 0 AND net_median_roi > 0
        THEN 'supported_on_development_and_full_descriptive'
        ELSE 'rejected_recorded_fees_remove_development_profitability' END AS decision,
        (SELECT count(*) FROM dated) AS development_candidate_tokens,
        (SELECT count(*) FROM dated WHERE crosses) AS development_censored_tokens,
        (SELECT count(*) FROM joined WHERE decision_time IS NULL) AS unmatched_wallet_tokens
    FROM summary""",
)
def wallet_portfolio_query(spark, sf_dir):
    counts, summary = wallet_portfolio(
        b.wallet(spark, sf_dir), wallet_decisions(spark, sf_dir), start=_WALLET_START, holdout_start=_WALLET_BOUNDARY
    )
    return rounded_portfolio(summary).crossJoin(counts)


@query(
    "wallet_vs_replica",
    f"""SELECT 'wallet' AS entry_set, token_rows AS rows, round(net_mean_roi, 4) AS net_mean_return,
        round(net_median_roi, 4) AS net_median_return, round(net_hit_rate, 4) AS hit_rate,
        round(max_drawdown_fraction, 4) AS max_drawdown_fraction, round(net_pnl_usd, 2) AS net_pnl_usd
    FROM (WITH {_wallet_sql()} SELECT {_PORTFOLIO_SELECT} FROM closed)
    UNION ALL SELECT 'replica', executed_sample_rows, round(net_mean_return, 4), round(net_median_return_unweighted, 4),
        round(net_hit_rate, 4), round(max_drawdown_fraction, 4), round(total_weighted_pnl_usd, 2)
    FROM (WITH {_POSITION_SQL} SELECT {_GRID_SELECT} FROM grid) WHERE fee_scenario = 'training_median_fee'""",
)
def wallet_vs_replica(spark, sf_dir):
    _, summary = wallet_portfolio(
        b.wallet(spark, sf_dir), wallet_decisions(spark, sf_dir), start=_WALLET_START, holdout_start=_WALLET_BOUNDARY
    )
    both = head_to_head(summary, _position(spark, sf_dir)[2])
    ratios = ["net_mean_return", "net_median_return", "hit_rate", "max_drawdown_fraction"]
    return rounded(rounded(both, ratios, 4), ["net_pnl_usd"], 2)


@query(
    "first_trade_gap",
    f"""WITH {b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {b.first_entries_sql()}, g AS (
        SELECT entry_tx_index - deploy_tx_index AS gap FROM entries
        WHERE requested_delay_slots = 0 AND actual_delay_slots = 0)
    SELECT count(*) AS rows, min(gap) AS minimum, max(gap) AS maximum,
           round(avg(CASE WHEN gap >= 2 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS share_at_or_after_lag,
           round(quantile_cont(CAST(gap AS DOUBLE), 0.1), 6) AS p10,
           round(quantile_cont(CAST(gap AS DOUBLE), 0.5), 6) AS median,
           round(quantile_cont(CAST(gap AS DOUBLE), 0.9), 6) AS p90 FROM g""",
)
def first_trade_gap(spark, sf_dir):
    gap = backtest.first_trade_gap(materialise(first_entries(spark, sf_dir)), 2)
    return rounded(rounded(gap, ["share_at_or_after_lag"], 9), ["p10", "median", "p90"])


@query(
    "position_coverage",
    f"""WITH {b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {SLOT_ENTRIES_SQL}, c AS (
    SELECT count(*) AS attempted_sample_rows, sum(population_weight) AS attempted_population_weight,
           count(*) FILTER (WHERE covered) AS covered_sample_rows,
           coalesce(sum(population_weight) FILTER (WHERE covered), 0) AS covered_population_weight,
           min(actual_position_delta) AS minimum_delta, max(actual_position_delta) AS maximum_delta,
           round(quantile_cont(CAST(actual_position_delta AS DOUBLE), 0.5), 6) AS median_delta,
           round(quantile_cont(CAST(actual_position_delta AS DOUBLE), 0.9), 6) AS p90_delta FROM slot_entries)
    SELECT *, round(covered_sample_rows / attempted_sample_rows, 9) AS coverage_rate_sampled,
           round(covered_population_weight / attempted_population_weight, 9) AS coverage_rate_population_weighted FROM c""",
)
def position_coverage(spark, sf_dir):
    out = backtest.position_coverage(materialise(slot_entries(spark, sf_dir)))
    rates = ["coverage_rate_sampled", "coverage_rate_population_weighted"]
    return rounded(rounded(out, rates, 9), ["median_delta", "p90_delta"])


def _model_table(spark, sf_dir):
    return b.decisions(spark, sf_dir).join(
        training_table(spark, sf_dir).drop("decision_time", "label"), "token_address"
    )


def _model_backtest(spark, sf_dir, table, features):
    return backtest.validation_backtest(
        table, features, ModelSpec("logistic"), b.trades(spark, sf_dir), b.FEE_GRID, notional=b.NOTIONAL,
        hold_seconds=b.HOLD_SECONDS, order=b.ORDER, payload=("price_usd", "price_sol"), incomplete=INCOMPLETE,
    )


# A small selection may leave delays without any row; the decision then says so.
INCOMPLETE = "undecided_incomplete_grid"


@query("validation_backtest")
def validation_backtest(spark, sf_dir):
    """The whole grid of the selection, with its size and the decision on every row."""
    selected, grid, decision = _model_backtest(spark, sf_dir, _model_table(spark, sf_dir), FEATURES)
    size = selected.agg(F.count(F.lit(1)).alias("selected_rows"), F.sum("population_weight").alias("selected_weight"))
    return grid.crossJoin(size).crossJoin(decision)


@query("selector_comparison")
def selector_comparison(spark, sf_dir):
    """Overlap of the two selections and the decision, with their results side by side."""
    table = materialise(_model_table(spark, sf_dir))  # both models read it
    raw = _model_backtest(spark, sf_dir, table, [f for f in FEATURES if f not in HISTORY])
    proxy = _model_backtest(spark, sf_dir, table, FEATURES)
    overlap, both, decision = backtest.compare_selectors(raw[:2], proxy[:2], incomplete=INCOMPLETE)
    return overlap.crossJoin(decision).join(both, F.lit(True), "left")
