import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cashflow, portfolio

ROWS = "population_weight double, gross_return double, entry_block_time long, exit_target_time long"


def fees(*pairs):
    return dict(pairs)


def test_weighted_portfolio_with_drawdown(spark):
    rows = spark.createDataFrame([(1.0, 0.1, 10, 16), (2.0, -0.2, 12, 18)], ROWS)
    r = portfolio.portfolio_grid(rows, fees(("one", 100.0)), notional=100.0).first()
    assert r.executed_population_weight == 3
    assert r.net_mean_return == pytest.approx(-0.11)
    assert r.net_hit_rate == pytest.approx(1 / 3)
    assert r.total_weighted_pnl_usd == pytest.approx(-33)
    assert r.max_concurrent_weighted_positions == 3
    assert r.initial_capital_usd == 300
    assert r.max_drawdown_usd == pytest.approx(42)
    assert r.max_drawdown_fraction == pytest.approx(42 / 309)
    assert not r.insolvent_under_capital_model


def test_exits_come_before_entries_at_one_instant(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0, 5), (1.0, 0.0, 5, 9)], ROWS)
    peak = portfolio.peak_level(rows, start="entry_block_time", end="exit_target_time", level="population_weight", name="p")
    assert peak.first().p == 1


def test_drawdown_may_exceed_the_peak(spark):
    rows = spark.createDataFrame([(1.0, -3.0, 0, 5), (1.0, 1.0, 6, 9)], ROWS)
    r = portfolio.portfolio_grid(rows, fees(("gross", 0.0)), notional=10.0).first()
    assert r.max_drawdown_fraction == pytest.approx(3.0)
    assert r.insolvent_under_capital_model and r.minimum_equity_usd == -20


def reference_metrics(rows, fee_bps, notional):
    """Plain single-pass recomputation of the portfolio measures."""
    changes = sorted([(e, 1, w) for w, _, e, _ in rows] + [(x, 0, -w) for w, _, _, x in rows])
    level = peak = 0.0
    for _, _, change in changes:
        level += change
        peak = max(peak, level)
    by_time = {}
    for w, g, _, x in rows:
        by_time[x] = by_time.get(x, 0.0) + w * notional * (g - fee_bps / 1e4)
    equity, top, worst, fraction, low = peak * notional, peak * notional, -1.0, None, float("inf")
    for t in sorted(by_time):
        equity += by_time[t]
        top = max(top, equity)
        low = min(low, equity)
        if top - equity > worst + 1e-9:
            worst, fraction = top - equity, (top - equity) / top
    return peak, equity, low, worst, fraction


@pytest.mark.parametrize("buckets", [None, 8])
def test_grid_equals_recomputation(spark, buckets):
    rng = random.Random(11)
    data = []
    for k in ("a", "b"):
        for _ in range(200):
            entry = rng.randint(0, 300)
            data.append((k, float(rng.choice([1, 25])), rng.uniform(-0.6, 0.7), entry, entry + rng.randint(1, 40)))
    rows = spark.createDataFrame(data, "k string, " + ROWS)
    grid = portfolio.portfolio_grid(
        rows, fees(("gross", 0.0), ("p90", 700.0)), notional=50.0, keys=["k"], buckets=buckets
    ).collect()
    assert len(grid) == 4
    for r in grid:
        mine = [d[1:] for d in data if d[0] == r.k]
        peak, ending, low, worst, fraction = reference_metrics(mine, r.fee_bps, 50.0)
        assert r.max_concurrent_weighted_positions == pytest.approx(peak)
        assert r.ending_equity_usd == pytest.approx(ending, abs=1e-5)
        assert r.minimum_equity_usd == pytest.approx(low, abs=1e-5)
        assert r.max_drawdown_usd == pytest.approx(worst, abs=1e-5)
        assert r.max_drawdown_fraction == pytest.approx(fraction, abs=1e-7)
        returns = np.array([g for _, g, _, _ in mine])
        assert r.gross_p90_return_unweighted == pytest.approx(np.quantile(returns, 0.9))
        assert r.net_median_return_unweighted == pytest.approx(np.median(returns - r.fee_bps / 1e4))


WALLET = (
    "token_address string, timestamp long, event_type string, tx_hash string, token_symbol string, cost_usd string, "
    "gas_usd double, dex_usd double, gas_native double, priority_fee double, tip_fee double, token_amount double, "
    "is_open_or_close int"
)


def wallet(spark):
    return spark.createDataFrame(
        [
            ("a", 100, "buy", "a1", None, "100", 2.0, 1.0, 0.03, 0.02, 0.0, 10.0, 1),
            ("a", 106, "sell", "a2", "SYM", "120", 1.0, 1.0, 0.01, 0.0, 0.0, 10.0, 1),
            ("b", 110, "buy", "b1", "B", "50", 1.0, 0.0, 0.01, 0.0, 0.0, 5.0, 1),
            ("c", 111, "transfer", "c1", "C", "bad", 1.0, 0.0, 0.01, 0.0, 0.0, 5.0, 1),
        ],
        WALLET,
    )


def test_cash_flow_counts_fees_once(spark):
    flows = cashflow.token_cashflow(wallet(spark))
    a = flows.where("token_address = 'a'").first()
    assert (a.gross_pnl_usd, a.network_fee_usd, a.dex_fee_usd, a.net_pnl_usd) == (20, 3, 2, 15)
    assert a.net_roi == pytest.approx(0.15) and a.hold_seconds == 6 and a.inventory_exit_ratio == 1
    closed = cashflow.closed_positions(flows)
    assert [r.token_address for r in closed.collect()] == ["a"]
    row = cashflow.closed_portfolio(closed).first()
    assert (row.capital_model_initial_usd, row.max_drawdown_usd, row.net_pnl_usd, row.net_hit_rate) == (103, 0, 15, 1)
    assert set(cashflow.cashflow_integrity(flows).first()) == {0}


def test_cash_flow_preconditions(spark):
    good = wallet(spark)
    assert set(cashflow.cashflow_violations(good).first()) == {0}
    bad = good.unionAll(good.where("tx_hash = 'a1'")).withColumn(
        "gas_usd", F.when(F.col("tx_hash") == "b1", -1.0).when(F.col("tx_hash") == "a2", None).otherwise(F.col("gas_usd"))
    )
    assert tuple(cashflow.cashflow_violations(bad).first()) == (1, 1, 1)


def test_wallet_summary_keeps_missing_sides_null(spark):
    rows = spark.createDataFrame(
        [
            ("a", 1, "buy", "x1", "S", "100", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0),
            ("a", 2, "sell", "x2", "S", "70", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0),
            ("a", 3, "sell", "x3", "S", "60", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0),
            ("b", 3, "buy", "x4", None, "5", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0),
        ],
        WALLET,
    )
    summary = cashflow.wallet_summary(rows)
    by = {r.token_address: r for r in summary.collect()}
    assert by["a"].gross_pnl_usd == 30 and by["a"].sell_transactions == 2
    assert by["b"].gross_sell_usd is None and by["b"].gross_pnl_usd is None and by["b"].token_symbol is None
    totals = cashflow.wallet_totals(rows, summary).first()
    assert (totals.tokens_with_multiple_sells, totals.tokens_without_observed_sell) == (1, 1)


def test_behaviour_uses_only_events_up_to_the_cutoff(spark):
    rows = spark.createDataFrame(
        [
            ("a", 100, "buy", "1", "100", 1.0, 1.0),
            ("a", 106, "sell", "2", "110", 1.0, 0.1),
            ("b", 200, "buy", "3", "10000", 0.0, 0.0),
        ],
        "token_address string, timestamp long, event_type string, tx_hash string, cost_usd string, gas_usd double, dex_usd double",
    )
    r = cashflow.behavior_parameters(rows, 150).first()
    assert (r.wallet_trade_rows, r.closed_token_rows, r.hold_median, r.first_buy_notional_median) == (2, 1, 6, 100)
    assert r.roundtrip_median_bps == pytest.approx(300)


def test_position_parameters_respect_cutoff_and_slot(spark):
    rows = spark.createDataFrame([(1, 0, 12), (2, 1, 999), (40, 0, 500), (3, 0, -4)], "decision_time long, latency_slots long, same_slot_position_delta long")
    r = cashflow.position_parameters(rows, 31).first()
    assert (r.rows, r.median, r.maximum, r.share_at_or_before_50) == (1, 12, 12, 1.0)
