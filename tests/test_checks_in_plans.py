"""Plans stop on input that would give wrong figures, and keep exact figures on unusual amounts."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators.asof import first_at_or_after, first_in_slot_from
from tidemark.operators.cashflow import cashflow_violations, strict_numbers, token_cashflow
from tidemark.operators.joins import compare_on_key, unmatched
from tidemark.operators.portfolio import portfolio_grid, worst_drawdown
from tidemark.operators.quality import expected_rows, guarded
from tidemark.operators.quantiles import finite_summary
from tidemark.plans import backtest
from tidemark.plans.wallet_report import wallet_portfolio

WALLET = (
    "token_address string, tx_hash string, timestamp long, event_type string, token_symbol string, cost_usd string, "
    "gas_usd string, dex_usd string, gas_native string, priority_fee string, tip_fee string, token_amount string, "
    "is_open_or_close int"
)


def event(tx, kind, cost, amount="1"):
    return ("a", tx, 1 if kind == "buy" else 2, kind, "s", cost, "0", "0", "0", "0", "0", amount, int(kind == "sell"))


def test_a_key_that_decides_twice_has_entries_after_each_decision(spark):
    decisions = spark.createDataFrame(
        [("a", 100, 1), ("a", 200, 1), ("a", 200, 1)], "token_address string, deploy_block_slot long, deploy_tx_index int"
    )
    facts = spark.createDataFrame(
        [("a", s, t, 0) for s, t in ((100, 1), (101, 0), (200, 0), (201, 3), (200, 9))],
        "token_address string, block_slot long, tx_index int, event_index int",
    )
    order = ("block_slot", "tx_index", "event_index")
    found = first_at_or_after(decisions, facts, order=order, payload=(), delays=(0, 1)).collect()
    wanted = {(100, 0): 101, (100, 1): 101, (200, 0): 200, (200, 1): 201}
    assert len(found) == 6
    assert {(r.deploy_block_slot, r.requested_delay_slots): r.entry_block_slot for r in found} == wanted
    same = first_in_slot_from(decisions, facts, position_lag=2, order=order, payload=()).collect()
    assert {(r.deploy_block_slot, r.entry_tx_index) for r in same} == {(100, None), (200, 9)}


def test_amounts_that_are_no_number_are_counted_and_stop_the_sums(spark):
    wallet = spark.createDataFrame([event("x", "buy", "NaN"), event("y", "sell", "3")], WALLET)
    assert cashflow_violations(wallet).first().rows_with_missing_cash == 1
    with pytest.raises(PySparkException, match="not finite"):
        token_cashflow(wallet).collect()


def test_tiny_and_huge_amounts_keep_their_ratio(spark):
    wallet = spark.createDataFrame(
        [event("x", "buy", "5e18", "3e-12"), event("y", "sell", "4e18", "1.5e-12")], WALLET
    )
    row = token_cashflow(wallet).first()
    assert (row.gross_buy_usd, row.gross_sell_usd, row.inventory_exit_ratio) == (5e18, 4e18, 0.5)


def test_large_finite_values_have_a_mean(spark):
    df = spark.createDataFrame([(1e20,), (3e20,), (float("inf"),)], "v double")
    row = finite_summary(df, ["v"]).first()
    assert (row["count"], row["mean"]) == (2, 2e20)


@pytest.mark.parametrize("value", [None, float("nan"), float("inf")])
def test_a_return_that_is_missing_stops_the_grid(spark, value):
    rows = spark.createDataFrame(
        [(1.0, 0.1, 1, 2), (3.0, value, 1, 2)],
        "population_weight double, gross_return double, entry_block_time long, exit_target_time long",
    )
    with pytest.raises(PySparkException, match="gross_return must be finite"):
        portfolio_grid(rows, {"gross": 0.0}, notional=10.0).collect()


def test_the_worst_drawdown_is_the_largest_not_the_first_of_nearly_equal(spark):
    curve = spark.createDataFrame(
        [(1, 99.0, 100.0, 1.0), (2, 49.0, 50.0, 1.0000000004)], "time long, equity double, peak double, drawdown double"
    )
    row = worst_drawdown(curve).first()
    assert round(row.max_drawdown_fraction, 6) == 0.02


def test_repeated_keys_stop_a_comparison_and_extra_keys_count(spark):
    left = spark.createDataFrame([(1, 5), (2, None), (3, 1)], "k int, v int")
    right = spark.createDataFrame([(1, 6), (2, None), (9, 1)], "k int, v int")
    row = compare_on_key(left, right, ["k"], ["v"]).first()
    assert (row.matched_rows, row.unmatched_rows, row.extra_right_rows, row.v_mismatches) == (2, 1, 1, 1)
    for a, b in ((left, right.unionAll(right)), (left.unionAll(left), right)):
        with pytest.raises(PySparkException, match="repeated"):
            compare_on_key(a, b, ["k"], ["v"]).collect()


def test_unmatched_rows_keep_nulls_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr("tidemark.operators.skew.ROWS_PER_TASK", 10)
    left = spark.range(200).select(F.when(F.col("id") < 150, F.lit(1)).when(F.col("id") < 199, F.col("id")).alias("k"))
    right = spark.createDataFrame([(1,), (1,), (160,), (None,)], "k long")
    assert unmatched(left, right, ["k"]).count() == 200 - 150 - 1


DECIDED = "token_address string, decision_time long"


@pytest.mark.parametrize(
    "events, rule",
    [
        ([event("x", "buy", "5"), event("x", "sell", "6")], "duplicate_transaction_rows.:1"),
        ([event("x", "buy", "5"), event("y", "sell", "-6")], "rows_with_negative_cash.:1"),
        ([event("x", "buy", "5"), event("y", "sell", None)], "rows_with_missing_cash.:1"),
    ],
)
def test_unsound_wallets_stop_the_portfolio(spark, events, rule):
    wallet = spark.createDataFrame(events, WALLET)
    decisions = spark.createDataFrame([("a", 1)], DECIDED)
    with pytest.raises(PySparkException, match=rule):
        wallet_portfolio(wallet, decisions, start=0, holdout_start=9)[1].collect()


def test_sound_wallets_give_decision_times_and_repeated_decisions_stop(spark):
    wallet = spark.createDataFrame([event("x", "buy", "5"), event("y", "sell", "6")], WALLET)
    counts, summary = wallet_portfolio(wallet, spark.createDataFrame([("a", 1), ("b", 7)], DECIDED), start=0, holdout_start=9)
    assert counts.first().development_candidate_tokens == 1
    assert (summary.first().decision_time_start, summary.first().decision_time_end) == (1, 1)
    with pytest.raises(PySparkException, match="right side is not unique"):
        wallet_portfolio(wallet, spark.createDataFrame([("a", 1), ("a", 2)], DECIDED), start=0, holdout_start=9)


def test_guards_name_the_broken_rule_and_add_no_job(spark):
    rows = spark.range(5)
    assert guarded(rows, expected_rows(rows, 5), "table").count() == 5
    with pytest.raises(PySparkException, match="table breaks its rules: .*row_count_difference.:2"):
        guarded(rows, expected_rows(rows, 3), "table").collect()


def test_wrong_exit_marks_stop_a_backtest(spark, monkeypatch):
    names = ("block_slot", "block_time", "tx_index")
    selected = spark.createDataFrame(
        [("a", 10, 100, 0, 1.0)],
        "token_address string, deploy_block_slot long, deploy_block_time long, deploy_tx_index int, population_weight double",
    )
    facts = spark.createDataFrame(
        [("a", 10, 100, 3, 2.0, 1.0), ("a", 11, 102, 0, 3.0, 1.0)],
        "token_address string, block_slot long, block_time long, tx_index int, price_usd double, price_sol double",
    )
    run = lambda: backtest.position_backtest(
        selected, facts, {"gross": 0.0}, position_lag=2, notional=1.0, hold_seconds=5, outcome_cutoff=200, order=names,
        payload=("price_usd", "price_sol"),
    )[2]
    assert run().first().gross_mean_return == 0.5
    found = backtest.mark_returns
    late = lambda *a, **k: found(*a, **k).withColumn("exit_block_time", F.col("exit_target_time") + 1)
    monkeypatch.setattr(backtest, "mark_returns", late)
    with pytest.raises(PySparkException, match="backtest rows breaks its rules.*exits_after_target.:1"):
        run().collect()


def test_strict_numbers_stop_on_text_that_is_no_number(spark):
    rows = spark.createDataFrame([("1.5", "x"), (None, "y"), ("1e3", "z")], "amount string, note string")
    assert [r.amount for r in strict_numbers(rows, ["amount"]).collect()] == [1.5, None, 1000.0]
    with pytest.raises(PySparkException, match="amount is no number: 1,5"):
        strict_numbers(rows.unionAll(spark.createDataFrame([("1,5", "w")], rows.schema)), ["amount"]).collect()


def test_sums_beyond_the_decimal_are_doubles(spark):
    rows = spark.createDataFrame([("a", 1e23), ("a", 1.0), ("b", 0.1), ("b", 0.2), ("c", None)], "k string, value double")
    found = {r.k: r for r in finite_summary(rows, ["value"], keys=["k"]).collect()}
    assert found["a"]["mean"] == 5e22 and found["b"]["mean"] == pytest.approx(0.15, abs=1e-17)
    assert found["c"]["mean"] is None and found["c"]["count"] == 0
    many = spark.range(1000).select(F.lit("k").alias("k"), F.lit(9e20).alias("value"))
    assert finite_summary(many, ["value"], keys=["k"]).first()["mean"] == pytest.approx(9e20)
