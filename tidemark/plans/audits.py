"""Source audits end to end: counters, keys, contexts and nulls in one report with an issue list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.guards import has_columns
from tidemark.operators import quality
from tidemark.operators.cashflow import first_event, trade_events, wallet_summary
from tidemark.operators.quantiles import finite_summary
from tidemark.sources.schemas import SLOT_DELAY_COLUMNS
from tidemark.sources.scratch import materialise

CONTEXT = ("deploy_block_time", "deploy_block_slot", "deploy_tx_index", "deploy_tx_hash", "deploy_tx_signer")
# Trade columns that may be null, and need a filter when amounts are summed.
NULLABLE_AMOUNTS = ("amount_usd", "amount_sol")
# Issue names of the candle audit and the counters behind them.
CANDLE_ISSUES = {
    "null_values": "null_rows",
    "pre_deploy_candles_require_exclusion": "pre_deploy_rows",
    "second_timestamp_alignment": "second_alignment_violations",
    "invalid_ohlc": "invalid_ohlc_rows",
    "negative_volume_or_amount": "negative_flow_rows",
    "duplicate_token_resolution_time_keys": "duplicate_key_groups",
}


def audit_trades(
    trades: DataFrame, *, key: Sequence[str], sides: Sequence[str] = quality.SIDES,
    programs: Sequence[str] = quality.PROGRAMS,
) -> DataFrame:
    """One row about a trades table. ``key`` must identify a row; null amounts are legal but reported.

    The rows are written once: they usually come out of a join with their decisions, and four aggregates read them.
    """
    trades = materialise(trades)
    counters = quality.trade_audit(trades, sides=sides, programs=programs)
    duplicates = quality.duplicate_keys(trades, key)
    contexts = quality.keys_with_several_contexts(
        trades, "token_address", [c for c in CONTEXT if c in trades.columns], "tokens_with_multiple_deploy_contexts"
    )
    unexpected = [c for c in trades.columns if c not in NULLABLE_AMOUNTS]
    amounts = [c for c in NULLABLE_AMOUNTS if c in trades.columns]
    nulls = trades.agg(
        _null_total(unexpected).alias("unexpected_null_values"),
        _null_total(amounts).alias("null_amount_fields_require_size_filter"),
    )
    report = counters.crossJoin(duplicates).crossJoin(contexts).crossJoin(nulls)
    names = ["unexpected_null_values", "null_amount_fields_require_size_filter", *quality.GUARDED_TRADE_COUNTERS]
    supported = has_columns(trades, SLOT_DELAY_COLUMNS)
    return quality.issues(report, [n for n in names if n in report.columns]).withColumn(
        "exact_slot_delay_supported", F.lit(supported)
    )


def audit_candles(bars: DataFrame) -> DataFrame:
    """One row about a candle table, which is written once since three aggregates read it."""
    bars = materialise(bars)
    report = (
        quality.bar_audit(bars)
        .crossJoin(quality.duplicate_keys(bars, ["token_address", "resolution", "candle_time_ms"]))
        .crossJoin(bars.agg(_null_total(bars.columns).alias("null_rows")))
    )
    named = report.withColumns({issue: F.col(counter) for issue, counter in CANDLE_ISSUES.items()})
    return (
        quality.issues(named, list(CANDLE_ISSUES))
        .drop(*CANDLE_ISSUES)
        .withColumn("exact_slot_delay_supported", F.lit(has_columns(bars, ["block_slot", "transaction_index"])))
    )


def audit_wallet(wallet: DataFrame) -> DataFrame:
    """Finite summaries of entry size, all buys, sells per token, holding time and gross result per token."""
    buys = trade_events(wallet).where(F.col("event_type") == "buy")
    cost = F.col("cost_usd").try_cast("double")
    entry = first_event(buys.withColumn("entry_size_usd", cost), ["entry_size_usd"])
    tokens = wallet_summary(wallet)
    return (
        finite_summary(entry, ["entry_size_usd"])
        .unionByName(finite_summary(buys.select(cost.alias("all_buy_size_usd")), ["all_buy_size_usd"]))
        .unionByName(finite_summary(tokens, ["sell_transactions", "hold_seconds", "gross_pnl_usd"]))
    )


def _null_total(columns: Sequence[str]):
    total = F.lit(0).cast("long")
    for c in columns:
        total = total + F.count(F.lit(1)) - F.count(F.col(c))
    return total
