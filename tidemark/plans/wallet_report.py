"""What the wallet really earned, next to what a replica would have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cashflow import (
    cashflow_integrity,
    cashflow_violations,
    closed_portfolio,
    closed_positions,
    outcome_crosses,
    token_cashflow,
)
from tidemark.operators.compare import profitability_gate
from tidemark.operators.joins import one_to_one
from tidemark.operators.quality import guarded
from tidemark.sources.scratch import materialise


def wallet_portfolio(
    wallet: DataFrame, decisions: DataFrame, *, start: object, holdout_start: Column | object
) -> tuple[DataFrame, DataFrame]:
    """Censoring counts and the closed-position summary of tokens decided in ``start <= time < holdout_start``.

    Tokens whose outcome reaches the boundary are counted and left out. Repeated transactions, missing or negative cash,
    reversed times and tokens decided twice stop the plan.
    """
    sound = guarded(wallet, cashflow_violations(wallet), "wallet activity")
    built = materialise(
        one_to_one(token_cashflow(sound), decisions.select("token_address", "decision_time"), ["token_address"], "left")
    )
    flows = guarded(built, cashflow_integrity(built), "cash-flow table")
    known = flows.where((F.col("decision_time") >= start) & (F.col("decision_time") < holdout_start))
    flagged = outcome_crosses(known, holdout_start)
    counts = flagged.agg(
        F.count(F.lit(1)).alias("development_candidate_tokens"),
        F.count_if("outcome_crosses_boundary").alias("development_censored_tokens"),
    ).crossJoin(flows.agg(F.count_if(F.col("decision_time").isNull()).alias("unmatched_wallet_tokens")))
    safe = closed_positions(flagged.where(~F.col("outcome_crosses_boundary")))
    # ``flows`` is written once; every part of the summary reads only the columns it needs.
    return counts, profitability_gate(closed_portfolio(safe))


def head_to_head(wallet_row: DataFrame, replica_grid: DataFrame) -> DataFrame:
    """Wallet and replica measures side by side, one row each."""
    measures = ["net_mean_return", "net_median_return", "hit_rate", "max_drawdown_fraction", "net_pnl_usd"]
    actual = wallet_row.select(
        F.lit("wallet").alias("entry_set"),
        F.col("token_rows").alias("rows"),
        F.col("net_mean_roi").alias("net_mean_return"),
        F.col("net_median_roi").alias("net_median_return"),
        F.col("net_hit_rate").alias("hit_rate"),
        "max_drawdown_fraction",
        "net_pnl_usd",
    )
    replica = replica_grid.where(F.col("fee_scenario") == "training_median_fee").select(
        F.lit("replica").alias("entry_set"),
        F.col("executed_sample_rows").alias("rows"),
        "net_mean_return",
        F.col("net_median_return_unweighted").alias("net_median_return"),
        F.col("net_hit_rate").alias("hit_rate"),
        "max_drawdown_fraction",
        F.col("total_weighted_pnl_usd").alias("net_pnl_usd"),
    )
    return actual.unionByName(replica).select("entry_set", "rows", *measures)
