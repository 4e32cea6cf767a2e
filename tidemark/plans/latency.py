"""How long after a decision the wallet's first buy came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cashflow import first_event
from tidemark.operators.joins import one_to_one
from tidemark.operators.quantiles import finite_summary

MEASURES = ("latency_slots", "latency_seconds", "same_slot_position_delta", "entry_cost_usd")


def entry_latency(deployments: DataFrame, wallet: DataFrame, positions: DataFrame) -> DataFrame:
    """One row per deployment with seconds, slots and, within one slot, transactions until the first buy.

    ``deployments``: token_address, tx_hash, decision_time, decision_epoch, block_slot, tx_index.
    ``wallet``: token_address, tx_hash, timestamp, event_type, cost_usd.
    ``positions``: buy_tx_hash, buy_block_time, buy_slot, buy_tx_index. Repeated tokens or hashes stop the plan.
    """
    buys = wallet.where(F.col("event_type") == "buy").withColumn(
        "entry_cost_usd", F.col("cost_usd").try_cast("double")
    )
    first = first_event(buys, ["entry_cost_usd"]).withColumnsRenamed(
        {"timestamp": "wallet_buy_timestamp", "tx_hash": "buy_tx_hash"}
    )
    decided = deployments.withColumnsRenamed(
        {"tx_hash": "deploy_tx_hash", "block_slot": "deploy_slot", "tx_index": "deploy_tx_index"}
    )
    placed = one_to_one(first, positions, ["buy_tx_hash"], "left")
    joined = one_to_one(decided, placed, ["token_address"], "left")
    slots = F.col("buy_slot") - F.col("deploy_slot")
    return joined.withColumns(
        {
            "latency_seconds": F.col("buy_block_time") - F.col("decision_epoch"),
            "latency_slots": slots,
            "same_slot_position_delta": F.when(slots == 0, F.col("buy_tx_index") - F.col("deploy_tx_index")),
        }
    )


def latency_summary(latency: DataFrame) -> DataFrame:
    """Finite summary per measure, with the number of decisions, matches and the zero-slot share on every row."""
    matched = latency.where(F.col("latency_slots").isNotNull())
    counts = latency.agg(
        F.count(F.lit(1)).alias("deployment_rows"),
        F.count("latency_slots").alias("matched_first_buys"),
        F.avg((F.col("latency_slots") == 0).cast("double")).alias("zero_slot_share"),
    )
    return finite_summary(matched, MEASURES).crossJoin(F.broadcast(counts))
