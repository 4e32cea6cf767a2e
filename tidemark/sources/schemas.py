"""Fixed table contracts."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    fields = [part.split() for part in text.strip().splitlines()]
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
             "timestamp": T.TimestampType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


# Names, types and order that the source and output tables must have.
TRADES = _schema(
    """
    token_address string
    slot_index_id string
    block_slot long
    tx_index int
    event_index int
    tx_hash string
    timestamp string
    block_time long
    user_address string
    side string
    program string
    price_usd double
    price_sol double
    amount_usd double
    amount_sol double
    base_amount double
    quote_amount double
    quote_mint string
    base_decimals int
    quote_decimals int
    deploy_block_time long
    deploy_block_slot long
    deploy_tx_index int
    deploy_tx_hash string
    deploy_tx_signer string
    creator_address string
    """
)
CANDLES = _schema(
    """
    token_address string
    resolution string
    deploy_time_ms long
    deploy_time_s long
    candle_time_ms long
    candle_time_s long
    open_mcap double
    high_mcap double
    low_mcap double
    close_mcap double
    volume double
    amount double
    """
)
ENTRY_PRICES = _schema(
    """
    token_address string
    decision_time timestamp
    deploy_block_time long
    deploy_block_slot long
    deploy_tx_index long
    requested_delay_slots int
    target_entry_slot long
    covered boolean
    entry_slot_index_id string
    entry_block_slot long
    entry_tx_index int
    entry_event_index int
    entry_block_time long
    entry_timestamp string
    entry_tx_hash string
    entry_side string
    entry_program string
    entry_price_usd double
    entry_price_sol double
    actual_delay_slots long
    wait_slots_beyond_target long
    """
)
# Columns a table needs before exact slot delays can be measured on it.
SLOT_DELAY_COLUMNS = (
    "block_slot",
    "tx_index",
    "event_index",
    "deploy_block_slot",
    "deploy_tx_index",
    "price_usd",
    "price_sol",
)
TRADE_ORDER = ("block_slot", "tx_index", "event_index")
TRADE_PAYLOAD = ("slot_index_id", "block_time", "timestamp", "tx_hash", "side", "program", "price_usd", "price_sol")
