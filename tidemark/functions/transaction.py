"""Flat features from one nested transaction document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.derived import BASE_SIGNATURE_FEE

# Parts whose inner shape varies are read as raw JSON text; only their number or presence matters.
RAW_TRANSACTION_SCHEMA = """
    blockTime BIGINT, slot BIGINT, transactionIndex BIGINT,
    transaction STRUCT<
        message: STRUCT<instructions: ARRAY<STRING>, accountKeys: ARRAY<STRING>>,
        signatures: ARRAY<STRING>>,
    meta STRUCT<
        fee: BIGINT, computeUnitsConsumed: BIGINT, costUnits: BIGINT, err: STRING,
        innerInstructions: ARRAY<STRUCT<instructions: ARRAY<STRUCT<parsed: STRING>>>>,
        preBalances: ARRAY<BIGINT>, postBalances: ARRAY<BIGINT>,
        preTokenBalances: ARRAY<STRING>, postTokenBalances: ARRAY<STRING>, logMessages: ARRAY<STRING>>
"""
_PARSED_SCHEMA = "type STRING, info STRING"
_INFO_SCHEMA = "uri STRING, name STRING, symbol STRING"
# The instruction that carries token metadata, and the names and order of the extracted columns.
METADATA_TYPE = "initializeTokenMetadata"
FEATURE_COLUMNS = [
    "decision_epoch",
    "block_slot",
    "transaction_index",
    "tx_fee_lamports",
    "priority_fee_lamports",
    "compute_units",
    "cost_units",
    "outer_instruction_count",
    "inner_instruction_count",
    "account_count",
    "signature_count",
    "log_message_count",
    "pre_token_balance_count",
    "post_token_balance_count",
    "signer_lamport_delta",
    "metadata_name_length",
    "metadata_symbol_length",
    "metadata_uri_length",
    "metadata_uri_is_ipfs",
    "metadata_present",
    "transaction_error",
]


def transaction_features(df: DataFrame, json_column: str = "value") -> DataFrame:
    """Replace a JSON document column by its 21 features; all other columns stay.

    Works on batch and streaming input alike: every output depends on its own row only.
    """
    others = [c for c in df.columns if c != json_column]
    doc = df.withColumn("_d", F.from_json(F.col(json_column), RAW_TRANSACTION_SCHEMA))
    inner = F.flatten(
        F.transform(
            F.filter("_d.meta.innerInstructions", lambda g: g.isNotNull()),
            lambda g: F.coalesce(g["instructions"], F.array().cast("array<struct<parsed:string>>")),
        )
    )
    parsed = doc.withColumn("_inner", inner).withColumn(
        "_parsed",
        F.transform(
            F.filter("_inner", lambda i: i["parsed"].isNotNull()),
            lambda i: F.from_json(i["parsed"], _PARSED_SCHEMA),
        ),
    )
    first = F.get(F.filter("_parsed", lambda p: p["type"] == METADATA_TYPE), F.lit(0))["info"]
    ready = parsed.withColumn("_info_text", first).withColumn("_info", F.from_json("_info_text", _INFO_SCHEMA))
    signatures = _length("_d.transaction.signatures")
    fee = F.col("_d.meta.fee")
    uri = F.coalesce(F.col("_info.uri"), F.lit(""))
    pre, post = F.col("_d.meta.preBalances"), F.col("_d.meta.postBalances")
    return ready.select(
        *others,
        F.col("_d.blockTime").alias("decision_epoch"),
        F.col("_d.slot").alias("block_slot"),
        F.col("_d.transactionIndex").alias("transaction_index"),
        fee.alias("tx_fee_lamports"),
        F.when(
            fee.isNotNull(),
            F.greatest(F.lit(0), fee - F.lit(BASE_SIGNATURE_FEE) * F.greatest(F.lit(1), signatures)),
        ).alias("priority_fee_lamports"),
        F.col("_d.meta.computeUnitsConsumed").alias("compute_units"),
        F.col("_d.meta.costUnits").alias("cost_units"),
        _length("_d.transaction.message.instructions").alias("outer_instruction_count"),
        _length("_inner").alias("inner_instruction_count"),
        _length("_d.transaction.message.accountKeys").alias("account_count"),
        signatures.alias("signature_count"),
        _length("_d.meta.logMessages").alias("log_message_count"),
        _length("_d.meta.preTokenBalances").alias("pre_token_balance_count"),
        _length("_d.meta.postTokenBalances").alias("post_token_balance_count"),
        (F.get(post, F.lit(0)) - F.get(pre, F.lit(0))).alias("signer_lamport_delta"),
        _characters("_info.name").alias("metadata_name_length"),
        _characters("_info.symbol").alias("metadata_symbol_length"),
        F.char_length(uri).alias("metadata_uri_length"),
        F.contains(F.lower(uri), F.lit("ipfs")).cast("int").alias("metadata_uri_is_ipfs"),
        F.coalesce(F.regexp_replace("_info_text", r"\s", "") != "{}", F.lit(False)).cast("int").alias("metadata_present"),
        F.col("_d.meta.err").isNotNull().cast("int").alias("transaction_error"),
    )


def _length(path: str) -> Column:
    return F.coalesce(F.size(F.col(path)), F.lit(0))


def _characters(path: str) -> Column:
    return F.char_length(F.coalesce(F.col(path), F.lit("")))
