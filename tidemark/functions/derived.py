"""Derived decision features. Bad input stops the job through an in-plan assertion; no extra pass is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.guards import require_columns

# Day length, shortest observation, length of the prefix "ipfs://", and the fee each signature costs.
SECONDS_PER_DAY = 86_400.0
MINIMUM_OBSERVED_DAYS = 1.0
IPFS_PREFIX_LENGTH = 7
BASE_SIGNATURE_FEE = 5000


def checked(value: Column, *rules: tuple[Column, str]) -> Column:
    """``value`` unless a rule is broken; a rule that evaluates to null counts as broken."""
    result = value
    for ok, message in reversed(rules):
        result = F.when(F.coalesce(ok, F.lit(False)), result).otherwise(F.raise_error(F.lit(message)))
    return result


def add_deployment_rate(df: DataFrame) -> DataFrame:
    """Prior deployments per observed day; an actor seen for less than a day counts as one day."""
    require_columns(df, ["creator_prior_deploy_count", "creator_observed_age_seconds"])
    count, age = F.col("creator_prior_deploy_count"), F.col("creator_observed_age_seconds")
    days = F.greatest(F.coalesce(age, F.lit(0)) / F.lit(SECONDS_PER_DAY), F.lit(MINIMUM_OBSERVED_DAYS))
    rate = F.when(count == 0, F.lit(0.0)).otherwise(count.cast("double") / days)
    return df.withColumn(
        "creator_prior_deploys_per_observed_day",
        checked(
            rate,
            (count.isNotNull(), "prior deploy count is missing"),
            (count >= 0, "prior deploy count is negative"),
            (age.isNull() | (age >= 0), "observed age is negative"),
            (age.isNotNull() | (count == 0), "observed age is missing although history exists"),
        ),
    )


def add_slot_batching(df: DataFrame) -> DataFrame:
    """Prior deployments per active slot: 0 without history, otherwise at least 1."""
    require_columns(df, ["creator_prior_deploy_count", "creator_prior_active_slot_count"])
    count, slots = F.col("creator_prior_deploy_count"), F.col("creator_prior_active_slot_count")
    ratio = F.when(count == 0, F.lit(0.0)).otherwise(count.cast("double") / F.greatest(slots, F.lit(1)))
    return df.withColumn(
        "creator_prior_deploys_per_active_slot",
        checked(
            ratio,
            (count.isNotNull() & slots.isNotNull(), "history counts are missing"),
            ((count >= 0) & (slots >= 0), "history counts are negative"),
            (slots <= count, "active slots exceed deployments"),
            ((count == 0) == (slots == 0), "only one history count is zero"),
        ),
    )


def add_fee_intensity(df: DataFrame) -> DataFrame:
    """Priority fee per consumed compute unit."""
    require_columns(df, ["priority_fee_lamports", "compute_units"])
    fee, units = F.col("priority_fee_lamports"), F.col("compute_units")
    return df.withColumn(
        "priority_fee_lamports_per_compute_unit",
        checked(
            F.try_divide(fee.cast("double"), units.cast("double")),
            (fee.isNotNull() & units.isNotNull(), "fee or compute units are null"),
            (units > 0, "compute units must be positive"),
            (fee >= 0, "priority fee is negative"),
        ),
    )


def add_uri_payload_length(df: DataFrame) -> DataFrame:
    """URI length without the fixed ``ipfs://`` prefix."""
    require_columns(df, ["metadata_uri_length", "metadata_uri_is_ipfs"])
    length, flag = F.col("metadata_uri_length"), F.col("metadata_uri_is_ipfs")
    payload = length - F.lit(IPFS_PREFIX_LENGTH) * flag
    return df.withColumn(
        "metadata_uri_payload_length",
        checked(
            payload,
            (length.isNotNull() & flag.isNotNull(), "length or flag of the URI is null"),
            (length >= 0, "URI length is negative"),
            (flag.isin(0, 1), "IPFS flag is not binary"),
            (payload >= 0, "URI payload length is negative"),
        ),
    )


def add_nonfee_outflow(df: DataFrame) -> DataFrame:
    """What left the signer's balance beyond the transaction fee, never below zero."""
    require_columns(df, ["signer_lamport_delta", "tx_fee_lamports"])
    delta, fee = F.col("signer_lamport_delta"), F.col("tx_fee_lamports")
    return df.withColumn(
        "deployment_signer_nonfee_outflow_lamports",
        checked(
            F.greatest(-delta - fee, F.lit(0)),
            (delta.isNotNull() & fee.isNotNull(), "outflow inputs are missing"),
        ),
    )


def fee_rate_bps(gas: str = "gas_usd", dex: str = "dex_usd", cost: str = "cost_usd") -> Column:
    """Fees in basis points of the traded amount; null when not finite or negative."""
    number = lambda c: F.col(c).try_cast("double")
    rate = F.try_divide(
        F.lit(10_000.0) * (F.coalesce(number(gas), F.lit(0.0)) + F.coalesce(number(dex), F.lit(0.0))), number(cost)
    )
    return F.when((rate >= 0) & (rate < F.lit(float("inf"))), rate)


def population_weight(label: str = "label", negative_weight: float = 25.0) -> Column:
    """Negatives stand for the rows their systematic sample left out."""
    return F.when(F.col(label) == 0, F.lit(float(negative_weight))).otherwise(F.lit(1.0))
