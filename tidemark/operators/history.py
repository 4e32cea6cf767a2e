"""Strictly-prior history of an actor, where everything in the same slot sees the same past."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import with_buckets
from tidemark.operators.sizing import buckets_for
from tidemark.operators.skew import hot_keys, join_unique
from tidemark.sources.scratch import materialise

HISTORY_COLUMNS = [
    "creator_prior_deploy_count",
    "creator_prior_active_slot_count",
    "creator_first_prior_deploy_time",
    "creator_first_prior_deploy_slot",
    "creator_previous_deploy_time",
    "creator_previous_deploy_slot",
]


def prior_history(
    indexes: list[DataFrame], *, rows_per_task: int | None = None, buckets: int | None = None
) -> DataFrame:
    """One row per (``tx_signer``, ``block_slot``) with what that signer did in strictly smaller slots.

    The union of all indexes is collapsed to one row per signer and slot, which both excludes same-slot siblings
    and shrinks the window input. A signer with more slots than one task should hold is cut along the slot order;
    the pieces are scanned on their own and receive what came before from one row per piece.
    """
    universe = indexes[0].select("tx_signer", "block_slot", "block_time")
    for other in indexes[1:]:
        universe = universe.unionAll(other.select("tx_signer", "block_slot", "block_time"))
    slots = universe.groupBy("tx_signer", "block_slot").agg(
        F.min("block_time").alias("block_time"), F.count(F.lit(1)).alias("_n")
    )
    slots = materialise(slots)  # counted below, then scanned
    hot = hot_keys(slots, ["tx_signer"], rows_per_task=rows_per_task)
    if hot is None:
        rows = slots.withColumn("_part", F.lit(-1))
    else:
        # Bounded number of hot signers; every other signer stays in one piece.
        marked = slots.join(F.broadcast(hot), "tx_signer", "left")
        rows = (
            with_buckets(marked, ["block_slot"], buckets=buckets or buckets_for(slots.count()))
            .withColumn("_part", F.when(F.col("_splits").isNull(), F.lit(-1)).otherwise(F.col("_bucket")))
            .drop("_splits", "_bucket")
        )
    part = Window.partitionBy("tx_signer", "_part").orderBy("block_slot")
    earlier = part.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        "tx_signer",
        "_part",
        "block_slot",
        "block_time",
        F.sum("_n").over(earlier).alias("_deploys"),
        F.count(F.lit(1)).over(earlier).alias("_slots"),
        F.min("block_time").over(earlier).alias("_first_time"),
        F.min("block_slot").over(earlier).alias("_first_slot"),
        F.lag("block_time").over(part).alias("_last_time"),
        F.lag("block_slot").over(part).alias("_last_slot"),
    )
    zero = F.lit(0).cast("long")
    if hot is None:
        return local.select(
            "tx_signer",
            "block_slot",
            "block_time",
            F.coalesce("_deploys", zero).alias("creator_prior_deploy_count"),
            F.coalesce("_slots", zero).alias("creator_prior_active_slot_count"),
            F.col("_first_time").alias("creator_first_prior_deploy_time"),
            F.col("_first_slot").alias("creator_first_prior_deploy_slot"),
            F.col("_last_time").alias("creator_previous_deploy_time"),
            F.col("_last_slot").alias("creator_previous_deploy_slot"),
        )
    across = Window.partitionBy("tx_signer").orderBy("_part")
    pieces_before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.where(F.col("_part") >= 0)
        .groupBy("tx_signer", "_part")
        .agg(
            F.sum("_n").alias("n"),
            F.count(F.lit(1)).alias("s"),
            F.min("block_time").alias("ft"),
            F.min("block_slot").alias("fs"),
            F.max(F.struct("block_slot", "block_time")).alias("last"),
        )
        .select(
            "tx_signer",
            "_part",
            F.sum("n").over(pieces_before).alias("_c_deploys"),
            F.sum("s").over(pieces_before).alias("_c_slots"),
            F.min("ft").over(pieces_before).alias("_c_first_time"),
            F.min("fs").over(pieces_before).alias("_c_first_slot"),
            F.lag("last").over(across).alias("_c_last"),
        )
    )
    return local.join(carried, ["tx_signer", "_part"], "left").select(
        "tx_signer",
        "block_slot",
        "block_time",
        (F.coalesce("_deploys", zero) + F.coalesce("_c_deploys", zero)).alias("creator_prior_deploy_count"),
        (F.coalesce("_slots", zero) + F.coalesce("_c_slots", zero)).alias("creator_prior_active_slot_count"),
        F.least("_first_time", "_c_first_time").alias("creator_first_prior_deploy_time"),
        F.least("_first_slot", "_c_first_slot").alias("creator_first_prior_deploy_slot"),
        F.coalesce("_last_time", "_c_last.block_time").alias("creator_previous_deploy_time"),
        F.coalesce("_last_slot", "_c_last.block_slot").alias("creator_previous_deploy_slot"),
    )


def history_violations(history: DataFrame) -> DataFrame:
    """Rows whose history is not strictly earlier; must be zero."""
    late = (F.col("creator_previous_deploy_slot") >= F.col("block_slot")) | (
        F.col("creator_first_prior_deploy_slot") >= F.col("block_slot")
    )
    return history.agg(F.count_if(F.coalesce(late, F.lit(False))).alias("strict_time_violations"))


def attach_history(
    deployments: DataFrame, history: DataFrame, *, epoch: str = "decision_epoch", rows_per_task: int | None = None
) -> DataFrame:
    """Add prior counts, observed age and recency to deployments; rows are neither lost nor repeated."""
    facts = history.select(
        "tx_signer",
        "block_slot",
        "creator_prior_deploy_count",
        "creator_prior_active_slot_count",
        F.col("creator_first_prior_deploy_time").alias("_first"),
        F.col("creator_previous_deploy_time").alias("_previous"),
    )
    joined = join_unique(
        deployments, facts, ["tx_signer", "block_slot"], spread=F.xxhash64(*deployments.columns),
        rows_per_task=rows_per_task,
    )
    return joined.select(
        *deployments.columns,
        "creator_prior_deploy_count",
        "creator_prior_active_slot_count",
        (F.col(epoch) - F.col("_first")).alias("creator_observed_age_seconds"),
        (F.col(epoch) - F.col("_previous")).alias("creator_seconds_since_previous_deploy"),
    )
