from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.registry import query
from tidemark.functions import derived
from tidemark.operators import history, joins, quality

# Both indexes together are the whole deployment table, split by class as the labelled sources are.
HISTORY_SQL = """slots AS (
    SELECT tx_signer, block_slot, min(block_time) AS block_time, count(*) AS n FROM deployments
    GROUP BY tx_signer, block_slot),
history AS (
    SELECT tx_signer, block_slot,
           CAST(coalesce(sum(n) OVER prior, 0) AS BIGINT) AS creator_prior_deploy_count,
           count(*) OVER prior AS creator_prior_active_slot_count,
           min(block_time) OVER prior AS creator_first_prior_deploy_time,
           min(block_slot) OVER prior AS creator_first_prior_deploy_slot,
           lag(block_time) OVER w AS creator_previous_deploy_time,
           lag(block_slot) OVER w AS creator_previous_deploy_slot
    FROM slots
    WINDOW w AS (PARTITION BY tx_signer ORDER BY block_slot),
           prior AS (PARTITION BY tx_signer ORDER BY block_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
labelled AS (
    SELECT d.*, h.creator_prior_deploy_count, h.creator_prior_active_slot_count,
           d.decision_time - h.creator_first_prior_deploy_time AS creator_observed_age_seconds,
           d.decision_time - h.creator_previous_deploy_time AS creator_seconds_since_previous_deploy
    FROM deployments d JOIN history h USING (tx_signer, block_slot))"""
LABELLED_SQL = f"{b.DEPLOYMENTS_SQL}, {HISTORY_SQL}"


def _indexes(spark, sf_dir):
    d = b.deployments(spark, sf_dir)
    return [d.where(F.col("label") == 1), d.where(F.col("label") == 0)]


def labelled(spark, sf_dir):
    prior = history.prior_history(_indexes(spark, sf_dir))
    return history.attach_history(b.deployments(spark, sf_dir), prior, epoch="decision_time")


@query("prior_history", f"WITH {LABELLED_SQL} SELECT * FROM history")
def prior_history(spark, sf_dir):
    return history.prior_history(_indexes(spark, sf_dir)).drop("block_time")


@query(
    "prior_history_join",
    f"""WITH {LABELLED_SQL} SELECT token_address, tx_signer, block_slot, creator_prior_deploy_count,
    creator_prior_active_slot_count, creator_observed_age_seconds, creator_seconds_since_previous_deploy
    FROM labelled""",
)
def prior_history_join(spark, sf_dir):
    return labelled(spark, sf_dir).select(
        "token_address", "tx_signer", "block_slot", "creator_prior_deploy_count", "creator_prior_active_slot_count",
        "creator_observed_age_seconds", "creator_seconds_since_previous_deploy",
    )


@query(
    "history_cardinality",
    f"""WITH {LABELLED_SQL}
    SELECT (SELECT count(*) FROM deployments) AS source_rows,
           (SELECT count(DISTINCT token_address) FROM deployments) AS source_keys,
           count(*) AS output_rows, count(DISTINCT token_address) AS output_keys,
           (SELECT count(*) FROM history WHERE creator_previous_deploy_slot >= block_slot
                OR creator_first_prior_deploy_slot >= block_slot) AS strict_time_violations
    FROM labelled""",
)
def history_cardinality(spark, sf_dir):
    change = joins.cardinality_change(b.deployments(spark, sf_dir), labelled(spark, sf_dir), ["token_address"])
    return change.crossJoin(history.history_violations(history.prior_history(_indexes(spark, sf_dir))))


@query(
    "prior_rate",
    f"""WITH {LABELLED_SQL}
    SELECT token_address, round(CASE WHEN creator_prior_deploy_count = 0 THEN 0.0::DOUBLE
        ELSE creator_prior_deploy_count
             / greatest(coalesce(creator_observed_age_seconds, 0) / 86400.0::DOUBLE, 1.0::DOUBLE) END, 9)
        AS creator_prior_deploys_per_observed_day
    FROM labelled""",
)
def prior_rate(spark, sf_dir):
    rated = derived.add_deployment_rate(labelled(spark, sf_dir))
    name = "creator_prior_deploys_per_observed_day"
    return rated.select("token_address", F.round(name, 9).alias(name))


@query(
    "prior_batching",
    f"""WITH {LABELLED_SQL}
    SELECT token_address, round(CASE WHEN creator_prior_deploy_count = 0 THEN 0.0::DOUBLE
        ELSE creator_prior_deploy_count / CAST(creator_prior_active_slot_count AS DOUBLE) END, 9)
        AS creator_prior_deploys_per_active_slot
    FROM labelled""",
)
def prior_batching(spark, sf_dir):
    name = "creator_prior_deploys_per_active_slot"
    return derived.add_slot_batching(labelled(spark, sf_dir)).select("token_address", F.round(name, 9).alias(name))


@query(
    "history_quality",
    f"""WITH {LABELLED_SQL}
    SELECT count(*) FILTER (WHERE creator_prior_deploy_count < 0) AS negative_prior_count_rows,
           count(*) FILTER (WHERE creator_prior_active_slot_count < 0) AS negative_prior_slot_count_rows,
           count(*) FILTER (WHERE creator_observed_age_seconds < 0) AS negative_observed_age_rows,
           count(*) FILTER (WHERE creator_seconds_since_previous_deploy < 0) AS negative_recency_rows,
           count(*) FILTER (WHERE creator_prior_deploy_count <> 0 AND creator_observed_age_seconds IS NULL)
               AS nonzero_count_missing_age_rows,
           count(*) FILTER (WHERE creator_prior_deploy_count <> 0 AND creator_seconds_since_previous_deploy IS NULL)
               AS nonzero_count_missing_recency_rows,
           count(*) FILTER (WHERE creator_prior_active_slot_count > creator_prior_deploy_count)
               AS active_slots_exceed_count_rows,
           count(*) FILTER (WHERE (creator_prior_deploy_count = 0) <> (creator_prior_active_slot_count = 0))
               AS zero_pattern_mismatch_rows
    FROM labelled""",
)
def history_quality(spark, sf_dir):
    return quality.history_quality(labelled(spark, sf_dir))
