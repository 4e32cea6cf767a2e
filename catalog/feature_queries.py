from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.history_queries import LABELLED_SQL, labelled
from catalog.registry import query
from catalog.wallet_queries import rounded
from tidemark.functions import derived
from tidemark.functions.clock import add_utc_clock
from tidemark.functions.transaction import FEATURE_COLUMNS, transaction_features
from tidemark.plans.dataset import combine_classes, labelled_features
from tidemark.plans.experiments import (
    attribution,
    development_report,
    score_variants,
    variant_deltas,
    variant_results,
)
from tidemark.plans.models import ModelSpec, fit
from tidemark.operators.joins import in_window
from tidemark.operators.splits import three_way_split
from tidemark.sources.scratch import materialise
from tidemark.sources.tables import systematic_sample

R = b.RAW_SQL


@query("json_features", f"WITH {R} SELECT line_number, {', '.join(FEATURE_COLUMNS)} FROM raw")
def json_features(spark, sf_dir):
    return transaction_features(b.raw_documents(spark, sf_dir))


@query("line_sample", "SELECT doc_id + 1 AS line_number, source, n_chars FROM documents WHERE (doc_id + 1) % 25 = 0")
def line_sample(spark, sf_dir):
    documents = b.table(spark, sf_dir, "documents").withColumn("line_number", F.col("doc_id") + 1)
    return systematic_sample(documents, 25).select("line_number", "source", "n_chars")


def _index(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1).alias("line_number"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("token_address"),
        F.col("source").alias("tx_signer"),
    )


@query(
    "labelled_dataset",
    f"""WITH {R}, both_classes AS (
        SELECT 't' || CAST(line_number - 1 AS VARCHAR) AS token_address, 1 AS label, * FROM raw WHERE line_number % 2 = 1
        UNION ALL SELECT 't' || CAST(line_number - 1 AS VARCHAR), 0, * FROM raw
        WHERE line_number % 25 = 0 AND line_number % 2 = 0)
    SELECT token_address, label, line_number, {', '.join(FEATURE_COLUMNS)},
           hour(to_timestamp(decision_epoch) AT TIME ZONE 'UTC') AS decision_hour_utc,
           isodow(to_timestamp(decision_epoch) AT TIME ZONE 'UTC') - 1 AS decision_weekday_utc FROM both_classes""",
)
def labelled_dataset(spark, sf_dir):
    lines, index = b.raw_documents(spark, sf_dir), _index(spark, sf_dir)
    odd = F.col("line_number") % 2 == 1
    positive = labelled_features(lines.where(odd), index, 1)
    negative = labelled_features(lines.where(~odd), index, 0, stride=25)
    return combine_classes(positive, negative).drop("decision_time", "tx_signer")


@query(
    "union_by_name",
    """SELECT CAST(doc_id AS VARCHAR) AS id, n_chars AS size, lang, NULL AS url FROM documents
    UNION ALL SELECT CAST(page_id AS VARCHAR), length(html), NULL, url FROM pages""",
)
def union_by_name(spark, sf_dir):
    documents = b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("size"), "lang"
    )
    pages = b.table(spark, sf_dir, "pages").select(
        "url", F.char_length("html").cast("long").alias("size"), F.col("page_id").cast("string").alias("id")
    )
    return combine_classes(documents, pages)


@query(
    "nonfee_outflow",
    f"""WITH {R} SELECT line_number, greatest(-signer_lamport_delta - tx_fee_lamports, 0)
        AS deployment_signer_nonfee_outflow_lamports FROM raw
    WHERE signer_lamport_delta IS NOT NULL AND tx_fee_lamports IS NOT NULL""",
)
def nonfee_outflow(spark, sf_dir):
    known = transaction_features(b.raw_documents(spark, sf_dir)).where(
        F.col("signer_lamport_delta").isNotNull() & F.col("tx_fee_lamports").isNotNull()
    )
    return derived.add_nonfee_outflow(known).select("line_number", "deployment_signer_nonfee_outflow_lamports")


@query(
    "fee_intensity",
    f"""WITH {R} SELECT line_number, round(priority_fee_lamports / CAST(compute_units AS DOUBLE), 9)
        AS priority_fee_lamports_per_compute_unit FROM raw WHERE priority_fee_lamports IS NOT NULL""",
)
def fee_intensity(spark, sf_dir):
    known = transaction_features(b.raw_documents(spark, sf_dir)).where(F.col("priority_fee_lamports").isNotNull())
    name = "priority_fee_lamports_per_compute_unit"
    return rounded(derived.add_fee_intensity(known).select("line_number", name), [name], 9)


@query(
    "payload_length",
    f"""WITH {R} SELECT line_number, metadata_uri_length - 7 * metadata_uri_is_ipfs AS metadata_uri_payload_length FROM raw""",
)
def payload_length(spark, sf_dir):
    features = transaction_features(b.raw_documents(spark, sf_dir))
    return derived.add_uri_payload_length(features).select("line_number", "metadata_uri_payload_length")


FEATURES = ["creator_prior_deploy_count", "creator_prior_active_slot_count", "creator_observed_age_seconds",
            "creator_seconds_since_previous_deploy", "o_totalprice", "tx_index", "decision_hour_utc",
            "decision_weekday_utc"]
HISTORY = FEATURES[:4]
GROUPS = {"creator_history": HISTORY, "value": ["o_totalprice"], "structure": ["tx_index"],
          "decision_time": ["decision_hour_utc", "decision_weekday_utc"]}


def training_table(spark, sf_dir):
    rows = add_utc_clock(
        labelled(spark, sf_dir).withColumn("moment", F.timestamp_seconds("decision_time")), "moment"
    )
    return materialise(rows.select("token_address", "decision_time", "label", *FEATURES))


def _scores(spark, sf_dir, spec):
    split = materialise(three_way_split(training_table(spark, sf_dir), "decision_time"))
    model = fit(split.where(F.col("split") == "train"), FEATURES, spec)
    return model.score(split.where(F.col("split") == "validation")).select("token_address", "label", "probability")


@query("logreg_scores")
def logreg_scores(spark, sf_dir):
    return _scores(spark, sf_dir, ModelSpec("logistic"))


@query("gbt_scores")
def gbt_scores(spark, sf_dir):
    return _scores(spark, sf_dir, ModelSpec("boosting"))


@query("baseline_report")
def baseline_report(spark, sf_dir):
    return development_report(training_table(spark, sf_dir), FEATURES, ModelSpec("logistic"), evaluate_test=True)


@query("boosting_report")
def boosting_report(spark, sf_dir):
    return development_report(training_table(spark, sf_dir), FEATURES, ModelSpec("boosting"), evaluate_test=False)


@query("ablation")
def ablation(spark, sf_dir):
    table = training_table(spark, sf_dir)
    variants = {"without_history": [f for f in FEATURES if f not in HISTORY], "with_history": FEATURES}
    scored = materialise(score_variants(table, variants, ModelSpec("boosting")))
    return variant_deltas(variant_results(scored, "history"), "without_history")


@query("permutation_importance")
def permutation(spark, sf_dir):
    active = in_window(training_table(spark, sf_dir), "decision_time", F.col("label") == 1)
    return attribution(active, FEATURES, GROUPS, ModelSpec("boosting"))


@query(
    "guarded_features",
    f"""WITH {LABELLED_SQL} SELECT token_address, creator_prior_deploy_count, creator_observed_age_seconds FROM labelled
    WHERE creator_observed_age_seconds IS NULL OR creator_observed_age_seconds >= 0""",
)
def guarded_features(spark, sf_dir):
    from tidemark.functions.guards import require_pre_decision_names

    require_pre_decision_names(FEATURES)
    age = F.col("creator_observed_age_seconds")
    guarded = labelled(spark, sf_dir).withColumn(
        "creator_observed_age_seconds",
        derived.checked(age, (age.isNull() | (age >= 0), "history lies after the decision")),
    )
    return guarded.select("token_address", "creator_prior_deploy_count", "creator_observed_age_seconds")
