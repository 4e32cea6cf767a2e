from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.history_queries import LABELLED_SQL, labelled
from catalog.registry import query
from catalog.wallet_queries import rounded
from tidemark.functions.derived import population_weight
from tidemark.operators import compare, metrics, profiles, splits
from tidemark.sources.scratch import materialise

D, S = b.DEPLOYMENTS_SQL, b.SCORED_SQL

_TIMES = """times AS (SELECT decision_time AS t, row_number() OVER (ORDER BY decision_time) - 1 AS i,
    count(*) OVER () AS n FROM (SELECT DISTINCT decision_time FROM deployments)),
cut AS (SELECT max(n) AS n, greatest(1, CAST(floor(max(n) * 0.6000000000000001::DOUBLE) AS BIGINT)) AS vi FROM times),
cuts AS (SELECT n, vi, greatest(vi + 1, CAST(floor(n * 0.8::DOUBLE) AS BIGINT)) AS ti FROM cut),
bounds AS (SELECT n AS distinct_times, (SELECT t FROM times WHERE i = vi) AS validation_start,
    (SELECT t FROM times WHERE i = ti) AS test_start FROM cuts)"""


@query("split_boundaries", f"WITH {D}, {_TIMES} SELECT * FROM bounds")
def split_boundaries(spark, sf_dir):
    return splits.three_way_boundaries(b.deployments(spark, sf_dir), "decision_time")


@query(
    "three_way_split",
    f"""WITH {D}, {_TIMES}, s AS (SELECT *, CASE WHEN decision_time < validation_start THEN 'train'
        WHEN decision_time < test_start THEN 'validation' ELSE 'test' END AS split FROM deployments, bounds)
    SELECT split, count(*) AS rows, min(decision_time) AS first_time, max(decision_time) AS last_time,
           count(DISTINCT label) AS classes FROM s GROUP BY split""",
)
def three_way_split(spark, sf_dir):
    tagged = splits.three_way_split(b.deployments(spark, sf_dir), "decision_time")
    return tagged.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("decision_time").alias("first_time"),
        F.max("decision_time").alias("last_time"), F.count_distinct("label").alias("classes"),
    )


def _fraction(f):
    return repr(float(f))


_F1, _F2, _F3 = 0.4, 0.4 + 1 * 0.2, 0.4 + 2 * 0.2
_FOLDS = f"""times AS (SELECT decision_time AS t, row_number() OVER (ORDER BY decision_time) - 1 AS i,
    count(*) OVER () AS n FROM (SELECT DISTINCT decision_time FROM deployments)),
starts AS (SELECT f.fold, greatest(1, CAST(floor(n * f.s) AS BIGINT)) AS si, f.e, n
    FROM (SELECT max(n) AS n FROM times), (VALUES (1, {_fraction(_F1)}::DOUBLE, {_fraction(_F1 + 0.2)}::DOUBLE),
    (2, {_fraction(_F2)}::DOUBLE, {_fraction(_F2 + 0.2)}::DOUBLE), (3, {_fraction(_F3)}::DOUBLE, NULL::DOUBLE)) f(fold, s, e)),
ends AS (SELECT *, CASE WHEN e IS NOT NULL THEN greatest(si + 1, CAST(floor(n * e) AS BIGINT)) END AS ei FROM starts),
folds AS (SELECT fold, (SELECT t FROM times WHERE i = si) AS train_end,
    CASE WHEN ei IS NOT NULL THEN (SELECT t FROM times WHERE i = ei) END AS validation_end FROM ends)"""


@query(
    "expanding_folds",
    f"""WITH {D}, {_FOLDS}, tagged AS (SELECT f.fold, d.*, CASE WHEN decision_time < train_end THEN 'train'
        WHEN validation_end IS NULL OR decision_time < validation_end THEN 'validation' END AS part
        FROM deployments d, folds f)
    SELECT fold, part, count(*) AS rows, min(decision_time) AS first_time, max(decision_time) AS last_time
    FROM tagged WHERE part IS NOT NULL GROUP BY fold, part""",
)
def expanding_folds(spark, sf_dir):
    tagged = splits.expanding_folds(b.deployments(spark, sf_dir), "decision_time")
    return tagged.groupBy("fold", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("decision_time").alias("first_time"),
        F.max("decision_time").alias("last_time"),
    )


@query(
    "row_count_split",
    f"""WITH {D}, r AS (SELECT *, row_number() OVER (ORDER BY decision_time, token_address) - 1 AS i,
        count(*) OVER () AS n FROM deployments)
    SELECT token_address, CASE WHEN i < CAST(floor(n * 0.8::DOUBLE) AS BIGINT) THEN 'train' ELSE 'validation' END AS split
    FROM r""",
)
def row_count_split(spark, sf_dir):
    return splits.row_count_split(b.deployments(spark, sf_dir), "decision_time", "token_address").select(
        "token_address", "split"
    )


CURVE_SQL = f"""{S}, g AS (SELECT probability AS threshold, sum(CASE WHEN label = 1 THEN population_weight ELSE 0 END) AS p,
    sum(CASE WHEN label = 1 THEN 0 ELSE population_weight END) AS q FROM scored GROUP BY probability),
c AS (SELECT threshold, p, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS positives FROM g
    WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT threshold, tp, fp, p / positives AS recall_gain, tp / (tp + fp) AS "precision", tp / positives AS recall FROM c),
curve AS (SELECT *, 2.0::DOUBLE * "precision" * recall / greatest("precision" + recall, 1e-12::DOUBLE) AS f1 FROM m)"""


def _curve(spark, sf_dir):
    return metrics.pr_curve(b.scored(spark, sf_dir))


@query(
    "pr_curve",
    f"""WITH {CURVE_SQL} SELECT round(threshold, 9) AS threshold, tp AS true_positive_weight, fp AS false_positive_weight,
    round(recall_gain, 9) AS recall_gain, round("precision", 9) AS "precision", round(recall, 9) AS recall,
    round(f1, 9) AS f1 FROM curve""",
)
def pr_curve(spark, sf_dir):
    return rounded(_curve(spark, sf_dir), ["threshold", "recall_gain", "precision", "recall", "f1"], 9)


@query(
    "best_f1",
    f"""WITH {CURVE_SQL} SELECT round(threshold, 9) AS threshold, round("precision", 9) AS "precision",
    round(recall, 9) AS recall, round(f1, 9) AS f1 FROM curve ORDER BY f1 DESC, threshold LIMIT 1""",
)
def best_f1(spark, sf_dir):
    return rounded(metrics.best_f1(_curve(spark, sf_dir)), ["threshold", "precision", "recall", "f1"], 9)


@query(
    "average_precision",
    f'WITH {CURVE_SQL} SELECT round(sum(recall_gain * "precision"), 9) AS average_precision FROM curve',
)
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(_curve(spark, sf_dir)), ["average_precision"], 9)


@query(
    "fixed_threshold_metrics",
    f"""WITH {S}, s AS (SELECT sum(population_weight) FILTER (WHERE probability >= 0.5 AND label = 1) AS tp,
        sum(population_weight) FILTER (WHERE probability >= 0.5 AND label = 0) AS fp,
        sum(population_weight) FILTER (WHERE probability < 0.5 AND label = 1) AS fn FROM scored)
    SELECT 0.5::DOUBLE AS threshold, round(coalesce(tp / (tp + fp), 0), 9) AS "precision",
           round(coalesce(tp / (tp + fn), 0), 9) AS recall, round(coalesce(2 * tp / (2 * tp + fp + fn), 0), 9) AS f1 FROM s""",
)
def fixed_threshold_metrics(spark, sf_dir):
    return rounded(metrics.threshold_metrics(b.scored(spark, sf_dir), 0.5), ["precision", "recall", "f1"], 9)


@query(
    "brier_prevalence",
    f"""WITH {S} SELECT round(sum(population_weight * (probability - label) * (probability - label)) / sum(population_weight), 8)
    AS brier_score, round(sum(population_weight * label) / sum(population_weight), 8) AS prevalence FROM scored""",
)
def brier_prevalence(spark, sf_dir):
    return rounded(metrics.calibration(b.scored(spark, sf_dir)), ["brier_score", "prevalence"], 8)


@query(
    "ranked_orders_curve",
    f"""WITH {D}, g AS (SELECT o_totalprice AS threshold, sum(CASE WHEN label = 1 THEN population_weight ELSE 0 END) AS p,
        sum(CASE WHEN label = 1 THEN 0 ELSE population_weight END) AS q FROM deployments GROUP BY o_totalprice),
    c AS (SELECT threshold, p, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS positives FROM g
        WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
    SELECT threshold, round(tp / (tp + fp), 9) AS "precision", round(tp / positives, 9) AS recall FROM c""",
)
def ranked_orders_curve(spark, sf_dir):
    d = b.deployments(spark, sf_dir).withColumn("population_weight", population_weight())
    curve = metrics.pr_curve(d, score="o_totalprice")
    return rounded(curve.select("threshold", "precision", "recall"), ["precision", "recall"], 9)


_PROFILED = ["creator_prior_deploy_count", "creator_prior_active_slot_count", "creator_observed_age_seconds",
             "creator_seconds_since_previous_deploy", "o_totalprice"]


def _profile_sql(f):
    q = ", ".join(f"round(quantile_cont(v, {p}), 5) AS {n}" for n, p in profiles.PROFILE_PROBS.items())
    return f"""SELECT '{f}' AS measure, label, count(*) AS rows,
        round(avg(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS missing_fraction,
        round(avg(CASE WHEN v = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS zero_fraction, {q}
        FROM (SELECT label, CAST({f} AS DOUBLE) AS v FROM labelled) GROUP BY label"""


@query("class_profiles", f"WITH {LABELLED_SQL} " + " UNION ALL ".join(_profile_sql(f) for f in _PROFILED))
def class_profiles(spark, sf_dir):
    out = profiles.class_profiles(materialise(labelled(spark, sf_dir)), _PROFILED)
    return rounded(rounded(out, list(profiles.PROFILE_PROBS), 5), ["missing_fraction", "zero_fraction"], 9)


@query(
    "identity_audit",
    """WITH t AS (SELECT o_custkey % 50 AS signer, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 50 END AS creator,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders)
    SELECT count(*) AS rows, round(count(signer) / count(*), 9) AS signer_nonnull_fraction,
           count(creator) AS creator_nonnull_rows, round(count(creator) / count(*), 9) AS creator_nonnull_fraction,
           round(count(*) FILTER (WHERE signer = creator) / count(creator), 9) AS signer_equals_creator_fraction,
           count(creator) FILTER (WHERE label = 1) AS positive_creator_nonnull_rows,
           count(creator) FILTER (WHERE label = 0) AS negative_creator_nonnull_rows FROM t""",
)
def identity_audit(spark, sf_dir):
    d = b.deployments(spark, sf_dir).select(
        (F.col("tx_signer") % 50).alias("signer"),
        F.when(F.col("token_address") % 3 != 0, F.col("token_address") % 50).alias("creator"),
        "label",
    )
    out = profiles.identity_audit(d, "signer", "creator")
    return rounded(out, ["signer_nonnull_fraction", "creator_nonnull_fraction", "signer_equals_creator_fraction"], 9)


@query(
    "spearman",
    f"""WITH {LABELLED_SQL}, v AS (SELECT CAST(o_totalprice AS DOUBLE) AS x, CAST(creator_observed_age_seconds AS DOUBLE) AS y
        FROM labelled WHERE creator_observed_age_seconds IS NOT NULL),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx,
                 rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM v)
    SELECT count(*) AS rows, round(corr(rx, ry), 8) AS spearman FROM r""",
)
def spearman(spark, sf_dir):
    rows = materialise(labelled(spark, sf_dir).select("o_totalprice", "creator_observed_age_seconds"))
    return rounded(profiles.spearman(rows, "o_totalprice", "creator_observed_age_seconds"), ["spearman"], 8)


@query(
    "selection_overlap",
    f"""WITH {D}, l AS (SELECT token_address, population_weight AS w FROM deployments WHERE o_totalprice >= 200000),
    r AS (SELECT token_address, population_weight AS w FROM deployments WHERE tx_index >= 2)
    SELECT (SELECT count(*) FROM l) AS left_rows, (SELECT sum(w) FROM l) AS left_weight,
           (SELECT count(*) FROM r) AS right_rows, (SELECT sum(w) FROM r) AS right_weight,
           count(*) FILTER (WHERE l.w IS NOT NULL AND r.w IS NOT NULL) AS intersection_rows, count(*) AS union_rows,
           count(*) FILTER (WHERE r.w IS NULL) AS left_only_rows, count(*) FILTER (WHERE l.w IS NULL) AS right_only_rows,
           count(*) FILTER (WHERE l.w IS NOT NULL AND r.w IS NOT NULL) / CAST(count(*) AS DOUBLE) AS jaccard
    FROM l FULL JOIN r USING (token_address)""",
)
def selection_overlap(spark, sf_dir):
    d = b.deployments(spark, sf_dir).withColumn("population_weight", population_weight())
    return compare.selection_overlap(d.where(F.col("o_totalprice") >= 200000), d.where(F.col("tx_index") >= 2))


# Result rows for gates: the mean order value of a class relative to all orders, per year (fold) and priority (experiment).
_DELTA_SQL = f"""{D}, means AS (SELECT o_orderpriority AS experiment, block_slot // 12 AS fold,
    avg(CASE WHEN label = 1 THEN o_totalprice END) AS a, avg(o_totalprice) AS z
    FROM deployments GROUP BY o_orderpriority, block_slot // 12),
deltas AS (SELECT experiment, fold, round(a / z - 1 + CASE experiment WHEN '1-URGENT' THEN 0.5 WHEN '2-HIGH' THEN -0.5
    WHEN '5-LOW' THEN 0.5 ELSE 0 END, 9) AS delta FROM means)"""


def _deltas(spark, sf_dir):
    shift = (
        F.when(F.col("experiment") == "1-URGENT", 0.5)
        .when(F.col("experiment") == "2-HIGH", -0.5)
        .when(F.col("experiment") == "5-LOW", 0.5)
        .otherwise(0.0)
    )
    means = (
        b.deployments(spark, sf_dir)
        .groupBy(F.col("o_orderpriority").alias("experiment"), F.floor(F.col("block_slot") / 12).alias("fold"))
        .agg(F.avg(F.when(F.col("label") == 1, F.col("o_totalprice"))).alias("a"), F.avg("o_totalprice").alias("z"))
    )
    return means.select("experiment", "fold", F.round(F.col("a") / F.col("z") - 1 + shift, 9).alias("delta"))


_IMPROVES = "'supported_improves_all_development_checks'"


@query(
    "gate_decisions",
    f"""WITH {_DELTA_SQL}, g AS (SELECT experiment, bool_and(delta > 0) AS improves_all, min(delta) AS minimum_delta
        FROM deltas GROUP BY experiment)
    SELECT experiment, improves_all, minimum_delta, CASE WHEN improves_all THEN {_IMPROVES}
        WHEN minimum_delta >= -0.002 THEN 'retained_semantically_within_noninferiority_margin'
        ELSE 'rejected_exceeds_noninferiority_margin' END AS decision FROM g""",
)
def gate_decisions(spark, sf_dir):
    return compare.improvement_gate(_deltas(spark, sf_dir), ["experiment"])


@query(
    "strict_gate_decisions",
    f"""WITH {_DELTA_SQL} SELECT experiment, CASE WHEN bool_and(delta > 0) THEN {_IMPROVES}
        ELSE 'rejected_not_consistent_across_development_checks' END AS decision FROM deltas GROUP BY experiment""",
)
def strict_gate_decisions(spark, sf_dir):
    return compare.strict_improvement_gate(_deltas(spark, sf_dir), ["experiment"])


@query(
    "noninferiority_decisions",
    f"""WITH {_DELTA_SQL} SELECT experiment, CASE WHEN min(delta) >= -0.002
        THEN 'supported_within_predeclared_noninferiority_margin'
        ELSE 'rejected_proxy_exceeds_noninferiority_margin' END AS decision FROM deltas GROUP BY experiment""",
)
def noninferiority_decisions(spark, sf_dir):
    return compare.noninferiority_gate(_deltas(spark, sf_dir), ["experiment"])


_RANKED_SQL = f"""{_DELTA_SQL}, s AS (SELECT experiment AS name, count(*) AS fold_count, round(avg(delta), 8) AS mean_delta,
    round(quantile_cont(delta, 0.5), 8) AS median_delta, min(delta) AS minimum_delta, max(delta) AS maximum_delta,
    count(*) FILTER (WHERE delta > 0) AS positive_fold_count FROM deltas GROUP BY experiment),
ranked AS (SELECT *, row_number() OVER (ORDER BY mean_delta DESC, name) AS rank FROM s)"""


def _importance(spark, sf_dir):
    from tidemark.plans.experiments import rank_importance

    return rank_importance(_deltas(spark, sf_dir).withColumnRenamed("experiment", "name"))


@query("top_features", f"WITH {_RANKED_SQL} SELECT * FROM ranked WHERE rank <= 10")
def top_features(spark, sf_dir):
    top = _importance(spark, sf_dir).orderBy("rank").limit(10)
    return rounded(top, ["mean_delta", "median_delta"], 8)


@query(
    "dominance_decision",
    f"""WITH {_RANKED_SQL}, tops AS (SELECT bool_and(experiment = '1-URGENT') AS top_in_all_folds FROM (
        SELECT *, row_number() OVER (PARTITION BY fold ORDER BY delta DESC, experiment DESC) AS rn FROM deltas) WHERE rn = 1)
    SELECT name, rank, top_in_all_folds, CASE WHEN rank = 1 AND positive_fold_count = fold_count AND top_in_all_folds
        THEN 'supported_1-URGENT_is_dominant' ELSE 'not_supported_1-URGENT_is_not_consistently_dominant' END AS decision
    FROM ranked, tops WHERE name = '1-URGENT'""",
)
def dominance_decision(spark, sf_dir):
    drops = _deltas(spark, sf_dir).withColumnRenamed("experiment", "name")
    return compare.dominance_gate(_importance(spark, sf_dir), drops, "1-URGENT")


@query(
    "results_match",
    f"""WITH {_DELTA_SQL} SELECT experiment, fold, experiment <> '2-HIGH' AS matches FROM deltas""",
)
def results_match(spark, sf_dir):
    now = _deltas(spark, sf_dir)
    frozen = now.withColumn("delta", F.when(F.col("experiment") == "2-HIGH", F.col("delta") + 1).otherwise(F.col("delta")))
    return compare.results_match(now, frozen, ["experiment", "fold"], ["delta"])
