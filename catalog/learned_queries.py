"""Backtests with learned settings, paired selections, checked joins and repeated runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.asof_queries import first_entries
from catalog.feature_queries import HISTORY, training_table
from catalog.history_queries import LABELLED_SQL, labelled
from catalog.portfolio_queries import (
    _COMPARED,
    _GRID_SELECT,
    _VIABLE,
    KEYS,
    POLICY_SQL,
    _selected,
    grid_sql,
    rounded_grid,
    selected_sql,
)
from catalog.registry import ORACLES, query
from catalog.wallet_queries import behavior_params, position_params, rounded
from tidemark.functions import derived
from tidemark.functions.guards import add_feature, numeric_features, replace_feature
from tidemark.operators import compare, joins
from tidemark.operators.quantiles import unpivot_measures
from tidemark.plans import backtest
from tidemark.plans.experiments import (
    PERMUTATION_SEED,
    permute_groups,
    score_variants,
    variant_deltas,
    variant_results,
)
from tidemark.plans.models import ModelSpec
from tidemark.sources import sinks
from tidemark.sources.scratch import materialise

PRICES = ("price_usd", "price_sol")


def _setting(spark, sf_dir):
    return backtest.learned_setting(behavior_params(spark, sf_dir), position_params(spark, sf_dir))


def _learned(sql: str) -> str:
    """The same statement with what the wallet's training events teach in place of the fixed settings."""
    for fixed, learned in ((str(b.HOLD_SECONDS), "hold"), (str(b.NOTIONAL), "notional")):
        sql = sql.replace(f" {fixed}", f" (SELECT {learned} FROM learned)")
    return sql.replace("d.tx_index + 2", "d.tx_index + (SELECT lag FROM learned)")


_LEARNED_SQL = f"""learned AS (SELECT CAST(floor(hold_median) AS BIGINT) AS hold, first_buy_notional_median AS notional,
    CAST(floor(p.median) AS BIGINT) AS lag, roundtrip_median_bps, roundtrip_p90_bps
    FROM ({ORACLES['behavior_params']}) CROSS JOIN ({ORACLES['position_params']}) p),
fees AS (SELECT 'gross' AS fee_scenario, 0.0::DOUBLE AS fee_bps
    UNION ALL SELECT 'training_median_fee', roundtrip_median_bps FROM learned
    UNION ALL SELECT 'training_p90_fee', roundtrip_p90_bps FROM learned)"""
_REPLICA_SQL = (
    f"{b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {_LEARNED_SQL}, {selected_sql('chosen', 0.5)}, {b.first_entries_sql('chosen')}, "
    + _learned(f"{b.marks_sql()}, {POLICY_SQL}, {grid_sql('policy_rows', ', '.join(KEYS))}")
)


@query("replica_learned", f"WITH {_REPLICA_SQL} SELECT {', '.join(KEYS)}, {_GRID_SELECT} FROM grid")
def replica_learned(spark, sf_dir):
    learned = _setting(spark, sf_dir)
    _, grid = backtest.replica_backtest(
        _selected(spark, sf_dir), b.trades(spark, sf_dir), learned.fees, notional=learned.notional,
        hold_seconds=learned.hold_seconds, outcome_cutoff=b.CUTOFF, order=b.ORDER, payload=PRICES,
    )
    fixed = ["fee_scenario", "fee_bps", "executed_sample_rows", "executed_population_weight", "total_weighted_notional_usd",
             "max_concurrent_weighted_positions", "initial_capital_usd", "insolvent_under_capital_model"]
    measured = [c for c in rounded_grid(grid).columns if f" AS {c}" in _GRID_SELECT]
    return rounded_grid(grid).select(*KEYS, *fixed, *[c for c in measured if c not in fixed])


# A slot lasts a month here and holds at most seven trades, so the learned lag leaves few entries; lag 2 is the fixed one.
_SELECTORS = (("raw", 0.4), ("proxy", 0.5))
_PAIR_SQL = f"""{b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {_LEARNED_SQL}, {", ".join(selected_sql(f"chosen_{n}", t) for n, t in _SELECTORS)},
{ORACLES['asof_same_slot_floor'].split("trades AS", 1)[1].split("FROM lineitem),", 1)[1].rsplit("SELECT token_address, covered", 1)[0]},
{_learned(b.marks_sql('slot_entries'))},
pair AS ({" UNION ALL ".join(f"SELECT m.*, '{n}' AS selector FROM marked m SEMI JOIN chosen_{n} USING (token_address)" for n, _ in _SELECTORS)}),
{_learned(grid_sql('pair', 'selector'))}"""


def _pair(spark, sf_dir):
    learned = _setting(spark, sf_dir)
    chosen = [F.when(F.col("probability") >= t, F.lit(n)) for n, t in _SELECTORS]
    selected = _selected(spark, sf_dir, min(t for _, t in _SELECTORS)).withColumn(
        "selectors", F.array_compact(F.array(*chosen))
    )
    _, grid = backtest.paired_position_backtest(
        selected, b.trades(spark, sf_dir), learned.fees, position_lag=2, notional=learned.notional,
        hold_seconds=learned.hold_seconds, outcome_cutoff=b.CUTOFF, order=b.ORDER, payload=PRICES,
    )
    return grid


@query("outflow_position_grid", f"WITH {_PAIR_SQL} SELECT selector, {_GRID_SELECT} FROM grid")
def outflow_position_grid(spark, sf_dir):
    return rounded_grid(_pair(spark, sf_dir))


_SIDES = f"grid r JOIN grid p USING (fee_scenario) WHERE r.selector = 'raw' AND p.selector = 'proxy'"
_PAIRED = [m for m in _COMPARED if m != "total_weighted_pnl_usd"]


@query(
    "outflow_position_comparison",
    f"""WITH {_PAIR_SQL} SELECT fee_scenario, r.insolvent_under_capital_model AS raw_insolvent_under_capital_model,
    p.insolvent_under_capital_model AS proxy_insolvent_under_capital_model, """
    + ", ".join(
        f"round(r.{m}, 4) AS raw_{m}, round(p.{m}, 4) AS proxy_{m}, round(p.{m} - r.{m}, 4) AS proxy_minus_raw_{m}"
        for m in _PAIRED
    )
    + f" FROM {_SIDES}",
)
def outflow_position_comparison(spark, sf_dir):
    both, _ = backtest.compare_positions(_pair(spark, sf_dir), names=("raw", "proxy"))
    return rounded(both, [c for c in both.columns if c.rsplit("_", 1)[0] and any(c.endswith(m) for m in _PAIRED)], 4)


@query(
    "fee_robust_decision",
    f"""WITH {_PAIR_SQL}, s AS (SELECT fee_scenario AS f, p.net_mean_return > 0 AS profit,
        NOT p.insolvent_under_capital_model AS solvent, p.net_mean_return > r.net_mean_return AS better,
        p.max_drawdown_fraction < r.max_drawdown_fraction AS calmer FROM {_SIDES}),
    c AS (SELECT bool_or(f = 'training_median_fee' AND profit) AS median_fee_positive_net_mean,
        bool_or(f = 'training_p90_fee' AND profit) AS p90_fee_positive_net_mean,
        bool_or(f = 'training_median_fee' AND solvent) AS median_fee_solvent,
        bool_or(f = 'training_p90_fee' AND solvent) AS p90_fee_solvent,
        bool_or(f = 'training_median_fee' AND better) AS median_fee_mean_improves,
        bool_or(f = 'training_median_fee' AND calmer) AS median_fee_drawdown_improves FROM s)
    SELECT *, CASE WHEN median_fee_positive_net_mean AND p90_fee_positive_net_mean AND median_fee_solvent
        AND p90_fee_solvent AND median_fee_mean_improves AND median_fee_drawdown_improves
        THEN '{compare.FEASIBLE}' ELSE '{compare.INFEASIBLE}' END AS decision FROM c""",
)
def fee_robust_decision(spark, sf_dir):
    return backtest.compare_positions(_pair(spark, sf_dir), names=("raw", "proxy"))[1]


# Joins whose cardinality is checked inside the plan.
_PER_TOKEN_SQL = "per_token AS (SELECT token_address, count(*) AS trade_rows, min(block_time) AS first_trade FROM trades GROUP BY 1)"


def _per_token(spark, sf_dir):
    trades = b.trades(spark, sf_dir)
    return trades.groupBy("token_address").agg(F.count(F.lit(1)).alias("trade_rows"), F.min("block_time").alias("first_trade"))


@query(
    "one_to_one_inner",
    f"""WITH {b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {_PER_TOKEN_SQL}
    SELECT token_address, decision_time, trade_rows, first_trade FROM deployments JOIN per_token USING (token_address)""",
)
def one_to_one_inner(spark, sf_dir):
    decided = b.deployments(spark, sf_dir).select("token_address", "decision_time")
    return joins.one_to_one(decided, _per_token(spark, sf_dir), ["token_address"])


@query(
    "one_to_one_left",
    f"""WITH {b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {_PER_TOKEN_SQL}
    SELECT token_address, decision_time, trade_rows, first_trade FROM deployments LEFT JOIN per_token USING (token_address)""",
)
def one_to_one_left(spark, sf_dir):
    decided = b.deployments(spark, sf_dir).select("token_address", "decision_time")
    return joins.one_to_one(decided, _per_token(spark, sf_dir), ["token_address"], "left")


@query(
    "selected_fan_out",
    f"""WITH {b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {b.first_entries_sql()}
    SELECT d.token_address, d.label, e.requested_delay_slots, e.covered FROM deployments d JOIN entries e USING (token_address)""",
)
def selected_fan_out(spark, sf_dir):
    entries = first_entries(spark, sf_dir).select("token_address", "requested_delay_slots", "covered")
    chosen = b.deployments(spark, sf_dir).select("token_address", "label")
    return joins.one_to_many(chosen, materialise(entries), ["token_address"], 3)


# Two runs of one result at different widths, compared by key range.
_TEXT_SQL = "concat_ws('|', token_address, tx_signer, block_slot, creator_prior_deploy_count, creator_prior_active_slot_count)"


@query(
    "repeatability",
    f"""WITH {LABELLED_SQL}, t AS (SELECT CAST(token_address AS VARCHAR) AS k, md5({_TEXT_SQL}) AS h FROM labelled)
    SELECT substr(md5(k), 1, 1) AS key_range, count(*) AS rows, count(DISTINCT k) AS unique_keys,
        CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT) AS VARCHAR) AS fingerprint, true AS repeated FROM t GROUP BY 1""",
)
def repeatability(spark, sf_dir):
    columns = ["token_address", "tx_signer", "block_slot", "creator_prior_deploy_count", "creator_prior_active_slot_count"]
    runs = [materialise(labelled(spark, sf_dir).select(*columns).repartition(width)) for width in (3, 16)]
    return sinks.compare_ranges(*runs, key="token_address")


# Features found in the table, and lists with one of them replaced or one added.
_VARIANTS = ("baseline", "replaced", "added")
_NEW = "creator_prior_deploys_per_observed_day"
_OLD = "creator_prior_deploy_count"
_NUMBERS = ["tx_index", "o_totalprice", "creator_prior_deploy_count", "creator_prior_active_slot_count",
            "creator_observed_age_seconds", "creator_seconds_since_previous_deploy"]


def _with_rate(spark, sf_dir):
    return derived.add_deployment_rate(labelled(spark, sf_dir).drop("block_time"))


def _variants(table):
    found = [f for f in numeric_features(table) if f not in ("population_weight", _NEW)]
    return {"baseline": found, "replaced": replace_feature(found, _OLD, _NEW), "added": add_feature(found, _NEW)}


def _variant_sql(name):
    features = [_NEW if f == _OLD and name == "replaced" else f for f in _NUMBERS] + [_NEW] * (name == "added")
    return " UNION ALL ".join(
        f"SELECT '{name}' AS variant, '{f}' AS feature, count({f}) AS non_null_rows, round(min({f}), 6)::DOUBLE AS minimum, "
        f"round(max({f}), 6)::DOUBLE AS maximum FROM rated"
        for f in features
    )


@query(
    "feature_variants",
    f"""WITH {LABELLED_SQL}, rated AS (SELECT *, CASE WHEN creator_prior_deploy_count = 0 THEN 0.0::DOUBLE
        ELSE creator_prior_deploy_count / greatest(coalesce(creator_observed_age_seconds, 0) / 86400.0::DOUBLE, 1.0::DOUBLE)
        END AS {_NEW} FROM labelled) {" UNION ALL ".join(_variant_sql(v) for v in _VARIANTS)}""",
)
def feature_variants(spark, sf_dir):
    table = materialise(_with_rate(spark, sf_dir))
    variants = _variants(table)
    every = sorted({f for names in variants.values() for f in names})
    measured = unpivot_measures(table, [], every).groupBy(F.col("measure").alias("feature")).agg(
        F.count("value").alias("non_null_rows"),
        F.round(F.min("value"), 6).alias("minimum"),
        F.round(F.max("value"), 6).alias("maximum"),
    )
    lists = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(f).alias("feature")) for v, n in variants.items() for f in n]))
    names = spark.range(1).select(lists.alias("v")).select("v.*")
    return names.join(measured, "feature").select("variant", "feature", "non_null_rows", "minimum", "maximum")


@query("replace_add_experiment")
def replace_add_experiment(spark, sf_dir):
    table = materialise(_with_rate(spark, sf_dir))
    scored = materialise(score_variants(table, _variants(table), ModelSpec("boosting")))
    deltas = materialise(variant_deltas(variant_results(scored, "prior_rate"), "baseline"))
    return deltas.join(compare.improvement_gate(deltas, ["experiment", "variant"]), ["experiment", "variant"])


# What each development fold holds; the models' metrics rest on these rows.
@query(
    "development_folds",
    f"""WITH {LABELLED_SQL}, times AS (SELECT DISTINCT decision_time AS t FROM labelled),
    cuts AS (SELECT list(t ORDER BY t) AS ts, count(*) AS n FROM times),
    outer_cuts AS (SELECT ts, n, greatest(1, CAST(floor(n * (1 - 0.2 - 0.2)) AS BIGINT)) AS i,
        greatest(greatest(1, CAST(floor(n * (1 - 0.2 - 0.2)) AS BIGINT)) + 1, CAST(floor(n * (1 - 0.2)) AS BIGINT)) AS j FROM cuts),
    pre AS (SELECT list_slice(ts, 1, j) AS ts, j AS n, ts[i + 1] AS vs, ts[j + 1] AS te FROM outer_cuts),
    folds AS (SELECT 0 AS fold, vs AS train_end, te AS stop FROM pre UNION ALL
      SELECT k, ts[greatest(1, CAST(floor(n * (0.4 + (k - 1) * 0.2)) AS BIGINT)) + 1],
        CASE WHEN k < 3 THEN ts[greatest(greatest(1, CAST(floor(n * (0.4 + (k - 1) * 0.2)) AS BIGINT)) + 1,
          CAST(floor(n * (0.4 + (k - 1) * 0.2 + 0.2)) AS BIGINT)) + 1] ELSE te END FROM pre, range(1, 4) r(k))
    SELECT fold, count(*) FILTER (WHERE decision_time < train_end) AS train_rows,
      count(*) FILTER (WHERE decision_time < train_end AND label = 1) AS train_positives,
      count(*) FILTER (WHERE decision_time >= train_end) AS validation_rows,
      max(decision_time) FILTER (WHERE decision_time < train_end) AS last_train_time,
      min(decision_time) FILTER (WHERE decision_time >= train_end) AS first_validation_time,
      max(decision_time) FILTER (WHERE decision_time >= train_end) AS last_validation_time,
      round(sum(CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE decision_time >= train_end)
        / sum(CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 25 END) FILTER (WHERE decision_time >= train_end), 9) AS prevalence
    FROM folds JOIN labelled ON decision_time < stop GROUP BY fold""",
)
def development_folds(spark, sf_dir):
    from tidemark.plans.experiments import fold_contents

    return rounded(fold_contents(training_table(spark, sf_dir)), ["prevalence"], 9)


# Shuffled groups must hold the values they had: each repeat moves the rows of a group by a bijection.
_MOVED = {"creator_history": HISTORY, "value": ["o_totalprice"], "structure": ["tx_index"]}
_MOVED_COLUMNS = [c for members in _MOVED.values() for c in members]


@query(
    "permutation_proof",
    f"""WITH {LABELLED_SQL} SELECT name, repeat, count(*) AS rows, count(DISTINCT token_address) AS receivers, """
    + ", ".join(
        f"count({c}) AS {c}_present, round(sum({c})::DOUBLE, 2) AS {c}_sum, round(sum({c}::DOUBLE * {c}::DOUBLE), 0) AS {c}_squares"
        for c in _MOVED_COLUMNS
    )
    + """ FROM labelled CROSS JOIN (VALUES ('creator_history'), ('value'), ('structure')) n(name)
    CROSS JOIN (VALUES (1), (2)) r(repeat) GROUP BY ALL""",
)
def permutation_proof(spark, sf_dir):
    rows = training_table(spark, sf_dir).select("token_address", *_MOVED_COLUMNS)
    exact = lambda x: F.sum(x.cast("decimal(38,6)")).cast("double")
    moved = permute_groups(rows, _MOVED, repeats=2, seed=PERMUTATION_SEED)
    sums = moved.groupBy("name", "repeat").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"{c}_present") for c in _MOVED_COLUMNS],
        *[F.round(exact(F.col(c)), 2).alias(f"{c}_sum") for c in _MOVED_COLUMNS],
        *[F.round(exact(F.col(c).cast("double") * F.col(c)), 0).alias(f"{c}_squares") for c in _MOVED_COLUMNS],
    )
    # Counted on the key columns alone: beside the sums, every distinct receiver would hold a set of them in memory.
    receivers = (
        moved.select("name", "repeat", "token_address")
        .distinct()
        .groupBy("name", "repeat")
        .agg(F.count("token_address").alias("receivers"))
    )
    measured = [f"{c}_{m}" for m in ("present", "sum", "squares") for c in _MOVED_COLUMNS]
    return sums.join(receivers, ["name", "repeat"]).select("name", "repeat", "rows", "receivers", *measured)
