import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators.boosting import BoostingSpec
from tidemark.plans import experiments
from tidemark.plans.experiments import (
    attribution,
    permutation_importance,
    permute_groups,
    score_variants,
    variant_deltas,
    variant_results,
)
from tidemark.plans.models import ModelSpec, fit


def planted(spark, rows=400):
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    return spark.range(0, rows, 1, 4).select(
        F.format_string("t%05d", "id").alias("token_address"),
        F.col("id").alias("decision_time"),
        (noise > 0.5).cast("int").alias("label"),
        F.when(F.col("id") % 9 != 0, noise + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) / 50.0).alias("signal"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)) / 10.0).alias("noise"),
        F.lit(None).cast("double").alias("empty"),
    )


@pytest.mark.parametrize("spec", [ModelSpec("logistic"), ModelSpec("boosting", BoostingSpec(rounds=5, min_rows_per_leaf=5, learning_rate=0.3))])
def test_models_learn_the_signal_and_repeat_exactly(spark, spec):
    table = planted(spark)
    first = fit(table, ["signal", "noise", "empty"], spec)
    assert first.used == ("signal", "noise")
    scores = first.score(table)
    assert scores.columns == [*table.columns, "probability"]
    means = {r.label: r.p for r in scores.groupBy("label").agg(F.avg("probability").alias("p")).collect()}
    assert means[1] > means[0] + 0.2
    again = fit(table, ["signal", "noise", "empty"], spec).score(table)
    rounded = lambda df: df.select("token_address", F.round("probability", 10))
    assert rounded(scores).exceptAll(rounded(again)).count() == 0
    with pytest.raises(ValueError, match="both classes"):
        fit(table.where("label = 1"), ["signal"], spec)
    with pytest.raises(ValueError, match="forbidden"):
        fit(table, ["realized_pnl"], spec)


class SignalModel:
    features = ("count", "other")

    def score(self, df):
        return df.withColumn("probability", F.least(F.greatest(F.col("count") / 4.0, F.lit(0.01)), F.lit(0.99)))


def test_permutation_finds_the_planted_group(spark):
    df = spark.range(40).select(
        F.format_string("k%02d", "id").alias("token_address"),
        (F.col("id") >= 20).cast("int").alias("label"),
        F.when(F.col("id") >= 20, 4).otherwise(0).alias("count"),
        F.lit(0).alias("other"),
    )
    groups = {"history": ["count"], "rest": ["other"]}
    run = lambda: {r.name: r for r in permutation_importance(SignalModel(), df, groups, repeats=3).collect()}
    first = run()
    assert first == run()
    assert first["history"].pr_auc_drop_mean > 0 and first["rest"].pr_auc_drop_mean == pytest.approx(0)
    assert first["history"].baseline_pr_auc == pytest.approx(1.0) and first["history"].repeats == 3
    with pytest.raises(ValueError, match="fit"):
        permutation_importance(SignalModel(), df, {"history": ["count"]}, repeats=3)
    with pytest.raises(ValueError, match="at least one repeat"):
        permutation_importance(SignalModel(), df, groups, repeats=0)


def test_permutation_is_a_joint_bijection(spark):
    df = spark.range(50).select(F.col("id").alias("token_address"), F.col("id").alias("a"), (F.col("id") * 10).alias("b"))
    out = permute_groups(df, {"both": ["a", "b"]}, repeats=2, seed=1).collect()
    for repeat in (1, 2):
        rows = [r for r in out if r.repeat == repeat]
        assert sorted(r.a for r in rows) == list(range(50))
        assert all(r.b == r.a * 10 for r in rows)
        assert any(r.a != r.token_address for r in rows)


def test_ablation_shows_the_added_feature(spark):
    variants = {"without": ["noise"], "with": ["noise", "signal"]}
    scored = score_variants(planted(spark), variants, ModelSpec("logistic"))
    assert scored.agg(F.max("decision_time")).first()[0] < 320
    results = variant_results(scored, "signal")
    assert results.columns == ["experiment", "fold", "variant", "metric", "value"]
    rows = variant_deltas(results, "without").collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2, 3]
    assert all(r.delta > 0 for r in rows)


def test_attribution_covers_folds_groups_and_single_features(spark):
    groups = {"both": ["signal", "noise"]}
    found = attribution(planted(spark), ["signal", "noise"], groups, ModelSpec("boosting", BoostingSpec(rounds=2, min_rows_per_leaf=5)))
    rows = {(r.fold, r.family, r.name): r for r in found.collect()}
    names = [("group", "both"), ("feature", "signal"), ("feature", "noise")]
    assert set(rows) == {(fold, *name) for fold in range(4) for name in names}
    assert all(r.repeats == (5 if fold == 0 else 3) for (fold, _, _), r in rows.items())
    assert all(rows[fold, "feature", "signal"].pr_auc_drop_mean > 0 for fold in range(4))


def test_parts_measured_together_equal_each_alone(spark):
    df = spark.range(60).select(
        F.format_string("k%02d", "id").alias("token_address"),
        (F.col("id") >= 25).cast("int").alias("label"),
        F.when(F.col("id") % 7 > 2, F.col("id") % 5).alias("count"),
        (F.col("id") % 3).alias("other"),
    )
    groups = {"history": ["count"], "rest": ["other"]}
    shuffles = [
        experiments.Shuffle(df, groups, 3, 5),
        experiments.Shuffle(df.where("token_address < 'k44'"), {"both": ["other", "count"]}, 2, 6),
    ]
    together = experiments.importance_of_parts([(SignalModel(), s) for s in shuffles]).collect()
    rows = {(r.part, r.name): r.asDict() for r in together}
    assert len(rows) == len(together) == 3
    for part, s in enumerate(shuffles):
        for r in permutation_importance(SignalModel(), s.rows, s.groups, repeats=s.repeats, seed=s.seed).collect():
            assert rows[part, r.name] == {"part": part, **r.asDict()}


def test_attribution_is_ranked_and_measured_once_for_all_folds(spark, monkeypatch):
    calls = []
    for name in ("running_totals", "pr_curve"):
        kept = getattr(experiments, name)
        monkeypatch.setattr(experiments, name, lambda *a, _n=name, _f=kept, **k: calls.append(_n) or _f(*a, **k))
    spec = ModelSpec("boosting", BoostingSpec(rounds=1, min_rows_per_leaf=5))
    attribution(planted(spark), ["signal", "noise"], {"both": ["signal", "noise"]}, spec)
    assert sorted(calls) == ["pr_curve", "running_totals", "running_totals"]


@pytest.mark.parametrize("name", ["gbt_scores", "boosting_report", "ablation", "permutation_importance"])
def test_registered_queries_fit_the_whole_boosting_model(spark, sf_dir, monkeypatch, name):
    class Fitted(Exception):
        pass

    def stop(parts, spec, label="label"):
        raise Fitted(spec)

    monkeypatch.setattr("tidemark.plans.models.fit_boosted", stop)
    with pytest.raises(Fitted) as seen:
        entry.queries()[name](spark, sf_dir)
    assert seen.value.args[0] == BoostingSpec() and seen.value.args[0].rounds == 300
