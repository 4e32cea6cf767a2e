import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import compare, metrics, profiles, splits


def test_two_way_split_by_rows(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (4, "d"), (2, "b")], "t int, k string")
    out = {r.k: r.split for r in splits.row_count_split(df, "t", "k", validation_fraction=0.5).collect()}
    assert out == {"a": "train", "b": "train", "c": "validation", "d": "validation"}
    tied = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (1, "d")], "t int, k string")
    out = {r.k: r.split for r in splits.row_count_split(tied, "t", "k", validation_fraction=0.25).collect()}
    assert out == {"a": "train", "b": "train", "c": "train", "d": "validation"}
    with pytest.raises(PySparkException):
        splits.row_count_split(tied.limit(1), "t", "k").collect()


def test_three_way_split_never_cuts_a_time(spark):
    rows = [(1, "a"), (2, "z"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "t int, k string")
        out = {r.k: r.split for r in splits.three_way_split(df, "t").collect()}
        assert out == {"a": "train", "z": "train", "b": "train", "c": "validation", "d": "test", "e": "test"} or (
            out["z"] == out["b"]
        )
        spans = {}
        for t, k in rows:
            spans.setdefault(out[k], []).append(t)
        assert max(spans["train"]) < min(spans["validation"]) <= max(spans["validation"]) < min(spans["test"])
    with pytest.raises(PySparkException):
        splits.three_way_split(spark.createDataFrame([(1, "a"), (2, "b")], "t int, k string"), "t").collect()
    with pytest.raises(ValueError):
        splits.three_way_boundaries(df, "t", validation_fraction=0.6, test_fraction=0.5)


def test_expanding_folds(spark):
    rows = [(t, i) for i, t in enumerate([1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10])]
    df = spark.createDataFrame(rows, "t int, v int")
    tagged = splits.expanding_folds(df, "t").collect()
    sizes = []
    for fold in (1, 2, 3):
        train = [r.t for r in tagged if r.fold == fold and r.part == "train"]
        validation = [r.t for r in tagged if r.fold == fold and r.part == "validation"]
        assert max(train) < min(validation)
        sizes.append(len(train))
    assert sizes == sorted(set(sizes)) and max(validation) == 10
    with pytest.raises(PySparkException):
        splits.expanding_folds(df.where("t < 4"), "t").collect()


def test_class_and_seal_checks(spark):
    df = spark.createDataFrame([("train", 1, 1), ("train", 0, 2), ("test", 1, 3)], "split string, label int, t int")
    with pytest.raises(ValueError, match="test"):
        splits.require_both_classes(df, "split")
    splits.require_both_classes(df.where("split = 'train'"), "split")
    splits.require_sealed(df, "t", 4)
    with pytest.raises(ValueError, match="1 evaluated"):
        splits.require_sealed(df, "t", 3)


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, probability double, population_weight double")


def test_weighted_precision_is_lower(spark):
    rows = [(1, 0.9, 1.0), (1, 0.6, 1.0), (0, 0.8, 25.0), (0, 0.1, 25.0)]
    r = metrics.threshold_metrics(scored(spark, rows), 0.5).first()
    assert r.precision == pytest.approx(2 / 27) and r.recall == 1.0
    nothing = metrics.threshold_metrics(scored(spark, rows), 2.0).first()
    assert (nothing.precision, nothing.recall, nothing.f1) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("buckets", [None, 8])
def test_curve_equals_recomputation(spark, buckets):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), round(rng.random(), 2), float(rng.choice([1, 25]))) for _ in range(400)]
    curve = metrics.pr_curve(scored(spark, rows), buckets=buckets)
    positives = sum(w for y, _, w in rows if y)
    ap, last, best = 0.0, 0.0, None
    for t in sorted({p for _, p, _ in rows}, reverse=True):
        tp = sum(w for y, p, w in rows if y and p >= t)
        fp = sum(w for y, p, w in rows if not y and p >= t)
        precision, recall = tp / (tp + fp), tp / positives
        ap += (recall - last) * precision
        last = recall
        f1 = 2 * precision * recall / max(precision + recall, 1e-12)
        if best is None or f1 >= best[0]:
            best = (f1, t)
    assert metrics.average_precision(curve).first()[0] == pytest.approx(ap)
    chosen = metrics.best_f1(curve).first()
    assert chosen.f1 == pytest.approx(best[0]) and chosen.threshold == best[1]
    everything = metrics.evaluate(scored(spark, rows)).first()
    assert everything.average_precision == pytest.approx(ap)


@pytest.mark.parametrize("rows_per_task,buckets", [(None, None), (40, 8)])
def test_spearman_with_ties_and_nulls(spark, rows_per_task, buckets):
    import pandas as pd

    rng = random.Random(4)
    rows = [(float(rng.choice([0, 0, 0, 1, 2, 5])), float(rng.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, 1.0), (2.0, None)], "x double, y double")
    frame = pd.DataFrame(rows, columns=["x", "y"]).rank()
    r = profiles.spearman(df, "x", "y", rows_per_task=rows_per_task, buckets=buckets).first()
    assert r.rows == 300 and r.spearman == pytest.approx(frame["x"].corr(frame["y"]))


def test_profiles_and_identity(spark):
    df = spark.createDataFrame([(0, 0.0), (0, None), (0, 4.0), (1, float("inf"))], "label int, v double")
    rows = {r.label: r for r in profiles.class_profiles(df, ["v"]).collect()}
    assert rows[0].missing_fraction == pytest.approx(1 / 3) and rows[0].zero_fraction == pytest.approx(1 / 3)
    assert rows[0].median == 2.0 and rows[1].missing_fraction == 1.0 and rows[1].median is None
    ids = spark.createDataFrame([("a", "a", 1), ("a", None, 0), ("b", "c", 0)], "s string, c string, label int")
    r = profiles.identity_audit(ids, "s", "c").first()
    assert (r.creator_nonnull_rows, r.signer_equals_creator_fraction, r.negative_creator_nonnull_rows) == (2, 0.5, 1)


def test_selection_overlap_and_side_by_side(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 25.0)], "token_address string, population_weight double")
    b = spark.createDataFrame([("y", 25.0), ("z", 1.0), ("w", 1.0)], "token_address string, population_weight double")
    r = compare.selection_overlap(a, b).first()
    assert (r.intersection_rows, r.union_rows, r.left_only_rows, r.right_only_rows, r.jaccard) == (1, 4, 1, 2, 0.25)
    one = spark.createDataFrame([(0, 1.0), (1, 2.0)], "k int, m double")
    two = spark.createDataFrame([(0, 1.5), (1, 2.0)], "k int, m double")
    rows = compare.side_by_side(one, two, ["k"], ["m"], names=("raw", "proxy")).orderBy("k").collect()
    assert [r.proxy_minus_raw_m for r in rows] == [0.5, 0.0]
    with pytest.raises(PySparkException):
        compare.side_by_side(one, two.where("k = 0"), ["k"], ["m"], names=("raw", "proxy")).collect()
    match = {r.k: r.matches for r in compare.results_match(one, two, ["k"], ["m"]).collect()}
    assert match == {0: False, 1: True}


def deltas(spark, values):
    return spark.createDataFrame([("e", i, v) for i, v in enumerate(values)], "experiment string, fold int, delta double")


@pytest.mark.parametrize(
    "values,decision",
    [
        ([0.01, 0.02], "supported_improves_all_development_checks"),
        ([0.01, -0.002], "retained_semantically_within_noninferiority_margin"),
        ([0.01, 0.0], "retained_semantically_within_noninferiority_margin"),
        ([0.01, -0.0021], "rejected_exceeds_noninferiority_margin"),
    ],
)
def test_improvement_gate(spark, values, decision):
    assert compare.improvement_gate(deltas(spark, values), ["experiment"]).first().decision == decision


def test_strict_and_noninferiority_gates(spark):
    good, bad = deltas(spark, [0.1, 0.2]), deltas(spark, [0.1, 0.0])
    assert compare.strict_improvement_gate(good, ["experiment"]).first().decision.startswith("supported")
    assert compare.strict_improvement_gate(bad, ["experiment"]).first().decision.startswith("rejected")
    assert compare.noninferiority_gate(bad, ["experiment"]).first().decision.startswith("supported")
    assert compare.noninferiority_gate(deltas(spark, [-0.01]), ["experiment"]).first().decision.startswith("rejected")


GRID = (
    "requested_delay_slots int, execution_policy string, fee_scenario string, net_mean_return double, "
    "net_median_return_unweighted double, insolvent_under_capital_model boolean"
)


def grid(spark, *rows):
    return spark.createDataFrame([(d, "all_observed_proxy", "training_median_fee", m, md, i) for d, m, md, i in rows], GRID)


def test_delay_gate(spark):
    ok = grid(spark, (0, 0.1, 0.1, False), (1, -0.1, 0.1, False), (2, 0.1, 0.1, True))
    assert compare.delay_gate(ok).first().decision.startswith("supported")
    more = grid(spark, (0, 0.1, 0.1, False), (1, 0.1, 0.1, False), (2, 0.1, 0.1, True))
    row = compare.delay_gate(more).first()
    assert row.viable_delays == "0,1" and row.decision.startswith("rejected")
    none = grid(spark, (0, 0.1, 0.0, False), (1, -0.1, 0.1, False), (2, 0.1, 0.1, True))
    assert compare.delay_gate(none).first().viable_delays == ""
    with pytest.raises(PySparkException):
        compare.delay_gate(grid(spark, (0, 0.1, 0.1, False), (1, 0.1, 0.1, False))).collect()


def test_position_gate(spark):
    assert compare.position_gate(grid(spark, (0, 0.1, 0.1, False))).first().all_checks_passed
    for row in ((0, -0.1, 0.1, False), (0, 0.1, -0.1, False), (0, 0.1, 0.1, True)):
        assert not compare.position_gate(grid(spark, row)).first().all_checks_passed
    with pytest.raises(PySparkException):
        compare.position_gate(grid(spark, (0, 0.1, 0.1, False), (0, 0.1, 0.1, False))).collect()


def comparison(spark, rows):
    return spark.createDataFrame(
        rows,
        "requested_delay_slots int, fee_scenario string, raw_net_mean_return double, proxy_net_mean_return double, "
        "raw_insolvent_under_capital_model boolean, proxy_insolvent_under_capital_model boolean, "
        "raw_max_drawdown_fraction double, proxy_max_drawdown_fraction double",
    )


def test_replica_comparison_gate(spark):
    base = [(d, "training_median_fee", 0.0, 0.1, False, False, 0.5, 0.4) for d in (0, 1, 2)]
    gate = lambda rows: compare.replica_comparison_gate(comparison(spark, rows), names=("raw", "proxy")).first()
    assert gate(base).decision.startswith("supported")
    assert gate([base[0], (1, "x", 0.1, 0.0, False, False, 0.5, 0.4), (2, "x", 0.1, 0.0, False, False, 0.5, 0.4)]).decision.startswith("rejected")
    assert gate([(0, "x", 0.0, 0.1, False, True, 0.5, 0.4), *base[1:]]).decision.startswith("rejected")
    assert gate([*base[:2], (2, "x", 0.0, 0.1, False, True, 0.5, 0.4)]).decision.startswith("rejected")
    with pytest.raises(PySparkException):
        gate(base[:2])


def test_fee_robust_gate(spark):
    names = ("gross", "training_median_fee", "training_p90_fee")
    base = [(0, n, 0.0, 0.1, False, False, 0.5, 0.4) for n in names]
    gate = lambda rows: compare.fee_robust_gate(comparison(spark, rows), names=("raw", "proxy")).first()
    assert gate(base).decision.startswith("supported")
    broken = {
        "p90_fee_positive_net_mean": (2, (0, names[2], 0.0, -0.1, False, False, 0.5, 0.4)),
        "p90_fee_solvent": (2, (0, names[2], 0.0, 0.1, False, True, 0.5, 0.4)),
        "median_fee_solvent": (1, (0, names[1], 0.0, 0.1, False, True, 0.5, 0.4)),
        "median_fee_mean_improves": (1, (0, names[1], 0.2, 0.1, False, False, 0.5, 0.4)),
        "median_fee_drawdown_improves": (1, (0, names[1], 0.0, 0.1, False, False, 0.4, 0.4)),
    }
    for check, (position, row) in broken.items():
        rows = list(base)
        rows[position] = row
        result = gate(rows)
        assert not result[check] and result.decision.startswith("rejected")
    with pytest.raises(PySparkException):
        gate(base[:2])


def test_dominance_and_ranking(spark):
    from tidemark.plans.experiments import rank_importance

    drops = spark.createDataFrame(
        [("h", 1, 0.3), ("h", 2, 0.2), ("m", 1, 0.1), ("m", 2, -0.1)], "name string, fold int, delta double"
    )
    ranked = rank_importance(drops)
    rows = {r.name: r for r in ranked.collect()}
    assert rows["h"]["rank"] == 1 and rows["m"].positive_fold_count == 1
    assert rows["h"].mean_delta == pytest.approx(0.25)
    assert compare.dominance_gate(ranked, drops, "h").first().decision == "supported_h_is_dominant"
    assert compare.dominance_gate(ranked, drops, "m").first().decision.startswith("not_supported")


def test_clock_and_profit_gates(spark):
    rows = spark.createDataFrame([(0, 0, 2), (1, 0, 0)], "label int, hour_mismatch_rows long, weekday_mismatch_rows long")
    assert compare.clock_gate(rows).first().decision == "required_integrity_fix"
    assert compare.clock_gate(rows.where("label = 1")).first().decision == "already_consistent"
    one = spark.createDataFrame([(1.0, 0.1, 0.1)], "net_pnl_usd double, net_mean_roi double, net_median_roi double")
    assert compare.profitability_gate(one).first().decision.startswith("supported")
    assert compare.profitability_gate(one.withColumn("net_median_roi", F.lit(0.0))).first().decision.startswith("rejected")
