import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.boosting import BoostingSpec, fit_boosted, fit_rows, grow_tree


def rows_of(seed=0, n=900, missing=0.15):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[rng.random((n, 3)) < missing] = np.nan
    chance = 1 / (1 + np.exp(-(2 * np.nan_to_num(x[:, 0]) + 2 * np.isnan(x[:, 1]) - 1)))
    return x, (rng.random(n) < chance).astype(np.int64)


def table_of(spark, x, y):
    data = [(f"t{i:05d}", int(y[i]), *[None if math.isnan(v) else float(v) for v in x[i]], "c") for i in range(len(y))]
    return spark.createDataFrame(data, "token_address string, label int, a double, b double, c double, probability_of string")


def first_split_by_sql(x, y, spec):
    """The best first split and both leaf values, from weighted sums over every cut in SQL."""
    import duckdb

    con = duckdb.connect()
    con.execute("create table t (y int, a double, b double, c double)")
    con.executemany("insert into t values (?, ?, ?, ?)", [[int(l), *[None if math.isnan(v) else v for v in r]] for r, l in zip(x, y)])
    parts = []
    for f in "abc":
        parts.append(
            f"""SELECT '{f}' AS f, cut, side, sum(g) FILTER (l) AS gl, sum(h) FILTER (l) AS hl, count(*) FILTER (l) AS nl,
              sum(g) FILTER (NOT l) AS gr, sum(h) FILTER (NOT l) AS hr, count(*) FILTER (NOT l) AS nr FROM (
              SELECT g, h, cut, side, coalesce({f} <= cut, side) AS l FROM s,
                (SELECT DISTINCT {f} AS cut FROM t WHERE {f} IS NOT NULL), (VALUES (false), (true)) v(side)) GROUP BY ALL"""
        )
    return con.execute(
        f"""WITH w AS (SELECT *, CASE WHEN y = 1 THEN count(*) OVER () / (2.0 * sum(y) OVER ())
            ELSE count(*) OVER () / (2.0 * (count(*) OVER () - sum(y) OVER ())) END AS w FROM t),
          s AS (SELECT *, w * (0.5 - y) AS g, w * 0.25 AS h FROM w),
          c AS ({" UNION ALL ".join(parts)})
        SELECT f, cut, side, gl * gl / (hl + {spec.l2}) + gr * gr / (hr + {spec.l2})
            - (gl + gr) * (gl + gr) / (hl + hr + {spec.l2}) AS gain,
          -{spec.learning_rate} * gl / (hl + {spec.l2}), -{spec.learning_rate} * gr / (hr + {spec.l2}), nl, nr
        FROM c WHERE nl >= {spec.min_rows_per_leaf} AND nr >= {spec.min_rows_per_leaf} ORDER BY gain DESC LIMIT 1"""
    ).fetchone()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_first_split_and_leaf_values_are_those_of_sql_sums(spark, seed):
    x, y = rows_of(seed)
    spec = BoostingSpec(rounds=1, leaves=2)
    model = fit_boosted({"m": (table_of(spark, x, y), ["a", "b", "c"])}, spec)["m"]
    tree = model.trees[0]
    f, cut, side, _, left, right, nl, nr = first_split_by_sql(x, y, spec)
    feature = "abc".index(f)
    assert tree.feature.tolist() == [feature, -1, -1] and bool(tree.missing_left[0]) == side
    below = x[:, feature][~np.isnan(x[:, feature])]
    assert below[below <= model.cuts[feature][tree.last_bin[0]]].max() == cut
    assert tree.value[1:] == pytest.approx([left, right], abs=1e-12)
    assert model.start == pytest.approx(0, abs=1e-12) and nl + nr == len(y)


def test_leaves_grow_by_gain_and_hold_enough_rows():
    x, y = rows_of(3, 2000)
    spec = BoostingSpec(rounds=4, leaves=12, min_rows_per_leaf=40)
    model = fit_rows(x, y, "abc", spec)
    bins = boosting._binned(x, model.cuts)
    for tree in model.trees:
        assert np.count_nonzero(tree.feature < 0) <= 12
        assert np.bincount(boosting._leaves(tree, bins))[tree.feature[: len(tree.feature)] < 0].min() >= 40
    # Best first: with one more leaf, all splits of the smaller tree stay.
    p = np.full(len(y), 0.5)
    small, _ = grow_tree(bins, p - y, p * (1 - p), BoostingSpec(leaves=5))
    large, _ = grow_tree(bins, p - y, p * (1 - p), BoostingSpec(leaves=6))
    kept = lambda t: {(f, b) for f, b in zip(t.feature.tolist(), t.last_bin.tolist()) if f >= 0}
    assert kept(small) <= kept(large) and len(small.feature) + 2 == len(large.feature)


def test_more_values_than_bins_are_cut_at_quantiles():
    x = np.arange(5000, dtype=float)
    cuts = boosting._cut_values(x)
    sizes = np.bincount(np.searchsorted(cuts, x, side="left"))
    assert len(sizes) == boosting.VALUE_BINS and sizes.max() - sizes.min() <= 2
    assert len(boosting._cut_values(np.array([np.nan, 3.0, 3.0]))) == 0


def test_models_of_one_job_equal_models_fitted_alone_and_repeat(spark):
    x, y = rows_of(4)
    table, spec = table_of(spark, x, y), BoostingSpec(rounds=6)
    both = fit_boosted({"wide": (table, ["a", "b", "c"]), "narrow": (table.repartition(7), ["b"])}, spec)
    alone = fit_boosted({"narrow": (table, ["b"])}, spec)["narrow"]
    values = lambda m: [t.value.tolist() for t in m.trees]
    assert values(both["narrow"]) == values(alone)
    scored = both["wide"].score(table)
    assert scored.columns == [*table.columns, "probability"]
    wanted = dict(zip([f"t{i:05d}" for i in range(len(y))], both["wide"].probabilities(x)))
    assert all(r.probability == pytest.approx(wanted[r.token_address]) for r in scored.collect())


def test_the_bound_on_fit_rows_takes_the_lowest_hashes(spark):
    x, y = rows_of(5, 1200)
    table = table_of(spark, x, y)
    spec = BoostingSpec(rounds=1, max_fit_rows=300)
    taken = boosting._fit_rows(table, "m", ["a"], spec, "token_address", "label")
    every = table.select(F.xxhash64(F.lit(spec.seed), F.col("token_address")).alias("h")).orderBy("h").limit(300)
    assert sorted(r[0] for r in taken.select("_order").collect()) == [r[0] for r in every.collect()]


def test_wrong_tables_stop_the_fit(spark):
    x, y = rows_of(6, 200)
    table = table_of(spark, x, y)
    with pytest.raises(ValueError, match="both classes"):
        fit_boosted({"m": (table.where("label = 1"), ["a"])}, BoostingSpec(rounds=1))
    with pytest.raises(ValueError, match="no training rows"):
        fit_boosted({"m": (table.where("label = 7"), ["a"])}, BoostingSpec(rounds=1))
    nulls = table.withColumn("label", F.when(F.col("token_address") < "t00150", F.col("label")))
    assert fit_boosted({"m": (nulls, ["a"])}, BoostingSpec(rounds=1))["m"].features == ("a",)


@pytest.mark.parametrize("bound", [899, 600, 450, 449])
def test_the_fit_takes_the_lowest_hashes_when_rows_are_up_to_twice_the_bound(spark, bound):
    x, y = rows_of()
    rows = table_of(spark, x, y)
    spec = BoostingSpec(max_fit_rows=bound)
    taken = boosting._fit_rows(rows, "m", ["a"], spec, "token_address", "label")
    order = F.xxhash64(F.lit(spec.seed), F.col("token_address"))
    every = sorted(r[0] for r in rows.select(order).collect())
    assert sorted(r["_order"] for r in taken.collect()) == every[:bound]


def test_a_fit_takes_every_labelled_row(spark):
    rows = spark.range(200_500).select(
        F.col("id").cast("string").alias("token_address"), F.pmod("id", F.lit(2)).alias("label"), F.col("id").alias("a")
    )
    assert boosting._fit_rows(rows, "m", ["a"], BoostingSpec(), "token_address", "label").count() == 200_500


def test_a_fit_of_many_batches_equals_one_of_all_rows(spark):
    x, y = rows_of(7, 1500)
    table, spec = table_of(spark, x, y).repartition(5), BoostingSpec(rounds=8)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        model = fit_boosted({"m": (table, ["a", "b", "c"])}, spec)["m"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    order = F.xxhash64(F.lit(spec.seed), F.col("token_address"))
    place = [int(r[0][1:]) for r in table.orderBy(order).select("token_address").collect()]
    wanted = fit_rows(x[place], y[place], ["a", "b", "c"], spec)
    assert [t.value.tolist() for t in model.trees] == [t.value.tolist() for t in wanted.trees]


def test_leaf_bits_find_the_leaves_of_the_walk():
    x, y = rows_of(9, 3000)
    model = fit_rows(x, y, "abc", BoostingSpec(rounds=5, min_rows_per_leaf=5))
    few = fit_rows(x[:60], y[:60], "abc", BoostingSpec(rounds=1))  # too few rows for a split
    x, _ = rows_of(10, 2000, missing=0.3)
    for tree, bits, cuts in [*((t, b, model.cuts) for t, b in zip(model.trees, model._bits)), (few.trees[0], few._bits[0], few.cuts)]:
        bins = boosting._binned(x, cuts)
        assert boosting._leaf_values(*bits, bins.T.astype(np.intp)).tolist() == tree.value[boosting._leaves(tree, bins)].tolist()
    assert max(len(t.feature) // 2 + 1 for t in model.trees) == 31 and len(few.trees[0].feature) == 1
