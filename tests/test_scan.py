import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles, finite_summary
from tidemark.operators import sizing
from tidemark.operators.scan import running_totals, select_ranks, with_buckets
from tidemark.operators.sizing import buckets_for, placed


@pytest.mark.parametrize("buckets", [None, 4, 32])
def test_running_totals_equal_cumulative_sums(spark, buckets):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(-5, 9)) for k in ("a", "b") for i in rng.sample(range(1000), 150)]
    df = spark.createDataFrame(rows, "k string, o int, x long")
    out = running_totals(df, order=["o"], sums={"total": "x"}, keys=["k"], buckets=buckets).collect()
    assert len(out) == 300
    for r in out:
        assert r.total == sum(x for k, o, x in rows if k == r.k and o <= r.o)


def spans_of(out):
    spans = out.groupBy("_bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    return spans.orderBy("_bucket").collect()


@pytest.mark.parametrize("rows_per_part", [1_000_000, 300])
def test_buckets_follow_the_order_and_are_of_one_size(spark, monkeypatch, rows_per_part):
    monkeypatch.setattr(sizing, "ROWS_PER_PART", rows_per_part)
    df = spark.range(0, 2000).select((F.col("id") * 17 % 2003).alias("v"), F.col("id"))
    rows = spans_of(with_buckets(df, ["v"], buckets=16))
    assert len(rows) >= 16 and max(r.n for r in rows) <= 125
    assert all(a.hi < b.lo for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("buckets", [64, 8192, 65536])
def test_many_buckets_give_the_totals_of_few(spark, buckets):
    df = spark.range(0, 200_000).select((F.col("id") * 7919 % 200_003).alias("v"), (F.col("id") % 5).alias("x"))
    out = running_totals(df, order=["v"], sums={"total": "x"}, buckets=buckets)
    found = out.agg(F.sum("total").alias("s"), F.max("total").alias("m"), F.count("total").alias("n")).first()
    rows = sorted((i * 7919 % 200_003, i % 5) for i in range(200_000))
    totals = np.cumsum([x for _, x in rows])
    assert (found.s, found.m, found.n) == (int(totals.sum()), int(totals[-1]), 200_000)


def test_the_bucket_step_carries_no_bounds_and_no_top_rows(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("v"), F.lit(1).cast("long").alias("x"))
    plan = running_totals(df, order=["v"], sums={"t": "x"}, buckets=32)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "TakeOrdered" not in plan


def test_one_repeated_order_value_does_not_spoil_the_bounds(spark):
    hot = spark.range(0, 3000).select(F.col("id").alias("k"), F.lit(50).alias("v"))
    rest = spark.range(0, 1000).select((F.col("id") + 5000).alias("k"), F.col("id").cast("int").alias("v"))
    out = with_buckets(hot.unionAll(rest), ["v"], buckets=16).where("k >= 5000")
    assert out.select("_bucket").distinct().count() >= 3


@pytest.mark.parametrize("buckets", [None, 8])
def test_quantiles_match_numpy(spark, buckets):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=301), "b": np.repeat([0.0, 1.0, 7.0], [500, 3, 1])}
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    out = {r.k: r for r in exact_quantiles(df, value="v", probs=probs, keys=["k"], buckets=buckets).collect()}
    assert set(out) == {"a", "b"}
    for k, values in data.items():
        assert out[k].value_rows == len(values)
        for name, p in probs.items():
            assert out[k][name] == pytest.approx(np.quantile(values, p), abs=1e-12)


@pytest.mark.parametrize("buckets", [None, 8])
def test_select_ranks_over_composite_order(spark, buckets):
    rows = [(t, f"k{i:03d}") for i in range(200) for t in ([3] if i % 3 else [i % 7])]
    df = spark.createDataFrame(rows, "t int, k string")
    out = select_ranks(
        df, value=["t", "k"], targets={"x": lambda n: F.floor(n * 0.7).cast("long"), "y": lambda n: n + 5},
        buckets=buckets,
    ).first()
    assert tuple(out.x) == sorted(rows)[140]
    assert out.y is None and out._total == 200


def test_finite_summary_of_nothing_is_zero_and_null(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 3.0)], "a double, b double")
    out = {r.measure: r for r in finite_summary(df, ["a", "b"]).collect()}
    assert out["a"]["count"] == 0 and out["a"]["mean"] is None and out["a"]["median"] is None
    assert (out["b"]["count"], out["b"]["mean"], out["b"]["median"]) == (2, 2.0, 2.0)


def test_buckets_follow_measured_rows(spark, monkeypatch):
    monkeypatch.setattr("tidemark.operators.sizing.ROWS_PER_BUCKET", 10)
    assert [buckets_for(n) for n in (0, 1, 10, 11, 20, 21, 81)] == [1, 1, 1, 2, 2, 4, 16]
    df, buckets = placed(spark.range(35))
    assert (df.count(), buckets) == (35, 4)
    with pytest.raises(ValueError):
        placed(spark.range(3), 3)


def test_quantiles_of_nothing_have_one_row_without_keys(spark):
    df = spark.createDataFrame([], "k int, v double")
    assert [tuple(r) for r in exact_quantiles(df, value="v", probs={"m": 0.5}).collect()] == [(0, None)]
    assert exact_quantiles(df, value="v", probs={"m": 0.5}, keys=["k"]).count() == 0


@pytest.mark.parametrize("rows_per_bucket", [20, 300])
def test_quantiles_do_not_depend_on_the_buckets(spark, monkeypatch, rows_per_bucket):
    values = [((i * 7919) % 2001) / 7 for i in range(2001)] + [1.5] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = {f"p{i}": i / 20 for i in range(21)}
    expected = exact_quantiles(df, value="v", probs=probs).first()
    monkeypatch.setattr("tidemark.operators.sizing.ROWS_PER_BUCKET", rows_per_bucket)
    assert exact_quantiles(df, value="v", probs=probs).first() == expected
    assert expected.p10 == sorted(values)[1150]
