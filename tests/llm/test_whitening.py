import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ordered
from tidemark.functions.transaction import transaction_features
from tidemark.llm.queries import QUERIES
from tidemark.llm.rank_one import Spectrum, add_outer
from tidemark.llm.whitening import whiten_deployments

ROWS = "token_address string, features array<double>, component string, x int"


@pytest.mark.parametrize("kind", ["plain", "flat", "copies", "corners", "one"])
def test_spectrum_is_that_of_the_scatter_matrix(kind):
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(size=(300, 12)))
    if kind == "flat":
        rows[:, 4:] = 0
        rows[:, 3] = rows[:, 2]
    if kind == "copies":
        rows = np.repeat(rows[:5], 60, axis=0)
    if kind == "corners":
        rows = np.eye(12)[rng.integers(0, 12, 300)] * 256
    if kind == "one":
        rows = rows[:1]
    left, right = Spectrum(12), Spectrum(12)
    for i, row in enumerate(rows):
        (left if i % 3 else right).add_row(row)
    left.merge(right)
    scatter = np.cov(rows.T, bias=True) * len(rows)
    scale = max(1.0, np.abs(scatter).max())
    assert left.count == len(rows) and np.allclose(left.mean, rows.mean(axis=0))
    assert np.abs(left.vectors * left.values @ left.vectors.T - scatter).max() < 1e-11 * scale
    assert np.abs(left.vectors.T @ left.vectors - np.eye(12)).max() < 1e-12


def test_equal_eigenvalues_and_parts_of_zero_are_deflated():
    values, vectors = add_outer(np.array([1.0, 1.0, 1.0, 2.0]), np.eye(4), np.array([1.0, 1.0, 0.0, 0.0]), 3.0)
    assert np.allclose(values, [1, 1, 2, 7])
    assert np.allclose(vectors * values @ vectors.T, np.diag([1, 1, 1, 2]) + 3 * np.outer([1, 1, 0, 0], [1, 1, 0, 0]))


def brute(rows, components, scale):
    """Whitened values of usable (token_address, vector) rows by a dense eigendecomposition."""
    rows = [(a, v) for a, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in rows)
    whole = [(a, [math.floor(scale * x) for x in v] + [0] * (width - len(v))) for a, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in whole}))
    n, total = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    found = {}
    for address, v in whole:
        away = [n * x - int(s) for x, s in zip(v, total)]
        for c in range(components):
            y = (np.array(away) / n) @ vectors[:, c] / math.sqrt(values[c])
            found[address, c + 1] = (n, sum(d * d for d in away), y, values[c] / values.sum())
    return found


def check(result, wanted):
    assert len(result) == len(wanted)
    signs = {}
    for r in result:
        n, deviation, whitened, explained = wanted[r["token_address"], r["component"]]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        if abs(whitened) > 1e-3:
            signs.setdefault(r["component"], np.sign(whitened * r["whitened"]))
        assert abs(r["whitened"] * signs.get(r["component"], 1) - whitened) < 1e-9
        assert abs(r["explained"] - explained) < 1e-12 and r["identity_error"] < 1e-10


def test_rows_are_those_of_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    rows = [(f"t{i}", (rng.normal(size=6) * [9, 5, 3, 2, 1, 1]).tolist()) for i in range(400)]
    rows += [("copy", rows[0][1]), ("short", [1.0, 2.0]), ("none", None), ("hole", [1.0, None]), ("inf", [math.inf] * 6)]
    rows += [("nan", [math.nan] * 6), ("empty", [])]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], ROWS).repartition(40)
    check(whiten_deployments(table).collect(), brute(rows, 4, 256.0))


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(f"t{i}", (rng.normal(size=5) * 1e9).tolist()) for i in range(60)]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], ROWS)
    check(whiten_deployments(table, components=3).collect(), brute(rows, 3, 256.0))


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], ROWS)
    assert whiten_deployments(empty).count() == 0
    assert whiten_deployments(spark.createDataFrame([("a", None, "c", 1), ("b", [], "c", 1)], ROWS)).count() == 0
    equal = whiten_deployments(spark.createDataFrame([("a", [1.0, 2.0], "c", 1)] * 3 + [(None, [1.0, 2.0], "c", 1)], ROWS)).collect()
    assert len(equal) == 8 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in equal)
    line = whiten_deployments(spark.createDataFrame([("a", [1.0, 2.0, 0.0], "c", 1), ("b", [3.0, 2.0, 0.0], "c", 1)], ROWS))
    assert ordered((r["token_address"], r["component"], r["whitened"]) for r in line.collect()) == ordered(
        [("a", 1, -1.0), ("b", 1, 1.0), *[(a, c, None) for a in "ab" for c in (2, 3)]]
    )


def test_extracted_deployment_features_are_whitened(spark):
    documents = [
        '{"slot": %d, "blockTime": 1700000000, "meta": {"fee": %d, "computeUnitsConsumed": %d, "logMessages": ["a", "b"]}}'
        % (i, 5000 + i * i % 17, 100 * i) for i in range(30)
    ]
    lines = spark.createDataFrame([(i + 1, d) for i, d in enumerate(documents)], "line_number long, value string")
    features = transaction_features(lines, json_column="value")
    numbers = [f.name for f in features.schema.fields if f.name in ("tx_fee_lamports", "compute_units", "log_message_count")]
    assert len(numbers) == 3
    table = features.select(
        F.col("line_number").cast("string").alias("token_address"),
        F.array(*[F.col(c).cast("double") for c in numbers]).alias("features"),
    )
    rows = [(r[0], list(r[1])) for r in table.collect()]
    check(whiten_deployments(table, components=2, scale=1.0).collect(), brute(rows, 2, 1.0))


def test_query_is_that_of_brute_force(spark, sf_dir):
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = QUERIES["op13_embedding_whitening"](spark, sf_dir).withColumnRenamed("vec_id", "token_address")
    check(found.collect(), brute(given, 4, 256.0))
