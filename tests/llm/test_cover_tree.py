import numpy as np
import pandas as pd
import pytest

from tidemark.llm import cover_tree
from tidemark.llm.cover_tree import CoverTree, covering_centres, nearest_deployments, search_pair

SCHEMA = "deployment_id long, features array<double>, score string"


def brute_force(vectors, queries, k):
    out = []
    for q in queries:
        ranked = sorted((-int(vectors[q] @ v), i) for i, v in enumerate(vectors) if i != q)[:k]
        out += [(q, place + 1, i, -score) for place, (score, i) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("rows, copies", [(300, 100), (40, 0), (6, 0)])
def test_results_are_those_of_brute_force(spark, rows, copies):
    vectors = np.random.default_rng(rows).integers(-50, 50, (rows, 5))
    vectors[: copies] = vectors[0]  # ties, and one vector that a third of all rows hold
    table = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    odd = [(None, [1.0] * 5, "y"), (rows + 5, None, "z"), (rows + 6, [float("nan")] * 5, "z"), (rows + 7, [None] * 5, "z")]
    deployments = spark.createDataFrame(table + odd + table[1:2], SCHEMA).repartition(3)
    queries = deployments.where("deployment_id % 3 = 0")
    found = nearest_deployments(deployments, queries, k=10, centres=7, cell_rows=20).collect()
    found = sorted((r["query_id"], r["rank"], r["deployment_id"], r["score"]) for r in found)
    assert found == brute_force(vectors, range(0, rows, 3), 10)


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [3.0, 4.0], "x")], SCHEMA)
    assert nearest_deployments(some.limit(0), some).count() == 0
    assert nearest_deployments(some, some.limit(0)).count() == 0
    assert nearest_deployments(some.limit(1), some.limit(1)).count() == 0


@pytest.mark.parametrize("components", [2, 8, 32])
def test_nodes_are_nets_of_their_vectors(components):
    data = np.random.default_rng(5).normal(size=(2000, components))
    data[:300] = data[0]
    tree = CoverTree(data)
    for node, children in enumerate(tree.children):
        rows = data[tree.order[tree.start[node] : tree.end[node]]]
        assert np.linalg.norm(rows - data[tree.row[node]], axis=1).max() <= tree.radius[node] + 1e-9
        if not children:
            assert len(rows) <= cover_tree._LEAF or tree.radius[node] == 0
            continue
        assert tree.row[children[0]] == tree.row[node] and tree.reach[node] < tree.radius[node]
        assert tree.start[children[0]] == tree.start[node] and tree.end[children[-1]] == tree.end[node]
        assert all(tree.radius[c] <= tree.reach[node] + 1e-9 for c in children)
        centres = data[[tree.row[c] for c in children]]
        apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)[~np.eye(len(children), dtype=bool)]
        assert apart.min() >= tree.reach[node] - 1e-9
    assert sorted(tree.order.tolist()) == list(range(2000))
    centres = covering_centres(data, 50)
    assert len(np.unique(centres, axis=0)) == 50


def test_large_cells_have_branches_by_nearness(spark):
    rng = np.random.default_rng(8)
    vectors = np.concatenate([rng.integers(-5, 5, (150, 3)) + 100 * np.eye(3, dtype=int)[i] for i in range(3)])
    table = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)], SCHEMA)
    data = table.selectExpr("deployment_id", "features", "0 AS cell", "0D AS gap")
    top = vectors[:1].astype(float)
    radius = float(np.linalg.norm(vectors - top[0], axis=1).max())
    large = pd.DataFrame({"cell": [0], "n": [450], "radius": [radius]})
    rows, below = cover_tree._branches(data, top, large, 7)
    found = rows.collect()
    assert len(found) == 450 and len(below[0]) >= 3 and (below[0][0] == top[0]).all()
    for r in found:
        gaps = np.linalg.norm(below[0] - np.array(r["features"]), axis=1)
        assert gaps[r["cell"]] == pytest.approx(gaps.min()) and r["gap"] == pytest.approx(gaps.min())
    for branch in {r["cell"] for r in found}:
        assert max(r["gap"] for r in found if r["cell"] == branch) <= radius / 2
    found = nearest_deployments(table, table.where("deployment_id % 5 = 0"), k=10, centres=2, cell_rows=30).collect()
    found = sorted((r["query_id"], r["rank"], r["deployment_id"], r["score"]) for r in found)
    assert found == brute_force(vectors, range(0, 450, 5), 10)


def test_ties_with_a_negative_floor_are_kept():
    one = np.array([[-1000.0]])
    found = search_pair(one, np.array([1]), np.array([-1e6]), -one, np.array([5]), 1)
    assert found.values.tolist() == [[1, 5, -1_000_000]]


def test_no_task_holds_all_queries_of_a_cell(spark, monkeypatch):
    whole = cover_tree.search_pair

    def bounded(queries, query_ids, floor, data, ids, k):
        if len(queries) > 60:
            raise ValueError(f"{len(queries)} queries in one task")
        return whole(queries, query_ids, floor, data, ids, k)

    monkeypatch.setattr(cover_tree, "search_pair", bounded)
    vectors = np.random.default_rng(3).integers(-50, 50, (200, 5))
    vectors[:150] = vectors[0]
    table = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)], SCHEMA)
    found = nearest_deployments(table, table, k=10, centres=2, cell_rows=100, query_rows=20).collect()
    found = sorted((r["query_id"], r["rank"], r["deployment_id"], r["score"]) for r in found)
    assert found == brute_force(vectors, range(200), 10)
