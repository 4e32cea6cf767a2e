import random

import numpy as np
import pytest

from tests.llm.helpers import no_lines, odd_lines, ordered
from tidemark.llm.hyper_minhash import REGISTERS, band_rows, components, estimate, full_set, link_lines, registers


def brute_force(rows, width, percent):
    sets = [(n, full_set((t or "").encode(), width)) for n, t in rows]
    parent = {n: n for n, _ in sets if n is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linkable = [(n, s) for n, s in sets if n is not None and s]
    for i, (n, a) in enumerate(linkable):
        for m, b in linkable[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((root(n), root(m)))
                parent[high] = low
    return ordered((n, len(s), None if n is None else root(n), n is None or root(n) == n) for n, s in sets)


def edited_lines(seed):
    rng = random.Random(seed)

    def edit(text, times):
        words = text.split()
        for _ in range(times):
            words[rng.randrange(len(words))] = f"m{rng.randrange(999)}"
        return " ".join(words)

    rows = []
    for _ in range(20):
        size = rng.choice([4, 8, 20, 60, 200, 600])
        first = current = " ".join(f"w{rng.randrange(200)}" for _ in range(size))
        for _ in range(rng.choice([1, 3, 10, 20])):
            rows.append((len(rows), current))
            current = edit(current if rng.random() < 0.6 else first, rng.choice([0, 1, 1, 2]) if size > 15 else rng.choice([0, 0, 1]))
    return rows


@pytest.mark.parametrize("width, percent, chunk", [(3, 85, 1024), (3, 85, 2), (5, 80, 3)])
def test_groups_are_those_of_brute_force(spark, width, percent, chunk):
    rows = edited_lines(width + chunk)
    n = len(rows)
    rows += [(n + i, t) for i, t in enumerate(["a", "A", "a b", "a B", "a b c", "x y z w"])] + [(0, rows[5][1]), (7, "a b c")]
    lines = odd_lines(spark, [(None if i is None else i + 100, t) for i, t in rows])
    wanted = brute_force([(r["line_number"], r["line"]) for r in lines.collect()], width, percent)
    assert ordered(link_lines(lines, shingle_words=width, similarity_percent=percent, chunk=chunk).collect()) == wanted


def test_no_lines(spark):
    assert link_lines(no_lines(spark), shingle_words=3, similarity_percent=85).count() == 0


def test_estimates_lie_around_the_true_similarity():
    rng = np.random.default_rng(8)
    for size, similarity in ((3000, 0.85), (60_000, 0.5), (60_000, 0.0)):
        shared = int(2 * size * similarity / (1 + similarity))
        errors = []
        for _ in range(12):
            values = np.unique(rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64) * np.uint64(2))
            rng.shuffle(values)
            a, b = np.sort(values[:size]), np.sort(values[size - shared : 2 * size - shared])
            sketch_a, sketch_b = (registers(x, np.array([len(x)])) for x in (a, b))
            errors.append(estimate(sketch_a, sketch_b, np.array([float(size)]), np.array([float(size)]))[0] - similarity)
        assert abs(np.mean(errors)) < 0.03


def test_bands_miss_no_pair_at_the_threshold():
    for similarity in (0.8, 0.85, 0.95):
        rows = band_rows(similarity)
        assert (1 - similarity**rows) ** (REGISTERS // rows) <= 1e-8


def test_long_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(70, 71), (71, 71)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {i: 0 for i in range(61)} | {70: 70, 71: 70}
