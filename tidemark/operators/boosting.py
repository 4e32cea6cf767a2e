"""Gradient-boosted trees on binned features, grown leaf by leaf, fitted side by side in Spark tasks.

A fit sees all labelled rows. One task holds them as bins, a byte for each value, and about a hundred bytes a row while it
fits; many fits (folds and feature variants) run as groups of one job. Scores are computed over all rows, in Arrow batches.
Missing values have a bin of their own and go to the side of a split where they fit better.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.guards import require_pre_decision_names
from tidemark.sources.scratch import materialise

# The settings that results are compared under.
ROUNDS = 300
LEARNING_RATE = 0.05
LEAVES = 31
MIN_ROWS_PER_LEAF = 50
L2 = 0.1
MIN_HESSIAN = 1e-3
VALUE_BINS = 255
_MISSING = VALUE_BINS  # the last of 256 bins
_BINS = VALUE_BINS + 1
_MASK_LEAVES = 64  # leaves that fit the bits of a mask


@dataclass(frozen=True)
class BoostingSpec:
    """What to fit. A fit takes all labelled rows; only a caller that sets ``max_fit_rows`` gets a cut by hash."""

    rounds: int = ROUNDS
    learning_rate: float = LEARNING_RATE
    leaves: int = LEAVES
    min_rows_per_leaf: int = MIN_ROWS_PER_LEAF
    l2: float = L2
    max_fit_rows: int | None = None
    seed: int = 20260801


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays; a leaf has feature -1. Bins up to ``last_bin`` go left, missing values where ``missing_left`` says."""

    feature: np.ndarray
    last_bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class BoostedModel:
    """Cut values of each feature, the starting log odds, and the trees."""

    features: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    start: float
    trees: tuple[Tree, ...]

    @property
    def used(self) -> tuple[str, ...]:
        """Features with at least two values in training."""
        return tuple(f for f, cut in zip(self.features, self.cuts) if len(cut))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        bins = _binned(x, self.cuts)
        raw = np.full(len(x), self.start)
        columns = bins.T.astype(np.intp)
        for tree, bits in zip(self.trees, self._bits):
            raw += tree.value[_leaves(tree, bins)] if bits is None else _leaf_values(*bits, columns)
        return 1 / (1 + np.exp(-raw))

    @cached_property
    def _bits(self) -> list[tuple[np.ndarray, dict[int, np.ndarray]] | None]:
        return [_leaf_bits(tree) if len(tree.feature) < 2 * _MASK_LEAVES else None for tree in self.trees]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` of the positive class; a null feature is a missing value."""

        def scored(columns: pd.DataFrame) -> pd.Series:
            return pd.Series(self.probabilities(columns.to_numpy(np.float64, na_value=np.nan)))

        values = F.struct(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(self.features)])
        return df.select("*", F.pandas_udf(scored, "double")(values).alias("probability"))


def fit_boosted(
    parts: Mapping[str, tuple[DataFrame, Sequence[str]]], spec: BoostingSpec, *, key: str = "token_address",
    label: str = "label",
) -> dict[str, BoostedModel]:
    """One model for each named (training rows, features), all in one job with a task for each model.

    A model takes all rows that have a label, in the order of a seeded hash of ``key``; classes are weighted to equal sums.
    The returned models hold only cut values and trees.
    """
    for _, features in parts.values():
        require_pre_decision_names(features)
    wide = [_fit_rows(rows, name, features, spec, key, label) for name, (rows, features) in parts.items()]
    table = materialise(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), wide))
    columns = {name: tuple(features) for name, (_, features) in parts.items()}
    counts = {r["_model"]: r["count"] for r in table.groupBy("_model").count().collect()}  # one row for each model
    fitted = table.groupBy("_model").applyInPandas(
        _fit_group(columns, counts, spec), "_model string, fitted binary, problem string"
    )
    found = {}
    for row in fitted.collect():  # one row for each model, whose size the spec bounds
        if row["problem"]:
            raise ValueError(f"{row['_model']}: {row['problem']}")
        found[row["_model"]] = pickle.loads(row["fitted"])
    missing = sorted(set(parts) - set(found))
    if missing:
        raise ValueError(f"no training rows for {missing}")
    return {name: found[name] for name in parts}


def _fit_rows(
    rows: DataFrame, name: str, features: Sequence[str], spec: BoostingSpec, key: str, label: str
) -> DataFrame:
    """The labelled rows of one fit; those of the lowest hashes if the caller set ``max_fit_rows``."""
    order = F.xxhash64(F.lit(spec.seed), F.col(key))
    out = rows.where(F.col(label).isNotNull()).select(
        F.lit(name).alias("_model"),
        order.alias("_order"),
        F.col(label).cast("int").alias("_label"),
        *[F.col(c).cast("double").alias(c) for c in features],
    )
    if spec.max_fit_rows is None or (count := out.count()) <= spec.max_fit_rows:
        return out
    # Rows far above the expected cut go first, so that only about twice the sample is put in order.
    # Whole numbers: as a double, the share of all hashes rounds to one beyond the largest long.
    cut = -(1 << 63) + min((1 << 64) - 1, (2 * spec.max_fit_rows << 64) // count)
    return out.where(F.col("_order") <= F.lit(cut)).orderBy("_order").limit(spec.max_fit_rows)


def _fit_group(
    columns: Mapping[str, tuple[str, ...]], counts: Mapping[str, int], spec: BoostingSpec
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, at = "", 0
        for rows in batches:
            if not at:
                name = rows["_model"].iloc[0]
                features, size = columns[name], counts[name]
                # Filled batch by batch, so that the task never holds the values of all rows twice.
                x, y, order = np.empty((size, len(features)), order="F"), np.empty(size, np.int64), np.empty(size, np.int64)
            here = slice(at, at + len(rows))
            for i, feature in enumerate(features):
                x[here, i] = rows[feature].to_numpy(np.float64, na_value=np.nan)
            y[here], order[here] = rows["_label"], rows["_order"]
            at += len(rows)
        place = np.lexsort([*x.T[::-1], y, order])  # sums don't depend on the shuffle
        del order
        y = y[place]
        for i in range(len(features)):
            x[:, i] = x[place, i]
        del place
        problem = "training rows must contain both classes" if len(np.unique(y)) < 2 else None
        if problem is None:
            cuts = tuple(_cut_values(column) for column in x.T)
            bins = _binned(x, cuts)
            del x
            model = pickle.dumps(_boosted(bins, y, features, cuts, spec))
        yield pd.DataFrame([(name, None if problem else model, problem)], columns=["_model", "fitted", "problem"])

    return fitted


def fit_rows(x: np.ndarray, y: np.ndarray, features: Sequence[str], spec: BoostingSpec) -> BoostedModel:
    """Boosting of the log loss with class-balanced weights."""
    cuts = tuple(_cut_values(x[:, i]) for i in range(x.shape[1]))
    return _boosted(_binned(x, cuts), y, features, cuts, spec)


def _boosted(
    bins: np.ndarray, y: np.ndarray, features: Sequence[str], cuts: tuple[np.ndarray, ...], spec: BoostingSpec
) -> BoostedModel:
    positive = (y == 1).astype(np.float64)
    weight = np.where(positive == 1, len(y) / (2 * positive.sum()), len(y) / (2 * (len(y) - positive.sum())))
    start = float(np.log((weight * positive).sum() / (weight * (1 - positive)).sum()))
    raw = np.full(len(y), start)
    trees = []
    for _ in range(spec.rounds):
        p = 1 / (1 + np.exp(-raw))
        tree, leaf = grow_tree(bins, weight * (p - positive), weight * p * (1 - p), spec)
        raw += tree.value[leaf]
        trees.append(tree)
    return BoostedModel(tuple(features), cuts, start, tuple(trees))


def _cut_values(x: np.ndarray) -> np.ndarray:
    """Cuts between the values if they fit the bins, else at even quantiles; missing values take no part."""
    values = np.unique(x[~np.isnan(x)])
    if len(values) > VALUE_BINS:
        shares = np.linspace(0, 100, VALUE_BINS + 1)[1:-1]
        return np.unique(np.percentile(x[~np.isnan(x)], shares, method="midpoint"))
    return values[:-1] + (values[1:] - values[:-1]) / 2


def _binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of cuts below it; missing values have the last bin."""
    out = np.empty(x.shape, np.uint8, order="F")  # sums go by feature
    for i, cut in enumerate(cuts):
        out[:, i] = np.where(np.isnan(x[:, i]), _MISSING, np.searchsorted(cut, x[:, i], side="left"))
    return out


def _leaves(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """Leaf of each row."""
    node = np.zeros(len(bins), np.int32)
    rows = np.flatnonzero(tree.feature[node] >= 0)
    while len(rows):
        at = node[rows]
        b = bins[rows, tree.feature[at]]
        left = np.where(b == _MISSING, tree.missing_left[at], b <= tree.last_bin[at])
        node[rows] = np.where(left, tree.left[at], tree.right[at])
        rows = rows[tree.feature[node[rows]] >= 0]
    return node


def _leaf_values(values: np.ndarray, masks: Mapping[int, np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Value of each row's leaf, from bins by feature and ``_leaf_bits``: the leaf of the lowest bit that no feature takes."""
    kept = np.full(columns.shape[1], (1 << 64) - 1, np.uint64)
    for feature, mask in masks.items():
        kept &= mask.take(columns[feature])
    return values.take(np.bitwise_count((kept & (~kept + np.uint64(1))) - np.uint64(1)))


def _leaf_bits(tree: Tree) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Values of the leaves from left to right, and the leaves' bits that each bin of a feature keeps.

    A bin that goes right at a node takes the bits of the leaves on its left.
    """
    order: list[int] = []
    masks: dict[int, np.ndarray] = {}

    def visit(node: int) -> None:
        feature = int(tree.feature[node])
        if feature < 0:
            order.append(node)
            return
        first = len(order)
        visit(int(tree.left[node]))
        lost = np.uint64((1 << len(order)) - (1 << first))
        goes_right = np.arange(_BINS) > tree.last_bin[node]
        goes_right[_MISSING] = not tree.missing_left[node]
        mask = masks.setdefault(feature, np.full(_BINS, (1 << 64) - 1, np.uint64))
        mask[goes_right] &= ~lost
        visit(int(tree.right[node]))

    visit(0)
    return tree.value[order], masks


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    last_bin: int
    missing_left: bool


def grow_tree(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, spec: BoostingSpec) -> tuple[Tree, np.ndarray]:
    """One tree, always splitting the leaf of the largest gain, and the leaf of each row."""
    width = bins.shape[1]
    # A feature with one bin has no split; the first one gives a node's own sums.
    summed_features = [i for i in range(width) if i == 0 or bins[:, i].min() < bins[:, i].max()] if len(bins) else []
    nodes: list[list] = []  # feature, last bin, missing left, left, right, value
    rows_of: dict[int, np.ndarray] = {}
    sums_of: dict[int, np.ndarray] = {}
    open_leaves: list[tuple[float, int, Split]] = []

    def leaf(rows: np.ndarray, sums: np.ndarray) -> int:
        number = len(nodes)
        g, h = sums[0, :_BINS].sum(), sums[1, :_BINS].sum()
        nodes.append([-1, 0, False, -1, -1, -spec.learning_rate * g / (h + spec.l2)])
        rows_of[number], sums_of[number] = rows, sums
        split = best_split(sums.reshape(3, width, _BINS), spec)
        if split is not None:
            heapq.heappush(open_leaves, (-split.gain, number, split))
        return number

    def summed(rows: np.ndarray) -> np.ndarray:
        g, h, out = gradient[rows], hessian[rows], np.zeros((3, width, _BINS))
        for i in summed_features:
            bin = bins[rows, i].astype(np.intp)
            out[0, i], out[1, i], out[2, i] = np.bincount(bin, g, _BINS), np.bincount(bin, h, _BINS), np.bincount(bin, minlength=_BINS)
        return out.reshape(3, -1)

    everything = np.arange(len(bins))
    leaf(everything, summed(everything))
    leaves = 1
    while open_leaves and leaves < spec.leaves:
        _, number, split = heapq.heappop(open_leaves)
        rows, sums = rows_of.pop(number), sums_of.pop(number)
        b = bins[rows, split.feature]
        goes_left = np.where(b == _MISSING, split.missing_left, b <= split.last_bin)
        left, right = rows[goes_left], rows[~goes_left]
        # The sums of the larger side are those of both minus those of the smaller one.
        small = summed(left if len(left) <= len(right) else right)
        both = (small, sums - small) if len(left) <= len(right) else (sums - small, small)
        children = leaf(left, both[0]), leaf(right, both[1])
        nodes[number] = [split.feature, split.last_bin, split.missing_left, *children, 0.0]
        leaves += 1
    columns = list(zip(*nodes))
    kinds = (np.int16, np.int16, bool, np.int32, np.int32, np.float64)
    place = np.empty(len(bins), np.int32)
    for number, rows in rows_of.items():
        place[rows] = number
    return Tree(*[np.array(c, k) for c, k in zip(columns, kinds)]), place


def best_split(sums: np.ndarray, spec: BoostingSpec) -> Split | None:
    """The split of the largest gain from sums of gradient, hessian and rows by feature and bin; None if none gains."""
    whole, hole = sums.sum(axis=2), sums[:, :, _MISSING]
    below = np.cumsum(sums[:, :, :VALUE_BINS], axis=2)
    best = None
    for missing_left in (False, True) if hole[2].any() else (False,):
        left = below + hole[:, :, None] if missing_left else below
        right = whole[:, :, None] - left
        allowed = (left[2] >= spec.min_rows_per_leaf) & (right[2] >= spec.min_rows_per_leaf)
        allowed &= (left[1] >= MIN_HESSIAN) & (right[1] >= MIN_HESSIAN)
        parts = left[0] ** 2 / (left[1] + spec.l2) + right[0] ** 2 / (right[1] + spec.l2)
        gain = np.where(allowed, parts - (whole[0] ** 2 / (whole[1] + spec.l2))[:, None], -np.inf)
        at = int(gain.argmax())
        found = float(gain.ravel()[at])
        if found > 0 and (best is None or found > best.gain):
            feature, last_bin = divmod(at, VALUE_BINS)
            # Where training has no missing value, a later one follows the larger side.
            side = missing_left if hole[2, feature] else bool(left[2, feature, last_bin] >= right[2, feature, last_bin])
            best = Split(found, feature, last_bin, side)
    return best
