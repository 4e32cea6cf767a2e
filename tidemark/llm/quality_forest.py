"""Quality rules and an isolation forest over their statistics.

Rules measure each whole line. A line fails the base rules outright, or else the forest judges how easily random splits
of the statistics set it apart. Each tree is grown from its own small hash sample of lines, as the method wants; every
line is then scored by all trees. The cut between kept and rejected scores comes from labelled lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.blocks import chunks, line_rows, number_column
from tidemark.llm.sampling import lowest_ranks
from tidemark.llm.settings import tidy
from tidemark.sources.scratch import materialise

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_NOT_COUNTED = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))  # white space, and UTF-8 bytes that begin no character
_STRETCH_BYTES = 4 << 20
_STATISTICS = (
    "line_number long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_rows long, n_upper long, n_marks long, n_repeat_neighbours long"
)

# The statistics the forest splits on; all are shares or means, so that a long line is no anomaly by its length. Repeated
# windows and rows are left to the base rules: good lines hold them too, seldom, so a forest takes them for anomalies.
RULE_FEATURES = ("symbols_per_word", "marks_per_word", "upper_share", "repeat_neighbours_share")


def rule_statistics(lines: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Counts of each whole raw transaction line that quality rules are made of.

    `lines` needs line_number and line. A word is a run of bytes other than ASCII white space; a row is a part between
    line feeds. Returns one row for each row of `lines`: line_number, n_words, word_chars (characters in words),
    n_symbols (characters of #*$%&|<>), n_dup_lines (rows with a word that equal an earlier row), n_repeat_words (words in
    windows of three words that occur twice or more, the first occurrence included), n_rows, n_upper (A-Z), n_marks
    (exclamation marks), n_repeat_neighbours (words equal to the word before).

    Null and empty lines have zero counts. Null and repeated line numbers stay; extra columns are ignored, but for those
    named in `carry` (`line` may be one), which come back beside the counts.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, raw = line_rows(batch)
            for lo, hi in chunks([len(r) for r in raw], _STRETCH_BYTES):
                counts = np.array(_measure(raw[lo:hi]), np.int64).reshape(hi - lo, 9)
                own = [number_column(numbers[lo:hi]), *(pa.array(np.ascontiguousarray(c)) for c in counts.T)]
                beside = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in carry]
                yield pa.RecordBatch.from_arrays(own + beside, names=schema.names)

    others = [c for c in carry if c != "line"]
    rows = lines.select(F.col("line_number").cast("long"), F.col("line").cast("string"), *others)
    schema = T.StructType([*T.StructType.fromDDL(_STATISTICS), *(rows.schema[c] for c in carry)])
    return rows.mapInArrow(tidy(measured), schema)


def _measure(raw: list[bytes]) -> list[tuple[int, ...]]:
    codes: dict[bytes, int] = {}
    out = []
    for data in raw:
        words = data.split()
        ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
        rows = [r for r in data.split(b"\n") if r.split(None, 1)]
        out.append(
            (
                len(ids),
                len(data.translate(None, _NOT_COUNTED)),
                len(data) - len(data.translate(None, _SYMBOLS)),
                len(rows) - len(set(rows)),
                _in_repeated_windows(ids, len(codes)),
                len(rows),
                len(data) - len(data.translate(None, _UPPER)),
                data.count(b"!"),
                int((ids[1:] == ids[:-1]).sum()),
            )
        )
    return out


def _in_repeated_windows(ids: np.ndarray, n_codes: int) -> int:
    """Number of words in three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    first = ids[:-2] * n_codes + ids[1:-1]
    if n_codes >= 1 << 21:  # three ids don't fit one number then
        first = np.unique(first, return_inverse=True)[1]
    triple = first * n_codes + ids[2:]
    order = np.argsort(triple, kind="stable")
    ranked = triple[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(triple), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(triple)] |= twice
    return int(covered.sum())


def with_rule_features(statistics: DataFrame) -> DataFrame:
    """Add the forest's features: shares and means of the counts in steps of a tenth, 0 for a line without words.

    The steps keep the small differences between ordinary lines (a few more capitals, one exclamation mark) from being
    taken for anomalies: random splits fall between values that a reader would tell apart.
    """
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    shares = {
        "symbols_per_word": F.floor(F.least(10 * F.col("n_symbols") / words, F.lit(40.0))) / 10,
        "marks_per_word": F.floor(F.least(10 * F.col("n_marks") / words, F.lit(40.0))) / 10,
        "upper_share": F.floor(5 * F.col("n_upper") / chars) / 5,
        "repeat_neighbours_share": F.floor(10 * F.col("n_repeat_neighbours") / words) / 10,
    }
    return statistics.withColumns(shares)


def base_failed(min_words: int = 50, max_repeat_percent: int = 50):
    """The base rules: too few words, or too large a share of words in repeated three-word windows."""
    return (F.col("n_words") < min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words")
    )


def grow_forest(features: DataFrame, *, trees: int = 100, tree_rows: int = 256, seed: int = 11) -> pd.DataFrame:
    """Isolation trees over RULE_FEATURES as one table of nodes.

    Every row of `features` gets a hash rank; the `trees * tree_rows` lowest ranks (25,600 with the defaults, the bound of
    the sample whatever the table's size) are dealt to the trees, and Spark grows one tree per group. Nodes: tree, node,
    feature (-1 in a leaf), cut, left, right, path (depth plus the expected rest of the path in a leaf).
    """
    columns = [F.col(c).cast("double") for c in RULE_FEATURES]
    ranked = features.where(F.col("n_words") > 0).select(F.xxhash64(F.lit(seed), "line_number").alias("_rank"), *columns)
    drawn = lowest_ranks(ranked, "_rank", trees * tree_rows, RULE_FEATURES)
    # A small table has fewer rows than the trees want; each row then goes to several trees.
    uses = max(1, min(trees, trees * tree_rows // max(1, drawn.count())))
    sample = drawn.withColumn("_use", F.explode(F.sequence(F.lit(0), F.lit(uses - 1)))).withColumn(
        "tree", F.pmod(F.xxhash64(F.lit(seed + 1), "_rank") + F.col("_use"), F.lit(trees)).cast("int")
    )

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        ordered = rows.sort_values(["_rank", *RULE_FEATURES])
        return _grow_tree(tree, ordered[list(RULE_FEATURES)].to_numpy(), np.random.default_rng([seed, tree]))

    grown = sample.groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, cut double, left int, right int, path double"
    )
    return grown.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)


def _rest(n: int) -> float:
    """Expected path length of an unsuccessful search among n rows."""
    if n < 2:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def _grow_tree(tree: int, data: np.ndarray, random: np.random.Generator) -> pd.DataFrame:
    limit = math.ceil(math.log2(max(2, len(data))))
    nodes: list[list] = []
    waiting = [(np.arange(len(data)), 0, -1, "")]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][4 if side == "left" else 5] = at
        low, high = data[rows].min(axis=0), data[rows].max(axis=0)
        open_features = np.nonzero(high > low)[0]
        if depth >= limit or len(rows) < 2 or not len(open_features):
            nodes.append([tree, at, -1, 0.0, -1, -1, depth + _rest(len(rows))])
            continue
        feature = int(random.choice(open_features))
        cut = float(random.uniform(low[feature], high[feature]))
        left = data[rows, feature] < cut
        nodes.append([tree, at, feature, cut, -1, -1, 0.0])
        waiting.append((rows[~left], depth + 1, at, "right"))
        waiting.append((rows[left], depth + 1, at, "left"))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "path"])


def anomaly_scores(features: DataFrame, forest: pd.DataFrame, *, tree_rows: int = 256) -> DataFrame:
    """Add `anomaly`: 2 to the minus mean path length over its expectation; near 1 is isolated, below 0.5 ordinary.

    An empty forest (no line had a word) gives 0.
    """
    starts = forest.groupby("tree").size().cumsum().shift(fill_value=0) if len(forest) else pd.Series(dtype=int)
    base = forest["tree"].map(starts).to_numpy(np.int64) if len(forest) else np.zeros(0, np.int64)
    feature = forest["feature"].to_numpy(np.int64)
    cut, path = forest["cut"].to_numpy(float), forest["path"].to_numpy(float)
    # A leaf leads to itself, so that all trees can be walked to the same depth.
    own = np.arange(len(forest))
    left = np.where(feature < 0, own, base + forest["left"].to_numpy(np.int64))
    right = np.where(feature < 0, own, base + forest["right"].to_numpy(np.int64))
    roots = starts.to_numpy(np.int64)
    depth = math.ceil(math.log2(max(2, tree_rows))) + 2
    expected = _rest(tree_rows)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        data = np.column_stack([c.fillna(0).to_numpy(float) for c in columns])
        if not len(roots):
            return pd.Series(np.zeros(len(data)))
        total = np.zeros(len(data))
        rows = np.arange(len(data))
        for root in roots:
            at = np.full(len(data), root)
            for _ in range(depth):
                goes_left = data[rows, np.maximum(feature[at], 0)] < cut[at]
                at = np.where(goes_left, left[at], right[at])
            total += path[at]
        # Rounded, so that the order of additions can't move a line over the cut.
        return pd.Series(np.round(2.0 ** (-(total / len(roots)) / expected), 9))

    return features.withColumn("anomaly", score(*[F.col(c).cast("double") for c in RULE_FEATURES]))


def calibrate_cut(scored: DataFrame, labels: DataFrame, *, keep_share: float = 0.9995, bins: int = 10_000) -> float:
    """The lowest score from which lines are rejected so that at least `keep_share` of good labelled lines stay.

    `labels` has line_number and good (1 good, 0 bad, null unknown). All labelled lines count, as a histogram of scores.
    Among the cuts that keep enough good lines, the one with the largest gain (bad rejected share minus good rejected
    share) is taken, and of equal ones the middle. Without good and bad labels nothing is rejected: the cut is above 1.
    """
    known = labels.where(F.col("good").isNotNull()).select("line_number", "good").distinct()
    counted = (
        scored.join(known, "line_number")
        .groupBy(F.ceil(F.col("anomaly") * bins).cast("int").alias("bin"))
        .agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("bad"))
        .toPandas()
    )
    good = np.zeros(bins + 2)
    bad = np.zeros(bins + 2)
    np.add.at(good, counted["bin"].to_numpy(int), counted["good"].to_numpy(float))
    np.add.at(bad, counted["bin"].to_numpy(int), counted["bad"].to_numpy(float))
    if not good.sum() or not bad.sum():
        return 2.0
    good_out = np.cumsum(good[::-1])[::-1] / good.sum()  # rejected from this bin on
    bad_out = np.cumsum(bad[::-1])[::-1] / bad.sum()
    gain = np.where(good_out <= 1 - keep_share, bad_out - good_out, -1.0)
    best = np.nonzero(gain >= gain.max() - 1e-12)[0]
    if gain.max() <= 0:
        return 2.0
    return float(best[len(best) // 2]) / bins


def judge_lines(
    lines: DataFrame,
    labels: DataFrame,
    *,
    trees: int = 100,
    tree_rows: int = 256,
    keep_share: float = 0.9995,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    seed: int = 11,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Quality verdict of each raw transaction line.

    `lines` needs line_number and line; `labels` needs line_number and good (1, 0 or null). Returns the counts of
    rule_statistics, RULE_FEATURES, anomaly, base_failed and kept, one row for each row of `lines`. kept is false where
    base_failed, else whether the anomaly score is below the calibrated cut. The forest is grown from and calibrated on
    lines that pass the base rules.

    Null lines count as empty and fail the base rules. Null line numbers can't be labelled but are judged; repeated rows
    are judged alike. An empty table gives no rows. Labels of unknown lines and extra columns are ignored, but for those
    named in `carry`: they come back beside the verdict. The lines are then measured once more where they are read, so
    that whole lines are neither written nor joined to their verdicts.
    """
    failed = base_failed(min_words, max_repeat_percent)
    features = materialise(with_rule_features(rule_statistics(lines)).withColumn("base_failed", failed))
    judged = features.where(~F.col("base_failed"))
    forest = grow_forest(judged, trees=trees, tree_rows=tree_rows, seed=seed)
    cut = calibrate_cut(anomaly_scores(judged, forest, tree_rows=tree_rows), labels, keep_share=keep_share)
    if carry:
        features = with_rule_features(rule_statistics(lines, carry)).withColumn("base_failed", failed)
    scored = anomaly_scores(features, forest, tree_rows=tree_rows)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(cut)))
