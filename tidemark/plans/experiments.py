"""Feature experiments over chronological folds and permutation importance.

Fits are iterative and driven from the driver. Everything measured afterwards is one plan: the scores of all folds
and variants are stacked with key columns and evaluated together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.derived import population_weight
from tidemark.functions.guards import require_feature_groups
from tidemark.operators.compare import fold_summary
from tidemark.operators.joins import in_window
from tidemark.operators.metrics import (
    average_precision,
    best_f1,
    calibration,
    evaluate,
    pr_curve,
    threshold_metrics,
)
from tidemark.operators.scan import running_totals
from tidemark.operators.splits import (
    fold_boundaries,
    require_both_classes,
    three_way_boundaries,
    three_way_split,
)
from tidemark.plans.models import Model, ModelSpec, fit, fit_all
from tidemark.sources.scratch import materialise

STANDARD_FOLD = 0
PERMUTATION_SEED = 20260802
FOLD_REPEATS = 3
STANDARD_REPEATS = 5


def development_parts(
    dataset: DataFrame, *, time: str = "decision_time", label: str = "label"
) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Training and validation rows of the standard split (fold 0) and the expanding folds (1..n).

    Folds are built on training and validation rows only, so the final test part stays sealed.
    """
    # Cut points are a handful of values; every part is then a pair of predicates on the same table.
    outer = three_way_boundaries(dataset, time).first()
    at, validation_start, test_start = F.col(time), outer["validation_start"], outer["test_start"]
    pretest = dataset.where(at < F.lit(test_start))
    require_both_classes(
        dataset.withColumn(
            "split",
            F.when(at < F.lit(validation_start), "train")
            .when(at < F.lit(test_start), "validation")
            .otherwise("test"),
        ),
        "split",
        label,
    )
    parts = {
        STANDARD_FOLD: (
            pretest.where(at < F.lit(validation_start)), pretest.where(at >= F.lit(validation_start))
        )
    }
    for cut in fold_boundaries(pretest, time).collect():
        later = pretest.where(at >= F.lit(cut["train_end"]))
        if cut["validation_end"] is not None:
            later = later.where(at < F.lit(cut["validation_end"]))
        parts[cut["fold"]] = (pretest.where(at < F.lit(cut["train_end"])), later)
    return parts


def fold_contents(dataset: DataFrame, *, time: str = "decision_time", label: str = "label") -> DataFrame:
    """Rows, times and weighted prevalence of each development fold, one row per fold."""
    weight = population_weight(label)
    parts = []
    for number, (train, validation) in development_parts(dataset, time=time, label=label).items():
        fitted = train.agg(
            F.count(F.lit(1)).alias("train_rows"),
            F.count_if(F.col(label) == 1).alias("train_positives"),
            F.max(time).alias("last_train_time"),
        )
        checked = validation.agg(
            F.count(F.lit(1)).alias("validation_rows"),
            F.min(time).alias("first_validation_time"),
            F.max(time).alias("last_validation_time"),
            (F.sum(F.when(F.col(label) == 1, weight).otherwise(F.lit(0.0))) / F.sum(weight)).alias("prevalence"),
        )
        parts.append(fitted.crossJoin(checked).select(F.lit(number).alias("fold"), "*"))
    return reduce(DataFrame.unionByName, parts)


def score_variants(
    dataset: DataFrame, variants: Mapping[str, Sequence[str]], spec: ModelSpec, *, time: str = "decision_time",
    key: str = "token_address", label: str = "label",
) -> DataFrame:
    """Validation scores of every variant on the expanding folds (1..n) and the standard split (fold 0).

    All folds and variants are fitted together; each model then scores its own validation rows.
    """
    scored = []
    parts = development_parts(dataset, time=time, label=label)
    models = fit_all(
        {f"{number}/{name}": (train, features) for number, (train, _) in parts.items() for name, features in variants.items()},
        spec,
        label,
    )
    for number, (_, validation) in parts.items():
        for name, features in variants.items():
            scored.append(
                models[f"{number}/{name}"].score(validation.select(key, time, label, *features)).select(
                    F.lit(number).alias("fold"),
                    F.lit(name).alias("variant"),
                    key,
                    F.col(time),
                    F.col(label),
                    "probability",
                    population_weight(label).alias("population_weight"),
                )
            )
    return reduce(DataFrame.unionByName, scored)


def development_report(
    dataset: DataFrame, features: Sequence[str], spec: ModelSpec, *, evaluate_test: bool,
    time: str = "decision_time", label: str = "label",
) -> DataFrame:
    """One model on the chronological split of the active window, one row per evaluated part.

    The threshold is chosen on validation and only applied to test; with ``evaluate_test`` off, test rows are never
    scored and their row says that they are withheld.
    """
    split = materialise(three_way_split(in_window(dataset, time, F.col(label) == 1), time))
    require_both_classes(split, "split", label)
    model = fit(split.where(F.col("split") == "train"), features, spec, label)
    parts = ["validation", "test"] if evaluate_test else ["validation"]
    scored = materialise(
        model.score(split.where(F.col("split").isin(parts))).withColumn("population_weight", population_weight(label))
    )
    curve = pr_curve(scored, label=label, keys=["split"])
    threshold = best_f1(curve.where(F.col("split") == "validation")).first()["threshold"]
    plain = pr_curve(scored.withColumn("population_weight", F.lit(1.0)), label=label, keys=["split"])
    measured = (
        threshold_metrics(scored, threshold, label=label, keys=["split"])
        .join(average_precision(curve, ["split"]), "split")
        .join(
            average_precision(plain, ["split"]).withColumnRenamed("average_precision", "sampled_average_precision"),
            "split",
        )
        .join(calibration(scored, label=label, keys=["split"]), "split")
    )
    rows = split.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )
    status = F.when(F.col("average_precision").isNotNull(), "evaluated").when(
        F.col("split") == "train", "fitted"
    ).otherwise("withheld_until_candidate_freeze")
    return rows.join(measured, "split", "left").withColumn("status", status)


def variant_results(scored: DataFrame, experiment: str, label: str = "label") -> DataFrame:
    """Tall result table: experiment, fold, variant, metric, value."""
    metrics = evaluate(scored, label=label, keys=["fold", "variant"])
    names = [c for c in metrics.columns if c not in ("fold", "variant")]
    tall = metrics.unpivot(["fold", "variant"], names, "metric", "value")
    return tall.select(F.lit(experiment).alias("experiment"), "fold", "variant", "metric", "value")


def variant_deltas(results: DataFrame, baseline: str, metric: str = "average_precision") -> DataFrame:
    """Per experiment, fold and other variant: how far its metric lies above the baseline's."""
    rows = results.where(F.col("metric") == metric).select("experiment", "fold", "variant", "value")
    base = rows.where(F.col("variant") == baseline).select("experiment", "fold", F.col("value").alias("_base"))
    return (
        rows.where(F.col("variant") != baseline)
        .join(base, ["experiment", "fold"])
        .select("experiment", "fold", "variant", (F.col("value") - F.col("_base")).alias("delta"))
    )


@dataclass(frozen=True)
class Shuffle:
    """Rows, the column groups that are shuffled in them one at a time, and how often."""

    rows: DataFrame
    groups: Mapping[str, Sequence[str]]
    repeats: int
    seed: int

    @property
    def columns(self) -> list[str]:
        return sorted({c for members in self.groups.values() for c in members})


def permute_groups(
    rows: DataFrame, groups: Mapping[str, Sequence[str]], *, repeats: int, seed: int, key: str = "token_address"
) -> DataFrame:
    """Rows repeated per (``name``, ``repeat``) with the columns of that group taken from another row.

    Two seeded hash orders of the key give each row a rank as receiver and a rank as donor; joining equal ranks is a
    bijection, so every donor is used exactly once and the columns of a group move together.
    """
    return permute_parts([Shuffle(rows, groups, repeats, seed)], key=key)[0]


def permute_parts(parts: Sequence[Shuffle], *, key: str = "token_address") -> list[DataFrame]:
    """``permute_groups`` of each part; the rows of all parts are ranked together."""
    every = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [
            part.rows.withColumns({"_part": F.lit(number), "_seed": F.lit(part.seed), "_repeats": F.lit(part.repeats)})
            for number, part in enumerate(parts)
        ],
    )
    each = every.withColumn("repeat", F.explode(F.sequence(F.lit(1), "_repeats"))).withColumn(
        "_one", F.lit(1).cast("long")
    )
    moved = sorted({c for part in parts for c in part.columns})

    def ranked(role: str, columns: Sequence[str]) -> DataFrame:
        order = F.xxhash64(F.col(key), F.col("_seed"), F.col("repeat"), F.lit(role))
        hashed = each.select("_part", "repeat", key, *[c for c in columns if c != key], "_one", order.alias("_hash"))
        return running_totals(hashed, order=["_hash", key], sums={"_rank": "_one"}, keys=["_part", "repeat"])

    receivers = ranked("receiver", every.drop("_part", "_seed", "_repeats").columns)
    donors = ranked("donor", moved).select("_part", "repeat", "_rank", *[F.col(c).alias(f"_d_{c}") for c in moved])
    paired = receivers.join(donors, ["_part", "repeat", "_rank"]).drop("_rank")
    if len(parts) > 1:
        paired = materialise(paired)  # else each part would rank and join again
    return [_moved(paired, number, part) for number, part in enumerate(parts)]


def _moved(paired: DataFrame, number: int, part: Shuffle) -> DataFrame:
    columns = part.columns
    own = paired.where(F.col("_part") == number).select("repeat", *part.rows.columns, *[f"_d_{c}" for c in columns])
    names = F.array(*[F.lit(n) for n in part.groups])
    spread = own.withColumn("name", F.explode(names))
    replaced = {
        c: F.when(F.col("name").isin([n for n, m in part.groups.items() if c in m]), F.col(f"_d_{c}")).otherwise(F.col(c))
        for c in columns
    }
    return spread.withColumns(replaced).drop(*[f"_d_{c}" for c in columns])


def permutation_importance(
    model: Model, validation: DataFrame, groups: Mapping[str, Sequence[str]], *, repeats: int,
    seed: int = PERMUTATION_SEED, key: str = "token_address", label: str = "label",
) -> DataFrame:
    """Loss of average precision when a feature group is shuffled, per group over seeded repeats."""
    return importance_of_parts([(model, Shuffle(validation, groups, repeats, seed))], key=key, label=label).drop("part")


def importance_of_parts(
    parts: Sequence[tuple[Model, Shuffle]], *, key: str = "token_address", label: str = "label"
) -> DataFrame:
    """``permutation_importance`` of each (model, shuffle) by its number in ``part``, measured in one plan."""
    shuffles = []
    for model, shuffle in parts:
        if shuffle.repeats < 1:
            raise ValueError("at least one repeat is needed")
        if "baseline" in shuffle.groups:
            raise ValueError("baseline is a reserved group name")
        require_feature_groups(shuffle.groups, model.features)
        shuffles.append(replace(shuffle, rows=shuffle.rows.select(key, label, *model.features)))
    scored = []
    for number, ((model, _), shuffle, shuffled) in enumerate(zip(parts, shuffles, permute_parts(shuffles, key=key))):
        untouched = shuffle.rows.withColumns({"repeat": F.lit(0), "name": F.lit("baseline")})
        scored.append(
            model.score(shuffled.unionByName(untouched)).select(
                F.lit(number).alias("part"), "name", "repeat", F.col(label), "probability",
                population_weight(label).alias("population_weight"),
            )
        )
    keys = ["part", "name", "repeat"]
    precision = average_precision(pr_curve(reduce(DataFrame.unionByName, scored), label=label, keys=keys), keys)
    base = precision.where(F.col("name") == "baseline").select("part", F.col("average_precision").alias("baseline_pr_auc"))
    drop = F.col("baseline_pr_auc") - F.col("average_precision")
    return (
        precision.where(F.col("name") != "baseline")
        .join(F.broadcast(base), "part")  # one row for each part
        .groupBy("part", "name")
        .agg(
            F.max("baseline_pr_auc").alias("baseline_pr_auc"),
            F.count(F.lit(1)).alias("repeats"),
            F.avg("average_precision").alias("permuted_pr_auc_mean"),
            F.stddev_pop("average_precision").alias("permuted_pr_auc_std"),
            F.avg(drop).alias("pr_auc_drop_mean"),
            F.min(drop).alias("pr_auc_drop_min"),
            F.max(drop).alias("pr_auc_drop_max"),
        )
    )


def attribution(
    dataset: DataFrame, features: Sequence[str], groups: Mapping[str, Sequence[str]], spec: ModelSpec, *,
    fold_repeats: int = FOLD_REPEATS, standard_repeats: int = STANDARD_REPEATS, seed: int = PERMUTATION_SEED,
    time: str = "decision_time", key: str = "token_address", label: str = "label",
) -> DataFrame:
    """Permutation importance of feature groups and of single features on every fold and the standard split (fold 0).

    One model per fold serves both families; each fold and family shuffles with a seed of its own. All are ranked, scored
    and measured in one plan.
    """
    families = {"group": groups, "feature": {f: [f] for f in features}}
    parts = development_parts(dataset, time=time, label=label)
    models = fit_all({str(number): (train, features) for number, (train, _) in parts.items()}, spec, label)
    measured, numbers = [], []
    for number, (_, validation) in parts.items():
        rows = materialise(validation.select(key, label, *features))
        repeats = standard_repeats if number == STANDARD_FOLD else fold_repeats
        for offset, (family, members) in enumerate(families.items()):
            measured.append((models[str(number)], Shuffle(rows, members, repeats, seed + 10 * number + offset)))
            numbers.append((number, family))
    importance = materialise(importance_of_parts(measured, key=key, label=label))
    fold, family = (F.array(*[F.lit(n[i]) for n in numbers])[F.col("part")] for i in (0, 1))
    return importance.select(fold.alias("fold"), family.alias("family"), *[c for c in importance.columns if c != "part"])


def rank_importance(drops: DataFrame) -> DataFrame:
    """Aggregate per-fold drops (``fold``, ``name``, ``delta``) and rank them, largest mean first."""
    from pyspark.sql import Window

    summary = fold_summary(drops, ["name"])
    # One row per feature or group, so a single ordered window is small by construction.
    order = Window.orderBy(F.col("mean_delta").desc(), F.col("name"))
    return summary.withColumn("rank", F.row_number().over(order))
