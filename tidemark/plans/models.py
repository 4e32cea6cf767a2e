"""Classifiers over decision features: a linear pipeline of MLlib, and boosted trees."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.guards import require_pre_decision_names
from tidemark.operators.boosting import BoostedModel, BoostingSpec, fit_boosted


@dataclass(frozen=True)
class ModelSpec:
    """What to fit."""

    family: str = "boosting"
    boosting: BoostingSpec = field(default_factory=BoostingSpec)
    max_iterations: int = 1000


@dataclass(frozen=True)
class FittedModel:
    """A fitted linear pipeline; ``features`` were requested, ``used`` had at least one value in training."""

    pipeline: PipelineModel
    features: Sequence[str]
    used: Sequence[str]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` of the positive class."""
        scored = self.pipeline.transform(_inputs(df, self.used))
        return scored.select(*df.columns, vector_to_array("_probability")[1].alias("probability"))


Model = FittedModel | BoostedModel


def fit(train: DataFrame, features: Sequence[str], spec: ModelSpec, label: str = "label") -> Model:
    """One model on class-balanced weights."""
    return fit_all({"model": (train, features)}, spec, label)["model"]


def fit_all(parts: Mapping[str, tuple[DataFrame, Sequence[str]]], spec: ModelSpec, label: str = "label") -> dict[str, Model]:
    """One model for each named (training rows, features); boosted models are fitted side by side in one job."""
    if spec.family == "boosting":
        return fit_boosted(parts, spec.boosting, label=label)
    if spec.family == "logistic":
        return {name: _fit_logistic(train, features, spec, label) for name, (train, features) in parts.items()}
    raise ValueError(f"unknown model family {spec.family}")


def _fit_logistic(train: DataFrame, features: Sequence[str], spec: ModelSpec, label: str) -> FittedModel:
    """Mean imputation, standard scores, and logistic regression."""
    require_pre_decision_names(features)
    stats = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 1).alias("p"),
        *[F.count(c).alias(f"c_{i}") for i, c in enumerate(features)],
    ).first()
    rows, positives = stats["n"], stats["p"]
    if positives in (0, rows):
        raise ValueError("training rows must contain both classes")
    usable = [c for i, c in enumerate(features) if stats[f"c_{i}"] > 0]
    balance = F.when(F.col(label) == 1, rows / (2.0 * positives)).otherwise(rows / (2.0 * (rows - positives)))
    prepared = _inputs(train, usable).withColumn("_weight", balance).withColumn("_label", F.col(label).cast("double"))
    imputer = Imputer(
        inputCols=[f"_x_{c}" for c in usable], outputCols=[f"_i_{c}" for c in usable], strategy="mean"
    )
    assembler = VectorAssembler(inputCols=[f"_i_{c}" for c in usable], outputCol="_vector")
    scaler = StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=True, withStd=True)
    # A unit-strength ridge penalty on weights that sum to the row count equals 1 / rows here.
    model = LogisticRegression(
        featuresCol="_scaled", maxIter=spec.max_iterations, regParam=1.0 / rows, standardization=False,
        labelCol="_label", weightCol="_weight", predictionCol="_prediction", rawPredictionCol="_raw",
        probabilityCol="_probability",
    )
    return FittedModel(Pipeline(stages=[imputer, assembler, scaler, model]).fit(prepared), tuple(features), tuple(usable))


def _inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*df.columns, *[F.col(c).cast("double").alias(f"_x_{c}") for c in features])
