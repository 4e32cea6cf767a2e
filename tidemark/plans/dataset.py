"""The labelled decision table: extracted features, index, label, clock and strictly-prior history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import add_utc_clock, epoch_to_time
from tidemark.functions.transaction import transaction_features
from tidemark.operators.history import attach_history, prior_history
from tidemark.operators.joins import one_to_one
from tidemark.sources.tables import systematic_sample


def labelled_features(lines: DataFrame, index: DataFrame, label: int, *, stride: int = 1) -> DataFrame:
    """Features of (sampled) raw lines joined to their index rows by line number, with label and clock columns.

    A repeated line number on either side stops the plan.
    """
    raw = transaction_features(systematic_sample(lines, stride))
    joined = one_to_one(index.drop("block_slot"), raw, ["line_number"])
    timed = joined.withColumn("decision_time", epoch_to_time("decision_epoch")).withColumn("label", F.lit(label))
    return add_utc_clock(timed)


def combine_classes(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Stack both classes by column name; a column one side lacks becomes null there."""
    return positive.unionByName(negative, allowMissingColumns=True)


def with_history(dataset: DataFrame, indexes: list[DataFrame]) -> DataFrame:
    return attach_history(dataset, prior_history(indexes))
