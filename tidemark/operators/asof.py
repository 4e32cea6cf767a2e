"""As-of lookups: the first or last fact around each decision.

Each lookup is one equality join on the entity key with the time rule as a residual, followed by a partial and
final ``min``/``max`` of a struct that starts with the position columns. The struct carries the payload, so no
second join fetches it. Decisions are unique by key (entries by key and delay), so the join does not multiply
facts; hot keys are cut into pieces by ``join_unique`` and meet again in the final aggregate as one row per task.

Every join has the entity key alone as its equality, and tests on the columns of the facts stand in conditions over both
sides. Facts are then exchanged by key in the same form in every lookup: lookups chained in one plan share one exchange,
and what they find is joined to the decisions where it lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import join_unique


def strictly_after(slot: str, tx: str, decision_slot: str, decision_tx: str) -> Column:
    """Lexicographic position test: a later slot, or the same slot and a later transaction."""
    return (F.col(slot) > F.col(decision_slot)) | (
        (F.col(slot) == F.col(decision_slot)) & (F.col(tx) > F.col(decision_tx))
    )


def _holds(rule: Column) -> Column:
    """The rule, false where it is unknown; Spark infers no filter from it that would set one exchange of facts apart."""
    return F.coalesce(rule, F.lit(False))


def _join_by_key(left: DataFrame, right: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """Left join on ``key`` and ``same``; both sides stay partitioned by the key, which has a few rows of ``right``."""
    names = {c: f"_r_{c}" for c in (key, *same)}
    renamed = right.withColumnsRenamed(names)
    rule = F.col(key) == F.col(names[key])
    for c in same:
        rule = rule & _holds((F.col(c) <= F.col(names[c])) & (F.col(c) >= F.col(names[c])))
    return left.join(renamed, rule, "left").drop(*names.values())


def facts_after_decision(
    decisions: DataFrame, facts: DataFrame, *, key: str = "token_address", rows_per_task: int | None = None
) -> DataFrame:
    """Facts of known decisions that come strictly after the decision position."""
    narrow = decisions.select(
        key, F.col("deploy_block_slot").alias("_slot"), F.col("deploy_tx_index").alias("_tx")
    ).distinct()
    return join_unique(facts, narrow, [key], rows_per_task=rows_per_task).where(
        _holds(strictly_after("block_slot", "tx_index", "_slot", "_tx"))
    )


def first_at_or_after(
    decisions: DataFrame,
    facts: DataFrame,
    *,
    order: Sequence[str],
    payload: Sequence[str],
    delays: Sequence[int] = (0, 1, 2),
    key: str = "token_address",
    rows_per_task: int | None = None,
) -> DataFrame:
    """For each decision and delay, the first fact at or after ``deploy_block_slot + delay``.

    Facts in or before the decision transaction never count. A decision without such a fact keeps its rows with
    ``covered = false`` and null entry columns. All delays come out of one pass over the facts.
    """
    hit = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *_extra(order, payload))
    after = facts_after_decision(decisions, facts, key=key, rows_per_task=rows_per_task)
    # A decision is its key and its position; a key that decides twice has two sets of entries.
    firsts = after.groupBy(key, F.col("_slot").alias("deploy_block_slot"), F.col("_tx").alias("deploy_tx_index")).agg(
        *[F.min(F.when(F.col("block_slot") >= F.col("_slot") + d, hit)).alias(f"_hit_{d}") for d in delays]
    )
    per_delay = F.array(*[F.struct(F.lit(d).alias("delay"), F.col(f"_hit_{d}").alias("hit")) for d in delays])
    wide = _join_by_key(decisions, firsts, key, ["deploy_block_slot", "deploy_tx_index"]).withColumn(
        "_row", F.explode(per_delay)
    )
    target = F.col("deploy_block_slot") + F.col("_row.delay")
    return wide.select(
        *decisions.columns,
        F.col("_row.delay").alias("requested_delay_slots"),
        target.alias("target_entry_slot"),
        F.col("_row.hit").isNotNull().alias("covered"),
        *_payload_columns("_row.hit", order, payload, "entry"),
        (_field("_row.hit", order, payload, "block_slot") - F.col("deploy_block_slot")).alias("actual_delay_slots"),
        (_field("_row.hit", order, payload, "block_slot") - target).alias("wait_slots_beyond_target"),
    )


def first_in_slot_from(
    decisions: DataFrame,
    facts: DataFrame,
    *,
    position_lag: int | Column,
    order: Sequence[str],
    payload: Sequence[str],
    outcome_cutoff: int | Column | None = None,
    key: str = "token_address",
    rows_per_task: int | None = None,
) -> DataFrame:
    """First fact in the decision slot whose transaction is at least ``position_lag`` after the decision's."""
    lag = F.lit(position_lag) if isinstance(position_lag, int) else position_lag
    floors = decisions.select(
        key, F.col("deploy_block_slot").alias("_slot"), (F.col("deploy_tx_index") + lag).alias("_floor")
    ).distinct()
    in_slot = (F.col("block_slot") <= F.col("_slot")) & (F.col("block_slot") >= F.col("_slot"))
    usable = _holds(in_slot & (F.col("tx_index") >= F.col("_floor")))
    if outcome_cutoff is not None:
        usable = usable & _before(outcome_cutoff, "_floor")
    hit = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *_extra(order, payload))
    firsts = (
        join_unique(facts, floors, [key], rows_per_task=rows_per_task)
        .where(usable)
        .groupBy(key, F.col("_slot").alias("deploy_block_slot"), "_floor")
        .agg(F.min(hit).alias("_hit"))
    )
    placed = decisions.withColumn("_floor", F.col("deploy_tx_index") + lag)
    wide = _join_by_key(placed, firsts, key, ["deploy_block_slot", "_floor"])
    return wide.select(
        *decisions.columns,
        F.lit(0).alias("requested_delay_slots"),
        F.col("_hit").isNotNull().alias("covered"),
        *_payload_columns("_hit", order, payload, "entry"),
        (F.col("deploy_tx_index") + lag).alias("position_floor_tx_index"),
        (_field("_hit", order, payload, "tx_index") - F.col("deploy_tx_index")).alias("actual_position_delta"),
    )


def last_within_hold(
    entries: DataFrame,
    facts: DataFrame,
    *,
    hold_seconds: int,
    order: Sequence[str],
    payload: Sequence[str],
    outcome_cutoff: int | Column | None = None,
    key: str = "token_address",
    rows_per_task: int | None = None,
    eligible: Column | None = None,
) -> DataFrame:
    """Last fact from the entry position on and no later than ``entry_block_time + hold_seconds``.

    ``entries`` is unique by key and delay and carries ``entry_<order column>``. A key has at most one entry per
    delay, and the position and time rules are part of the join, so only facts inside a hold leave it. Entries that are
    not ``eligible`` are kept without a mark.
    """
    start = F.struct(*[F.col(f"entry_{c}").alias(f"o{i}") for i, c in enumerate(order)])
    windows = (entries if eligible is None else entries.where(eligible)).select(
        key,
        "requested_delay_slots",
        start.alias("_start"),
        (F.col("entry_block_time") + F.lit(hold_seconds)).alias("_until"),
    )
    position = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    hit = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *_extra(order, payload))
    usable = _holds((F.col("block_time") <= F.col("_until")) & (position >= F.col("_start")))
    if outcome_cutoff is not None:
        usable = usable & _before(outcome_cutoff, "_until")
    lasts = (
        join_unique(facts, windows, [key], rows_per_task=rows_per_task)
        .where(usable)
        .groupBy(key, "requested_delay_slots")
        .agg(F.max(hit).alias("_hit"))
    )
    marks = lasts.select(key, "requested_delay_slots", *_payload_columns("_hit", order, payload, "exit"))
    return _join_by_key(entries, marks, key, ["requested_delay_slots"])


def _before(cutoff: int | Column, other: str) -> Column:
    """Whether a joined fact lies before the cutoff; ``other`` is a column of the other side that holds no null there."""
    limit = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    return _holds(F.when(F.col(other).isNotNull(), F.col("block_time") < limit))


def _extra(order: Sequence[str], payload: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in payload if c not in order]


def _field(hit: str, order: Sequence[str], payload: Sequence[str], name: str) -> Column:
    if name in order:
        return F.col(f"{hit}.o{list(order).index(name)}")
    if name in payload:
        return F.col(f"{hit}.{name}")
    raise ValueError(f"{name} is neither an order nor a payload column")


def _payload_columns(hit: str, order: Sequence[str], payload: Sequence[str], prefix: str) -> list[Column]:
    names = [*order, *[c for c in payload if c not in order]]
    return [_field(hit, order, payload, n).alias(f"{prefix}_{n}") for n in names]
