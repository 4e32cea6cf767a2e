"""Audits: many counters from one scan, key audits, and integrity rules of derived tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_where(rule: Column) -> Column:
    """Rows that satisfy a rule; a null rule does not count."""
    return F.count_if(F.coalesce(rule, F.lit(False)))


def guarded(df: DataFrame, violations: DataFrame, name: str) -> DataFrame:
    """The rows as they are, as long as every count in the one row of ``violations`` is zero; else the plan stops.

    The counts are part of the same plan and arrive as one broadcast row; the error names them.
    """
    broken = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) != 0 for c in violations.columns])
    report = F.concat(F.lit(f"{name} breaks its rules: "), F.to_json(F.struct(*violations.columns)))
    sound = violations.select(F.when(broken, F.raise_error(report).cast("boolean")).otherwise(F.lit(True)).alias("_sound"))
    return df.crossJoin(F.broadcast(sound)).where("_sound").drop("_sound")


def null_counts(df: DataFrame, suffix: str = "") -> list[Column]:
    return [(F.count(F.lit(1)) - F.count(F.col(c))).alias(f"{c}{suffix}") for c in df.columns]


def null_report(df: DataFrame) -> DataFrame:
    """Null count of every column, one row per column, from one scan."""
    wide = df.agg(*null_counts(df))
    return wide.unpivot([], df.columns, "column_name", "null_rows")


def row_contract(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of a table next to the number that was announced (one row, ``expected_rows``), and whether they agree."""
    return df.agg(F.count(F.lit(1)).alias("rows")).crossJoin(expected.select("expected_rows")).withColumn(
        "rows_as_expected", F.col("rows") == F.col("expected_rows")
    )


def expected_rows(df: DataFrame, expected: int) -> DataFrame:
    """One violation count: how far the number of rows is from the announced one."""
    return df.agg(F.abs(F.count(F.lit(1)) - F.lit(expected)).alias("row_count_difference"))


def column_ranges(df: DataFrame) -> DataFrame:
    """Minimum, maximum and non-null rows of every orderable column as text, from one scan; zero has no sign."""
    kinds = dict(df.dtypes)
    text = lambda c, value: (value + F.lit(0.0) if kinds[c] in ("double", "float") else value).cast("string")
    wide = df.agg(
        *[
            F.struct(
                text(c, F.min(c)).alias("minimum"),
                text(c, F.max(c)).alias("maximum"),
                F.count(c).alias("non_null_rows"),
            ).alias(c)
            for c in df.columns
        ]
    )
    return wide.unpivot([], df.columns, "column_name", "r").select("column_name", "r.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with more than one row and how many rows are too many."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return repeated.agg(
        F.count(F.lit(1)).alias("duplicate_key_groups"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_extra_rows"),
    )


def keys_with_several_contexts(df: DataFrame, key: str, context: Sequence[str], name: str) -> DataFrame:
    """Keys seen with more than one context.

    More than one distinct struct is the same as minimum and maximum being different, which needs neither a row
    expansion nor a set per key, and counts contexts that contain nulls.
    """
    whole = F.struct(*context)
    per_key = df.groupBy(key).agg(F.min(whole).alias("_lo"), F.max(whole).alias("_hi"))
    return per_key.agg(count_where(~F.col("_lo").eqNullSafe(F.col("_hi"))).alias(name))


def distinct_where(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """Distinct keys overall and under each rule in one row.

    Flags are collapsed per key first, so one exchange serves all distinct counts.
    """
    flags = df.groupBy(key).agg(
        *[F.max(F.coalesce(rule, F.lit(False)).cast("int")).alias(n) for n, rule in rules.items()]
    )
    return flags.agg(*[F.count(F.when(F.col(n) == 1, F.col(key))).alias(n) for n in rules])


def issues(report: DataFrame, names: Sequence[str]) -> DataFrame:
    """Names of the counters of a one-row report that are not zero, and whether the table passes without filters."""
    found = F.filter(F.array(*[F.when(F.col(n) > 0, F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return report.withColumn("quality_issues", F.array_join(found, ",")).withColumn(
        "source_validation_status",
        F.when(F.size(found) == 0, F.lit("passed")).otherwise(F.lit("requires_explicit_filters")),
    )


def require_zero(report: DataFrame, names: Sequence[str] | None = None) -> None:
    """Run a one-row report of violation counts and stop when any is not zero."""
    row = report.first().asDict()
    broken = {n: v for n, v in row.items() if v and (names is None or n in names)}
    if broken:
        raise ValueError(f"integrity rules are violated: {broken}")


def trade_audit(trades: DataFrame, *, sides: Sequence[str], programs: Sequence[str] | None = None) -> DataFrame:
    """Row counters of a trades table relative to its decisions; optional columns are audited when present."""
    same = F.col("block_slot") == F.col("deploy_block_slot")
    distance = F.col("block_slot") - F.col("deploy_block_slot")
    checks = {
        "pre_deploy_position_rows": (distance < 0) | (same & (F.col("tx_index") < F.col("deploy_tx_index"))),
        "same_deploy_transaction_rows": same & (F.col("tx_index") == F.col("deploy_tx_index")),
        "executable_same_slot_rows": same & (F.col("tx_index") > F.col("deploy_tx_index")),
        "slot_plus_1_rows": distance == 1,
        "slot_plus_2_rows": distance == 2,
        "later_slot_rows": distance > 2,
        "pre_deploy_time_rows": F.col("block_time") < F.col("deploy_block_time"),
        "invalid_side_rows": ~F.col("side").isin(*sides),
        "nonpositive_price_or_base_rows": (F.col("price_usd") <= 0) | (F.col("price_sol") <= 0),
    }
    present = set(trades.columns)
    if "base_amount" in present:
        checks["nonpositive_price_or_base_rows"] = checks["nonpositive_price_or_base_rows"] | (F.col("base_amount") <= 0)
    if programs is not None and "program" in present:
        checks["invalid_program_rows"] = ~F.col("program").isin(*programs)
    if {"slot_index_id", "event_index"} <= present:
        checks["slot_index_encoding_mismatch_rows"] = F.col("slot_index_id") != F.format_string(
            "%012d%06d%04d", "block_slot", "tx_index", "event_index"
        )
    if "timestamp" in present:
        checks["timestamp_mismatch_rows"] = (
            F.unix_seconds(F.col("timestamp").cast("timestamp")) != F.col("block_time")
        )
    if {"creator_address", "deploy_tx_signer"} <= present:
        checks["creator_signer_difference_rows"] = F.col("creator_address") != F.col("deploy_tx_signer")
    if {"amount_usd", "amount_sol", "quote_amount"} <= present:
        checks["negative_amount_rows"] = (
            (F.col("amount_usd") < 0) | (F.col("amount_sol") < 0) | (F.col("quote_amount") < 0)
        )
    if {"quote_mint", "base_decimals", "quote_decimals"} <= present:
        checks["noncanonical_quote_rows"] = (
            (F.col("quote_mint") != QUOTE_MINT) | (F.col("base_decimals") != 6) | (F.col("quote_decimals") != 9)
        )
    # Counted by token first: one read, and one exchange if the tokens do not lie together yet, serves rows and tokens.
    found = {
        "unique_tokens": F.lit(True),
        "executable_same_slot_tokens": checks["executable_same_slot_rows"],
        "slot_plus_1_tokens": checks["slot_plus_1_rows"],
        "slot_plus_2_tokens": checks["slot_plus_2_rows"],
    }
    bounds = {f"{f.__name__}_{c}": f(c) for c in ("block_time", "block_slot") for f in (F.min, F.max)}
    by_token = trades.groupBy("token_address").agg(
        F.count(F.lit(1)).alias("rows"),
        *[value.alias(name) for name, value in bounds.items()],
        *[count_where(rule).alias(name) for name, rule in checks.items()],
        *[F.max(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in found.items()],
    )
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    return by_token.agg(
        total("rows"),
        *[(F.min if name.startswith("min") else F.max)(name).alias(name) for name in bounds],
        *[total(name) for name in checks],
        *[F.count(F.when(F.col(name), F.col("token_address"))).alias(name) for name in found],
    )


# Fixed value: the only quote currency whose amounts are comparable.
QUOTE_MINT = "So11111111111111111111111111111111111111112"
# Programs and sides a trade row may carry.
PROGRAMS = ("pump", "pump_amm")
SIDES = ("buy", "sell")
GUARDED_TRADE_COUNTERS = (
    "pre_deploy_position_rows",
    "pre_deploy_time_rows",
    "slot_index_encoding_mismatch_rows",
    "timestamp_mismatch_rows",
    "invalid_side_rows",
    "invalid_program_rows",
    "nonpositive_price_or_base_rows",
    "negative_amount_rows",
    "noncanonical_quote_rows",
    "duplicate_key_groups",
    "tokens_with_multiple_deploy_contexts",
)


def bar_audit(bars: DataFrame) -> DataFrame:
    """Candle rules: not before the decision, whole seconds, consistent prices, no negative flow."""
    early = F.col("candle_time_ms") < F.col("deploy_time_ms")
    gap = F.col("candle_time_ms") - F.col("deploy_time_ms")
    outside = lambda c: (F.col(c) < F.col("low_mcap")) | (F.col(c) > F.col("high_mcap"))
    counters = bars.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("deploy_time_ms").alias("min_deploy_time_ms"),
        F.max("deploy_time_ms").alias("max_deploy_time_ms"),
        F.min("candle_time_ms").alias("min_candle_time_ms"),
        F.max("candle_time_ms").alias("max_candle_time_ms"),
        count_where(early).alias("pre_deploy_rows"),
        F.min(F.when(early, gap)).alias("minimum_pre_deploy_delta_ms"),
        F.max(F.when(early, gap)).alias("maximum_pre_deploy_delta_ms"),
        count_where(
            (F.col("deploy_time_ms") != F.col("deploy_time_s") * 1000)
            | (F.col("candle_time_ms") != F.col("candle_time_s") * 1000)
        ).alias("second_alignment_violations"),
        count_where(
            (F.col("low_mcap") > F.col("high_mcap")) | outside("open_mcap") | outside("close_mcap")
        ).alias("invalid_ohlc_rows"),
        count_where((F.col("volume") < 0) | (F.col("amount") < 0)).alias("negative_flow_rows"),
    )
    tokens = distinct_where(
        bars, "token_address", {"unique_tokens": F.lit(True), "pre_deploy_tokens": early}
    )
    return counters.crossJoin(tokens)


def entry_integrity(
    entries: DataFrame,
    *,
    position: Sequence[str],
    required: Sequence[str],
    delays: Sequence[int] = (0, 1, 2),
    key: str = "token_address",
) -> DataFrame:
    """Violation counts of an entry table; every one must be zero.

    Row rules and per-key rules are counted in the same pass: the key rules only need counts and one position per
    delay, so nothing is collected per key.
    """
    covered = F.col("covered")
    slot = F.col("entry_block_slot")
    outputs = [f"entry_{c}" for c in required] + ["actual_delay_slots", "wait_slots_beyond_target"]
    any_null, any_value = F.lit(False), F.lit(False)
    for c in required:
        any_null = any_null | F.col(f"entry_{c}").isNull()
    for c in outputs:
        any_value = any_value | F.col(c).isNotNull()
    requested, deploy = F.col("requested_delay_slots"), F.col("deploy_block_slot")
    rules = {
        "target_slot_mismatches": F.col("target_entry_slot") != deploy + requested,
        "covered_with_null_fields": covered & any_null,
        "entries_before_target": covered & (slot < F.col("target_entry_slot")),
        "entries_in_deploy_transaction": covered
        & (slot == deploy)
        & (F.col("entry_tx_index") <= F.col("deploy_tx_index")),
        "nonpositive_prices": covered & ((F.col("entry_price_usd") <= 0) | (F.col("entry_price_sol") <= 0)),
        "actual_delay_mismatches": covered & (F.col("actual_delay_slots") != slot - deploy),
        "wait_mismatches": covered
        & (F.col("wait_slots_beyond_target") != F.col("actual_delay_slots") - requested),
        "uncovered_with_fields": ~covered & any_value,
    }
    where = F.struct(*[F.col(f"entry_{c}").alias(c) for c in position])
    per_key = entries.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(requested == d).alias(f"_n_{d}") for d in delays],
        *[F.max(F.when(covered & (requested == d), where)).alias(f"_p_{d}") for d in delays],
        *[count_where(rule).alias(name) for name, rule in rules.items()],
    )
    repeated, wrong_set = F.lit(False), F.col("_n") != len(delays)
    for d in delays:
        repeated = repeated | (F.col(f"_n_{d}") > 1)
        wrong_set = wrong_set | (F.col(f"_n_{d}") != 1)
    return per_key.agg(
        count_where(repeated).alias("keys_with_repeated_delays"),
        count_where(wrong_set).alias("keys_with_wrong_delay_set"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in rules],
        count_where(_decreasing([F.col(f"_p_{d}") for d in delays])).alias("keys_with_decreasing_positions"),
    )


def delay_monotonic(
    entries: DataFrame, *, position: Sequence[str], delays: Sequence[int] = (0, 1, 2), key: str = "token_address"
) -> DataFrame:
    """Per key: whether entry positions never go back as the delay grows; delays without an entry are skipped."""
    where = F.struct(*[F.col(f"entry_{c}").alias(c) for c in position])
    per_key = entries.groupBy(key).agg(
        *[
            F.max(F.when(F.col("covered") & (F.col("requested_delay_slots") == d), where)).alias(f"_p_{d}")
            for d in delays
        ],
        F.count_if(F.col("covered")).alias("covered_delays"),
    )
    return per_key.select(
        key, "covered_delays", (~_decreasing([F.col(f"_p_{d}") for d in delays])).alias("monotonic")
    )


def _decreasing(positions: Sequence[Column]) -> Column:
    """Whether any later present position is smaller than an earlier present one."""
    down = F.lit(False)
    for i, earlier in enumerate(positions):
        for later in positions[i + 1 :]:
            down = down | F.coalesce(later < earlier, F.lit(False))
    return down


def position_entry_integrity(entries: DataFrame, position_lag: int) -> DataFrame:
    covered = F.col("covered")
    filled = F.lit(False)
    for c in ("entry_block_slot", "entry_tx_index", "entry_block_time", "entry_price_usd", "actual_position_delta"):
        filled = filled | F.col(c).isNotNull()
    return entries.agg(
        count_where(covered & (F.col("entry_block_slot") != F.col("deploy_block_slot"))).alias("entries_outside_slot"),
        count_where(covered & (F.col("actual_position_delta") < position_lag)).alias("entries_before_floor"),
        count_where(covered & ((F.col("entry_price_usd") <= 0) | (F.col("entry_price_sol") <= 0))).alias(
            "nonpositive_prices"
        ),
        count_where(~covered & filled).alias("uncovered_with_fields"),
    )


def backtest_row_integrity(
    rows: DataFrame, *, hold_seconds: int, outcome_cutoff: int | Column, position: Sequence[str]
) -> DataFrame:
    """Violation counts of backtest rows (entry, exit mark and return)."""
    entry = F.struct(*[F.col(f"entry_{c}").alias(c) for c in position])
    leave = F.struct(*[F.col(f"exit_{c}").alias(c) for c in position])
    per_key = rows.groupBy("token_address", "requested_delay_slots").agg(
        F.count(F.lit(1)).alias("_n"),
        count_where(F.col("entry_block_time") + hold_seconds >= outcome_cutoff).alias("hold_crosses_cutoff"),
        count_where(F.col("exit_block_time") > F.col("exit_target_time")).alias("exits_after_target"),
        count_where(F.col("exit_block_time").isNull()).alias("missing_exits"),
        count_where(leave < entry).alias("exits_before_entry"),
        count_where((F.col("entry_price_usd") <= 0) | (F.col("exit_price_usd") <= 0)).alias("nonpositive_prices"),
        count_where(F.isnan("gross_return") | (F.abs("gross_return") == F.lit(float("inf")))).alias(
            "nonfinite_returns"
        ),
    )
    names = [c for c in per_key.columns if c not in ("token_address", "requested_delay_slots", "_n")]
    return per_key.agg(
        count_where(F.col("_n") > 1).alias("repeated_keys"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
    )


def coverage(entries: DataFrame) -> DataFrame:
    """Per delay: covered, missing, exact and later entries, and how long the wait beyond the target is."""
    from tidemark.operators.quantiles import exact_quantiles

    covered = F.col("covered")
    counts = entries.groupBy("requested_delay_slots").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(covered).alias("covered_rows"),
        F.count_if(~covered).alias("missing_rows"),
        F.avg(covered.cast("double")).alias("coverage_rate"),
        count_where(F.col("entry_block_slot") == F.col("target_entry_slot")).alias("exact_target_slot_rows"),
        count_where(F.col("entry_block_slot") > F.col("target_entry_slot")).alias("later_than_target_rows"),
    )
    waits = exact_quantiles(
        entries.where(covered),
        value="wait_slots_beyond_target",
        probs={"median_wait_slots_beyond_target": 0.5, "p95_wait_slots_beyond_target": 0.95},
        keys=["requested_delay_slots"],
    ).drop("value_rows")
    return counts.join(waits, "requested_delay_slots", "left")


def context_mismatch(decisions: DataFrame, facts: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Decisions without facts, and decisions whose context differs from the smallest context of their facts."""
    contexts = facts.groupBy(key).agg(*[F.min(c).alias(f"_c_{c}") for c in columns], F.lit(True).alias("_found"))
    joined = decisions.join(contexts, key, "left")
    found = F.col("_found").isNotNull()
    return joined.agg(
        F.count_if(found).alias("matched_tokens"),
        F.count_if(~found).alias("tokens_without_trades"),
        *[count_where(found & (F.col(c) != F.col(f"_c_{c}"))).alias(f"{c}_mismatches") for c in columns],
    )


def history_quality(df: DataFrame) -> DataFrame:
    """Counters that must be zero before history features are used."""
    count, slots = F.col("creator_prior_deploy_count"), F.col("creator_prior_active_slot_count")
    age, recency = F.col("creator_observed_age_seconds"), F.col("creator_seconds_since_previous_deploy")
    return df.agg(
        count_where(count < 0).alias("negative_prior_count_rows"),
        count_where(slots < 0).alias("negative_prior_slot_count_rows"),
        count_where(age < 0).alias("negative_observed_age_rows"),
        count_where(recency < 0).alias("negative_recency_rows"),
        count_where((count != 0) & age.isNull()).alias("nonzero_count_missing_age_rows"),
        count_where((count != 0) & recency.isNull()).alias("nonzero_count_missing_recency_rows"),
        count_where(slots > count).alias("active_slots_exceed_count_rows"),
        count_where((count == 0) != (slots == 0)).alias("zero_pattern_mismatch_rows"),
    )
