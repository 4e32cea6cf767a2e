from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.registry import query
from tidemark.operators import asof, quality
from tidemark.plans.backtest import mark_returns
from tidemark.sources.scratch import materialise

_ENTRY_COLUMNS = """token_address, requested_delay_slots, target_entry_slot, covered, entry_block_slot, entry_block_time,
    entry_tx_index, entry_part_key, entry_supp_key, entry_side, round(entry_price_usd, 6) AS entry_price_usd,
    entry_price_sol, actual_delay_slots, wait_slots_beyond_target"""


def first_entries(spark, sf_dir):
    return asof.first_at_or_after(
        b.weighted_decisions(spark, sf_dir), b.trades(spark, sf_dir), order=b.ORDER, payload=b.PAYLOAD
    )


def marked_rows(spark, sf_dir):
    # Entries and exits take the same columns of the trades, so one exchange of the trades serves both.
    trades, prices = b.trades(spark, sf_dir), ("price_usd",)
    entries = asof.first_at_or_after(b.weighted_decisions(spark, sf_dir), trades, order=b.ORDER, payload=prices)
    return mark_returns(
        entries, trades, hold_seconds=b.HOLD_SECONDS, outcome_cutoff=b.CUTOFF, order=b.ORDER, payload=prices
    )


def slot_entries(spark, sf_dir):
    return asof.first_in_slot_from(
        b.weighted_decisions(spark, sf_dir), b.trades(spark, sf_dir), position_lag=2, order=b.ORDER, payload=b.PAYLOAD,
        outcome_cutoff=b.CUTOFF,
    )


@query(
    "asof_first_after",
    f"WITH {b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {b.first_entries_sql()} SELECT {_ENTRY_COLUMNS} FROM entries",
)
def asof_first_after(spark, sf_dir):
    return first_entries(spark, sf_dir).select(
        "token_address", "requested_delay_slots", "target_entry_slot", "covered", "entry_block_slot",
        "entry_block_time", "entry_tx_index", "entry_part_key", "entry_supp_key", "entry_side",
        F.round("entry_price_usd", 6).alias("entry_price_usd"), "entry_price_sol", "actual_delay_slots",
        "wait_slots_beyond_target",
    )


SLOT_ENTRIES_SQL = f"""slot_candidates AS (
    SELECT d.token_address, t.*, row_number() OVER (PARTITION BY d.token_address
               ORDER BY t.block_slot, t.block_time, t.tx_index, t.part_key, t.supp_key) AS rn
    FROM deployments d JOIN trades t ON t.token_address = d.token_address AND t.block_slot = d.block_slot
     AND t.tx_index >= d.tx_index + 2 AND t.block_time < {b.CUTOFF}),
slot_entries AS (
    SELECT d.token_address, d.decision_time, d.label, d.population_weight, d.block_slot AS deploy_block_slot,
           d.tx_index AS deploy_tx_index, 0 AS requested_delay_slots, c.rn IS NOT NULL AS covered,
           c.block_slot AS entry_block_slot, c.block_time AS entry_block_time, c.tx_index AS entry_tx_index,
           c.part_key AS entry_part_key, c.supp_key AS entry_supp_key, c.price_usd AS entry_price_usd,
           c.price_sol AS entry_price_sol, d.tx_index + 2 AS position_floor_tx_index,
           c.tx_index - d.tx_index AS actual_position_delta
    FROM deployments d LEFT JOIN slot_candidates c ON c.token_address = d.token_address AND c.rn = 1)"""


@query(
    "asof_same_slot_floor",
    f"""WITH {b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {SLOT_ENTRIES_SQL}
    SELECT token_address, covered, entry_block_time, entry_tx_index, entry_part_key, entry_supp_key,
           round(entry_price_usd, 6) AS entry_price_usd, position_floor_tx_index, actual_position_delta
    FROM slot_entries""",
)
def asof_same_slot_floor(spark, sf_dir):
    return slot_entries(spark, sf_dir).select(
        "token_address", "covered", "entry_block_time", "entry_tx_index", "entry_part_key", "entry_supp_key",
        F.round("entry_price_usd", 6).alias("entry_price_usd"), "position_floor_tx_index", "actual_position_delta",
    )


_MARKED = f"{b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {b.first_entries_sql()}, {b.marks_sql()}"


@query(
    "asof_last_within_hold",
    f"""WITH {_MARKED}
    SELECT token_address, requested_delay_slots, entry_block_time, exit_target_time, exit_block_slot, exit_block_time,
           exit_tx_index, exit_part_key, exit_supp_key, round(exit_price_usd, 6) AS exit_price_usd,
           round(gross_return, 6) AS gross_return, mark_staleness_seconds FROM marked""",
)
def asof_last_within_hold(spark, sf_dir):
    return marked_rows(spark, sf_dir).select(
        "token_address", "requested_delay_slots", "entry_block_time", "exit_target_time", "exit_block_slot",
        "exit_block_time", "exit_tx_index", "exit_part_key", "exit_supp_key",
        F.round("exit_price_usd", 6).alias("exit_price_usd"), F.round("gross_return", 6).alias("gross_return"),
        "mark_staleness_seconds",
    )


@query(
    "asof_coverage",
    f"""WITH {b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {b.first_entries_sql()}
    SELECT requested_delay_slots, count(*) AS rows, count(*) FILTER (WHERE covered) AS covered_rows,
           count(*) FILTER (WHERE NOT covered) AS missing_rows,
           round(avg(CASE WHEN covered THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS coverage_rate,
           count(*) FILTER (WHERE entry_block_slot = target_entry_slot) AS exact_target_slot_rows,
           count(*) FILTER (WHERE entry_block_slot > target_entry_slot) AS later_than_target_rows,
           CAST(quantile_cont(wait_slots_beyond_target, 0.5) AS DOUBLE) AS median_wait_slots_beyond_target,
           round(CAST(quantile_cont(wait_slots_beyond_target, 0.95) AS DOUBLE), 6) AS p95_wait_slots_beyond_target
    FROM entries GROUP BY requested_delay_slots""",
)
def asof_coverage(spark, sf_dir):
    return quality.coverage(materialise(first_entries(spark, sf_dir))).withColumns(
        {
            "coverage_rate": F.round("coverage_rate", 9),
            "p95_wait_slots_beyond_target": F.round("p95_wait_slots_beyond_target", 6),
        }
    )


_POSITION = "(entry_block_slot, entry_block_time, entry_tx_index, entry_part_key, entry_supp_key)"


@query(
    "entry_integrity",
    f"""WITH {b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {b.first_entries_sql()},
    per_key AS (
        SELECT token_address, count(*) AS n, count(DISTINCT requested_delay_slots) AS d,
               bool_or(requested_delay_slots NOT IN (0, 1, 2)) AS outside FROM entries GROUP BY token_address),
    pairs AS (
        SELECT count(DISTINCT a.token_address) AS n FROM entries a JOIN entries c
          ON a.token_address = c.token_address AND a.requested_delay_slots < c.requested_delay_slots
         AND a.covered AND c.covered
        WHERE (c.entry_block_slot, c.entry_block_time, c.entry_tx_index, c.entry_part_key, c.entry_supp_key)
            < (a.entry_block_slot, a.entry_block_time, a.entry_tx_index, a.entry_part_key, a.entry_supp_key))
    SELECT (SELECT count(*) FROM per_key WHERE n > d) AS keys_with_repeated_delays,
           (SELECT count(*) FROM per_key WHERE n <> 3 OR d <> 3 OR outside) AS keys_with_wrong_delay_set,
           count(*) FILTER (WHERE target_entry_slot <> deploy_block_slot + requested_delay_slots)
               AS target_slot_mismatches,
           count(*) FILTER (WHERE covered AND (entry_block_slot IS NULL OR entry_tx_index IS NULL
               OR entry_block_time IS NULL OR entry_price_usd IS NULL OR entry_price_sol IS NULL))
               AS covered_with_null_fields,
           count(*) FILTER (WHERE covered AND entry_block_slot < target_entry_slot) AS entries_before_target,
           count(*) FILTER (WHERE covered AND entry_block_slot = deploy_block_slot
               AND entry_tx_index <= deploy_tx_index) AS entries_in_deploy_transaction,
           count(*) FILTER (WHERE covered AND (entry_price_usd <= 0 OR entry_price_sol <= 0)) AS nonpositive_prices,
           count(*) FILTER (WHERE covered AND actual_delay_slots <> entry_block_slot - deploy_block_slot)
               AS actual_delay_mismatches,
           count(*) FILTER (WHERE covered AND wait_slots_beyond_target <> actual_delay_slots - requested_delay_slots)
               AS wait_mismatches,
           count(*) FILTER (WHERE NOT covered AND (entry_block_slot IS NOT NULL OR entry_price_usd IS NOT NULL))
               AS uncovered_with_fields,
           (SELECT n FROM pairs) AS keys_with_decreasing_positions
    FROM entries""",
)
def entry_integrity(spark, sf_dir):
    return quality.entry_integrity(
        first_entries(spark, sf_dir),
        position=b.ORDER,
        required=("block_slot", "tx_index", "block_time", "price_usd", "price_sol"),
    )


@query(
    "delay_monotonic",
    f"""WITH {b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {b.first_entries_sql()},
    stepped AS (
        SELECT token_address, {_POSITION} < lag({_POSITION}) OVER (
                   PARTITION BY token_address ORDER BY requested_delay_slots) AS back
        FROM entries WHERE covered)
    SELECT e.token_address, count(*) FILTER (WHERE e.covered) AS covered_delays,
           NOT coalesce(max(s.back), false) AS monotonic
    FROM entries e LEFT JOIN (SELECT token_address, bool_or(back) AS back FROM stepped GROUP BY token_address) s
      USING (token_address) GROUP BY e.token_address""",
)
def delay_monotonic(spark, sf_dir):
    return quality.delay_monotonic(first_entries(spark, sf_dir), position=b.ORDER)


@query(
    "position_entry_integrity",
    f"""WITH {b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}, {SLOT_ENTRIES_SQL}
    SELECT count(*) FILTER (WHERE covered AND entry_block_slot <> deploy_block_slot) AS entries_outside_slot,
           count(*) FILTER (WHERE covered AND actual_position_delta < 2) AS entries_before_floor,
           count(*) FILTER (WHERE covered AND (entry_price_usd <= 0 OR entry_price_sol <= 0)) AS nonpositive_prices,
           count(*) FILTER (WHERE NOT covered AND (entry_block_slot IS NOT NULL OR entry_price_usd IS NOT NULL
               OR actual_position_delta IS NOT NULL)) AS uncovered_with_fields
    FROM slot_entries""",
)
def position_entry_integrity(spark, sf_dir):
    return quality.position_entry_integrity(slot_entries(spark, sf_dir), 2)


@query(
    "backtest_row_integrity",
    f"""WITH {_MARKED}
    SELECT (SELECT count(*) FROM (SELECT 1 FROM marked GROUP BY token_address, requested_delay_slots
                HAVING count(*) > 1)) AS repeated_keys,
           count(*) FILTER (WHERE entry_block_time + {b.HOLD_SECONDS} >= {b.CUTOFF}) AS hold_crosses_cutoff,
           count(*) FILTER (WHERE exit_block_time > exit_target_time) AS exits_after_target,
           (SELECT count(*) FROM eligible) - count(*) AS missing_exits,
           count(*) FILTER (WHERE (exit_block_slot, exit_block_time, exit_tx_index, exit_part_key, exit_supp_key)
               < {_POSITION}) AS exits_before_entry,
           count(*) FILTER (WHERE entry_price_usd <= 0 OR exit_price_usd <= 0) AS nonpositive_prices,
           count(*) FILTER (WHERE NOT isfinite(gross_return)) AS nonfinite_returns
    FROM marked""",
)
def backtest_row_integrity(spark, sf_dir):
    return quality.backtest_row_integrity(
        marked_rows(spark, sf_dir), hold_seconds=b.HOLD_SECONDS, outcome_cutoff=b.CUTOFF, position=b.ORDER
    )


@query(
    "facts_after_decision",
    f"""WITH {b.DEPLOYMENTS_SQL}, {b.TRADES_SQL}
    SELECT t.token_address, count(*) AS later_trades, min(t.block_time) AS first_time
    FROM trades t JOIN deployments d USING (token_address)
    WHERE t.block_slot > d.block_slot OR (t.block_slot = d.block_slot AND t.tx_index > d.tx_index)
    GROUP BY t.token_address""",
)
def facts_after_decision(spark, sf_dir):
    after = asof.facts_after_decision(b.decisions(spark, sf_dir), b.trades(spark, sf_dir))
    return after.groupBy("token_address").agg(
        F.count(F.lit(1)).alias("later_trades"), F.min("block_time").alias("first_time")
    )
