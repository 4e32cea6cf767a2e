import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, quality
from tidemark.operators.skew import hot_keys, join_unique
from tidemark.plans.backtest import mark_returns

ORDER = ("block_slot", "tx_index", "event_index")
PAYLOAD = ("block_time", "price_usd", "price_sol")
TRADES = "token_address string, block_slot long, tx_index int, event_index int, block_time long, price_usd double, price_sol double"
DECISIONS = (
    "token_address string, decision_time long, deploy_block_time long, deploy_block_slot long, deploy_tx_index int"
)


def trades(spark, rows):
    return spark.createDataFrame(rows, TRADES)


def test_first_trade_at_each_delay(spark):
    decisions = spark.createDataFrame([("A", 1, 1, 100, 5), ("B", 2, 2, 200, 7)], DECISIONS)
    facts = trades(
        spark,
        [
            ("A", 103, 2, 0, 13, 4.0, 0.4),
            ("A", 100, 6, 0, 10, 2.0, 0.2),
            ("A", 101, 1, 0, 11, 3.0, 0.3),
            ("A", 100, 5, 9, 10, 9.0, 0.9),
            ("C", 100, 6, 0, 10, 2.0, 0.2),
        ],
    )
    out = asof.first_at_or_after(decisions, facts, order=ORDER, payload=PAYLOAD)
    rows = {(r.token_address, r.requested_delay_slots): r for r in out.collect()}
    assert len(rows) == 6
    a = [rows["A", d] for d in (0, 1, 2)]
    assert [r.entry_price_usd for r in a] == [2.0, 3.0, 4.0]
    assert [r.actual_delay_slots for r in a] == [0, 1, 3]
    assert [r.wait_slots_beyond_target for r in a] == [0, 0, 1]
    for d in (0, 1, 2):
        b = rows["B", d]
        assert not b.covered and b.entry_price_usd is None and b.actual_delay_slots is None
    report = quality.entry_integrity(out, position=ORDER, required=("block_slot", "price_usd"))
    assert set(report.first()) == {0}
    spoiled = out.withColumn(
        "entry_tx_index", F.when(F.col("requested_delay_slots") == 0, 5).otherwise(F.col("entry_tx_index"))
    )
    with pytest.raises(ValueError, match="entries_in_deploy_transaction"):
        quality.require_zero(quality.entry_integrity(spoiled, position=ORDER, required=("block_slot",)))


def test_integrity_finds_repeated_and_missing_delays_and_decreasing_positions(spark):
    decisions = spark.createDataFrame([("A", 1, 1, 100, 5)], DECISIONS)
    facts = trades(spark, [("A", 100, 6, 0, 10, 2.0, 0.2), ("A", 103, 1, 0, 12, 3.0, 0.3)])
    out = asof.first_at_or_after(decisions, facts, order=ORDER, payload=PAYLOAD)
    report = lambda df: quality.entry_integrity(df, position=ORDER, required=("block_slot",)).first()
    assert report(out.unionAll(out.where("requested_delay_slots = 0"))).keys_with_repeated_delays == 1
    assert report(out.where("requested_delay_slots > 0")).keys_with_wrong_delay_set == 1
    swapped = out.withColumn("entry_block_slot", F.when(F.col("requested_delay_slots") == 2, 99).otherwise(F.col("entry_block_slot")))
    assert report(swapped).keys_with_decreasing_positions == 1


def test_same_slot_position_floor(spark):
    decisions = spark.createDataFrame([("a", 1, 1, 10, 5), ("b", 1, 1, 10, 5)], DECISIONS)
    facts = trades(
        spark,
        [
            ("a", 10, 6, 0, 100, 1.0, 0.1),
            ("a", 10, 17, 0, 100, 2.0, 0.2),
            ("a", 11, 0, 0, 101, 3.0, 0.3),
            ("b", 11, 20, 0, 101, 3.0, 0.3),
        ],
    )
    out = asof.first_in_slot_from(
        decisions, facts, position_lag=12, order=ORDER, payload=PAYLOAD, outcome_cutoff=200
    )
    rows = {r.token_address: r for r in out.collect()}
    assert rows["a"].entry_tx_index == 17 and rows["a"].actual_position_delta == 12
    assert not rows["b"].covered and rows["b"].entry_tx_index is None
    assert set(quality.position_entry_integrity(out, 12).first()) == {0}


def test_exit_mark_edges(spark):
    decisions = spark.createDataFrame(
        [("only", 1, 1, 10, 0), ("edge", 1, 1, 10, 0), ("late", 1, 1, 10, 0), ("cut", 1, 1, 10, 0)], DECISIONS
    )
    facts = trades(
        spark,
        [
            ("only", 10, 3, 0, 100, 2.0, 0.2),
            ("only", 10, 2, 0, 100, 9.0, 0.9),
            ("edge", 10, 1, 0, 100, 2.0, 0.2),
            ("edge", 20, 1, 0, 106, 3.0, 0.3),
            ("late", 10, 1, 0, 100, 2.0, 0.2),
            ("late", 20, 1, 0, 107, 3.0, 0.3),
            ("cut", 10, 1, 0, 100, 2.0, 0.2),
            ("cut", 20, 1, 0, 120, 3.0, 0.3),
        ],
    )
    entries = asof.first_at_or_after(decisions, facts, order=ORDER, payload=PAYLOAD).where("covered")
    # The entry of "only" is moved to its second trade, so the earlier trade of the same second must not count.
    entries = entries.withColumn(
        "entry_tx_index", F.when(F.col("token_address") == "only", 3).otherwise(F.col("entry_tx_index"))
    ).where("requested_delay_slots = 0")
    exits = asof.last_within_hold(entries, facts, hold_seconds=6, order=ORDER, payload=PAYLOAD, outcome_cutoff=120)
    marks = {r.token_address: (r.exit_block_time, r.exit_price_usd) for r in exits.collect()}
    assert marks == {"only": (100, 2.0), "edge": (106, 3.0), "late": (100, 2.0), "cut": (100, 2.0)}
    marked = mark_returns(
        entries, facts, hold_seconds=6, outcome_cutoff=106, order=ORDER, payload=PAYLOAD
    )
    assert marked.count() == 0


def _random_case(spark, seed):
    rng = random.Random(seed)
    decisions = [(f"t{i}", i, 1, rng.randint(5, 20), rng.randint(0, 3)) for i in range(20)]
    facts, seen = [], set()
    for i in range(1500):
        token = "t0" if rng.random() < 0.4 else f"t{rng.randint(0, 24)}"
        position = (rng.randint(0, 40), rng.randint(0, 4), rng.randint(0, 30))
        if (token, position) in seen:
            continue
        seen.add((token, position))
        facts.append((token, *position, position[0] * 10, rng.random() + 0.1, rng.random() + 0.1))
    return decisions, facts


@pytest.mark.parametrize("rows_per_task", [None, 20])
def test_asof_equals_brute_force_with_and_without_splitting(spark, rows_per_task):
    decisions, facts = _random_case(spark, 7)
    d, t = spark.createDataFrame(decisions, DECISIONS), trades(spark, facts)
    entries = asof.first_at_or_after(d, t, order=ORDER, payload=PAYLOAD, rows_per_task=rows_per_task)
    found = {
        (r.token_address, r.requested_delay_slots): (r.entry_block_slot, r.entry_tx_index, r.entry_event_index)
        for r in entries.collect()
    }
    wanted = {}
    for token, _, _, slot, tx in decisions:
        for delay in (0, 1, 2):
            later = [
                f[1:4] for f in facts
                if f[0] == token and f[1] >= slot + delay and (f[1] > slot or f[2] > tx)
            ]
            wanted[token, delay] = min(later) if later else (None, None, None)
    assert found == wanted
    exits = asof.last_within_hold(
        entries.where("covered"), t, hold_seconds=60, order=ORDER, payload=PAYLOAD, outcome_cutoff=350,
        rows_per_task=rows_per_task,
    )
    for r in exits.collect():
        inside = [
            f[1:4] for f in facts
            if f[0] == r.token_address
            and f[1:4] >= (r.entry_block_slot, r.entry_tx_index, r.entry_event_index)
            and f[4] <= r.entry_block_time + 60 and f[4] < 350
        ]
        assert (r.exit_block_slot, r.exit_tx_index, r.exit_event_index) == (max(inside) if inside else (None,) * 3)


def test_hot_keys_are_bounded_and_split(spark):
    rows = [("hot", i) for i in range(600)] + [(f"k{i}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v long")
    hot = hot_keys(df, ["k"], rows_per_task=100)
    assert [(r.k, r._splits) for r in hot.collect()] == [("hot", 6)]
    assert hot_keys(df, ["k"], rows_per_task=1000) is None
    assert hot_keys(df, ["k"]) is None
    small = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, w long")
    joined = join_unique(df, small, ["k"], rows_per_task=100)
    assert joined.count() == 601
    assert join_unique(df, small, ["k"], "left", rows_per_task=100).count() == 1000


def test_exact_copies_of_one_fact_spread_over_pieces(spark):
    copies = spark.range(0, 1000, 1, 4).select(F.lit("hot").alias("k"), F.lit(1).alias("v"))
    small = spark.createDataFrame([("hot", 1)], "k string, w long")
    assert join_unique(copies, small, ["k"], rows_per_task=100).count() == 1000


def test_entries_and_exit_marks_exchange_the_facts_once(spark, sf_dir):
    """Lookups chained in one plan read one exchange of the facts: the table of the facts is scanned once."""
    from catalog.asof_queries import marked_rows

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = marked_rows(spark, sf_dir)
        rows.collect()
        final = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "ReusedExchange" in final
    assert len([line for line in final.splitlines() if "Scan parquet" in line and "l_orderkey" in line]) == 1


def test_crowded_slots_without_a_hot_key_give_none(spark, monkeypatch):
    """Only single keys are hot: many keys in one slot make it crowded, but none of them is split."""
    monkeypatch.setattr("tidemark.operators.skew.MIN_SLOTS", 1)
    monkeypatch.setattr("tidemark.operators.skew.MAX_SLOTS", 1)
    even = spark.range(400).select((F.col("id") % 40).alias("k"))
    assert hot_keys(even, ["k"], rows_per_task=100) is None
    hot = hot_keys(even.unionAll(spark.range(350).select(F.lit(7).cast("long").alias("k"))), ["k"], rows_per_task=100)
    assert [tuple(r) for r in hot.collect()] == [(7, 4)]
