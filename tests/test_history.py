import random

import pytest

from tidemark.operators import history, joins, quality

INDEX = "tx_hash string, line_number long, block_time long, block_slot long, token_address string, tx_signer string"


def index(spark, rows):
    return spark.createDataFrame(
        [(f"h{t}", i, time, slot, t, signer) for i, (t, signer, slot, time) in enumerate(rows)], INDEX
    )


def test_same_slot_siblings_share_their_past(spark):
    negative = index(
        spark,
        [
            ("token-1", "creator-a", 10, 100),
            ("token-2", "creator-a", 20, 200),
            ("token-3", "creator-a", 30, 200),
            ("token-4", "creator-a", 30, 200),
        ],
    )
    positive = index(spark, [("token-unrelated", "creator-b", 15, 150)])
    prior = history.prior_history([positive, negative])
    rows = history.attach_history(negative, prior, epoch="block_time").orderBy("token_address").collect()
    assert [r.creator_prior_deploy_count for r in rows] == [0, 1, 2, 2]
    assert [r.creator_prior_active_slot_count for r in rows] == [0, 1, 2, 2]
    assert [r.creator_seconds_since_previous_deploy for r in rows] == [None, 100, 0, 0]
    assert history.history_violations(prior).first().strict_time_violations == 0
    output = history.attach_history(negative, prior, epoch="block_time")
    change = joins.cardinality_change(negative, output, ["token_address"]).first()
    assert change.source_rows == change.output_rows == change.output_keys == 4
    assert set(quality.history_quality(output).first()) == {0}


@pytest.mark.parametrize("rows_per_task,buckets", [(None, None), (25, 8), (10, 16)])
def test_history_equals_brute_force_also_for_hot_signers(spark, rows_per_task, buckets):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        signer = "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 30)}"
        slot = rng.randint(0, 120)
        rows.append((f"t{i}", signer, slot, slot * 7 + rng.randint(0, 9)))
    table = index(spark, rows)
    prior = history.prior_history([table], rows_per_task=rows_per_task, buckets=buckets)
    found = {(r.tx_signer, r.block_slot): r for r in prior.collect()}
    assert len(found) == len({(s, slot) for _, s, slot, _ in rows})
    for (signer, slot), r in found.items():
        earlier = [(sl, t) for _, s, sl, t in rows if s == signer and sl < slot]
        times = {}
        for sl, t in earlier:
            times[sl] = min(t, times.get(sl, t))
        assert r.creator_prior_deploy_count == len(earlier)
        assert r.creator_prior_active_slot_count == len(times)
        assert r.creator_first_prior_deploy_time == (min(times.values()) if times else None)
        assert r.creator_first_prior_deploy_slot == (min(times) if times else None)
        assert r.creator_previous_deploy_slot == (max(times) if times else None)
        assert r.creator_previous_deploy_time == (times[max(times)] if times else None)
