import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import clock, derived, guards
from tidemark.functions.transaction import FEATURE_COLUMNS, transaction_features
from tidemark.operators.profiles import clock_mismatch


def column(df, name):
    return [r[name] for r in df.select(name).collect()]


def test_rate_batching_intensity_payload_outflow(spark):
    rate = spark.createDataFrame(
        [(0, None), (2, 0.0), (10, 5 * 86400.0), (4, 2 * 86400.0)],
        "creator_prior_deploy_count long, creator_observed_age_seconds double",
    )
    assert column(derived.add_deployment_rate(rate), "creator_prior_deploys_per_observed_day") == [0, 2, 2, 2]
    batching = spark.createDataFrame(
        [(0, 0), (2, 2), (10, 5), (4, 1)], "creator_prior_deploy_count long, creator_prior_active_slot_count long"
    )
    assert column(derived.add_slot_batching(batching), "creator_prior_deploys_per_active_slot") == [0, 1, 2, 4]
    fees = spark.createDataFrame([(0, 10), (100, 20), (75, 25)], "priority_fee_lamports long, compute_units long")
    assert column(derived.add_fee_intensity(fees), "priority_fee_lamports_per_compute_unit") == [0, 5, 3]
    uris = spark.createDataFrame([(0, 0), (48, 0), (55, 1), (80, 1)], "metadata_uri_length int, metadata_uri_is_ipfs int")
    assert column(derived.add_uri_payload_length(uris), "metadata_uri_payload_length") == [0, 48, 48, 73]
    flows = spark.createDataFrame([(-100, 5), (-3, 5), (20, 5)], "signer_lamport_delta long, tx_fee_lamports long")
    assert column(derived.add_nonfee_outflow(flows), "deployment_signer_nonfee_outflow_lamports") == [95, 0, 0]


@pytest.mark.parametrize(
    "add,schema,bad",
    [
        (derived.add_deployment_rate, "creator_prior_deploy_count long, creator_observed_age_seconds double",
         [(None, 1.0), (-1, 1.0), (1, -1.0), (1, None)]),
        (derived.add_slot_batching, "creator_prior_deploy_count long, creator_prior_active_slot_count long",
         [(None, 1), (1, None), (-1, 0), (1, 2), (2, 0), (0, 1)]),
        (derived.add_fee_intensity, "priority_fee_lamports long, compute_units long",
         [(None, 1), (1, None), (1, 0), (1, -1), (-1, 1)]),
        (derived.add_uri_payload_length, "metadata_uri_length int, metadata_uri_is_ipfs int",
         [(None, 0), (1, None), (-1, 0), (9, 2), (3, 1)]),
        (derived.add_nonfee_outflow, "signer_lamport_delta long, tx_fee_lamports long", [(None, 1), (1, None)]),
    ],
)
def test_bad_inputs_stop_the_job(spark, add, schema, bad):
    for row in bad:
        with pytest.raises(PySparkException):
            add(spark.createDataFrame([row], schema)).collect()
    with pytest.raises(ValueError, match="missing"):
        add(spark.range(1))


def test_fee_rate_drops_nonfinite_and_negative(spark):
    df = spark.createDataFrame(
        [("1", "1", "100"), (None, None, "100"), ("1", "1", "0"), ("1", "0", "-5"), ("x", "1", "100")],
        "gas_usd string, dex_usd string, cost_usd string",
    )
    assert column(df.select(derived.fee_rate_bps().alias("r")), "r") == [200.0, 0.0, None, None, 100.0]


def test_utc_clock_and_monday_zero(spark):
    df = spark.createDataFrame(
        [("2026-01-01T00:00:59Z",), ("2026-03-09T23:15:00Z",)], "s string"
    ).select(F.col("s").cast("timestamp").alias("decision_time"))
    rows = clock.add_utc_clock(df).collect()
    assert [(r.decision_hour_utc, r.decision_weekday_utc) for r in rows] == [(0, 3), (23, 0)]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="UTC"):
            clock.add_utc_clock(df)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    missing = spark.createDataFrame([(None,)], "decision_time timestamp")
    with pytest.raises(PySparkException):
        clock.add_utc_clock(missing).collect()


def test_clock_mismatch_reports_offsets(spark):
    df = spark.createDataFrame([(0, 3, 1, 0, 1), (0, 1, 1, 22, 2), (1, 5, 5, 5, 5)], "label int, sh int, sw int, h int, w int")
    rows = {r.label: r for r in clock_mismatch(df, stored_hour="sh", stored_weekday="sw", hour="h", weekday="w").collect()}
    assert (rows[0].hour_mismatch_rows, rows[0].weekday_mismatch_rows, rows[0].hour_offsets) == (2, 1, "3")
    assert rows[1].hour_offsets == "0"


def document(**changes):
    base = {
        "blockTime": 1_767_225_600, "slot": 9, "transactionIndex": 4,
        "transaction": {
            "message": {"instructions": [{"a": 1}, {"b": [2]}], "accountKeys": ["x", {"pubkey": "y"}, "z"]},
            "signatures": ["s1", "s2"],
        },
        "meta": {
            "fee": 25_000, "computeUnitsConsumed": 70, "costUnits": 80, "err": None,
            "innerInstructions": [
                {"index": 0},
                {"instructions": [
                    {"parsed": "plain text"},
                    {"data": "no parsed part"},
                    {"parsed": {"type": "initializeTokenMetadata",
                                "info": {"uri": "IPFS://abc", "name": "Näme", "symbol": "SY"}}},
                    {"parsed": {"type": "initializeTokenMetadata", "info": {"uri": "http://second", "name": "no"}}},
                ]},
            ],
            "preBalances": [100, 5], "postBalances": [40], "preTokenBalances": [], "postTokenBalances": [{"q": 1}],
            "logMessages": ["l1", "l2"],
        },
    }
    base.update(changes)
    return json.dumps(base)


def features(spark, *documents):
    df = spark.createDataFrame([(i + 1, d) for i, d in enumerate(documents)], "line_number long, value string")
    out = transaction_features(df)
    assert out.columns == ["line_number", *FEATURE_COLUMNS]
    return out.orderBy("line_number").collect()


def test_full_document(spark):
    (r,) = features(spark, document())
    assert (r.decision_epoch, r.block_slot, r.transaction_index) == (1_767_225_600, 9, 4)
    assert (r.tx_fee_lamports, r.priority_fee_lamports, r.compute_units, r.cost_units) == (25_000, 15_000, 70, 80)
    assert (r.outer_instruction_count, r.inner_instruction_count, r.account_count, r.signature_count) == (2, 4, 3, 2)
    assert (r.log_message_count, r.pre_token_balance_count, r.post_token_balance_count) == (2, 0, 1)
    assert r.signer_lamport_delta == -60
    assert (r.metadata_name_length, r.metadata_symbol_length, r.metadata_uri_length) == (4, 2, 10)
    assert (r.metadata_uri_is_ipfs, r.metadata_present, r.transaction_error) == (1, 1, 0)


def test_sparse_documents(spark):
    rows = features(
        spark,
        "{}",
        document(meta=None, transaction=None),
        document(meta={"fee": 3000, "err": {"InstructionError": [1, "x"]}, "preBalances": [], "postBalances": [4]},
                 transaction={"signatures": []}),
        document(meta={"fee": None, "innerInstructions": [{"instructions": [
            {"parsed": {"type": "initializeTokenMetadata", "info": {}}}]}]}),
        document(meta={"innerInstructions": [{"instructions": [{"parsed": {"type": "transfer", "info": {"uri": "u"}}}]}]}),
    )
    for r in rows[:2]:
        assert r.tx_fee_lamports is None and r.priority_fee_lamports is None and r.signer_lamport_delta is None
        assert r.outer_instruction_count == r.inner_instruction_count == r.signature_count == r.metadata_present == 0
    assert rows[0].decision_epoch is None
    assert (rows[2].priority_fee_lamports, rows[2].transaction_error, rows[2].signer_lamport_delta) == (0, 1, None)
    assert (rows[3].metadata_present, rows[3].metadata_uri_length, rows[3].priority_fee_lamports) == (0, 0, None)
    assert (rows[4].metadata_present, rows[4].inner_instruction_count) == (0, 1)


def test_extraction_accepts_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "part.txt").write_text(document() + "\n" + document(slot=10) + "\n")
    stream = spark.readStream.schema("value string").text(str(source))
    rows = transaction_features(stream).where(F.pmod("block_slot", F.lit(2)) == 0)
    running = rows.writeStream.format("memory").queryName("extracted").trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert [r.block_slot for r in spark.table("extracted").collect()] == [10]


def test_name_guards_and_feature_lists(spark):
    guards.require_pre_decision_names(["creator_prior_deploy_count"])
    with pytest.raises(ValueError, match="forbidden"):
        guards.require_pre_decision_names(["X_Future_Return_5"])
    df = spark.createDataFrame([(1, "a", True, 2.0)], "label int, token_address string, flag boolean, x double")
    assert guards.numeric_features(df) == ["flag", "x"]
    assert guards.replace_feature(["a", "b"], "b", "c") == ["a", "c"]
    assert guards.add_feature(["a"], "b") == ["a", "b"]
    with pytest.raises(ValueError):
        guards.replace_feature(["a"], "b", "c")
    with pytest.raises(ValueError):
        guards.add_feature(["a"], "a")
    with pytest.raises(ValueError, match="more than one group"):
        guards.require_feature_groups({"g": ["a"], "h": ["a"]}, ["a"])
    with pytest.raises(ValueError, match="fit"):
        guards.require_feature_groups({"g": ["a"]}, ["a", "b"])
    times = spark.createDataFrame([(1, 1), (2, 3)], "history long, decision long")
    guards.require_history_before_decision(times, "history", "decision")
    with pytest.raises(ValueError, match="1 rows"):
        guards.require_history_before_decision(times, "decision", "history")


def test_permutation_proof_holds_no_sums_for_each_receiver(spark, sf_dir):
    from catalog.learned_queries import permutation_proof

    plan = permutation_proof(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    keyed = [line for line in plan.splitlines() if "HashAggregate(keys=[name" in line and "token_address" in line.split("functions=")[0]]
    assert keyed
    assert all("functions=[]" in line for line in keyed)
