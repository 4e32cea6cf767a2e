import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import guards
from tidemark.operators import joins, quality
from tidemark.plans.dataset import combine_classes, labelled_features, with_history
from tidemark.sources import schemas, sinks, tables


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_contracts_reject_drift(spark):
    for schema, size in ((schemas.TRADES, 26), (schemas.CANDLES, 12), (schemas.ENTRY_PRICES, 21)):
        assert len(schema) == size
        df = empty(spark, schema)
        guards.require_schema(df, schema)
        first, second, *rest = df.columns
        for drifted in (
            df.drop(first),
            df.select(second, first, *rest),
            df.withColumn(first, F.col(first).cast("binary")),
            df.withColumn("extra", F.lit(1)),
        ):
            with pytest.raises(ValueError, match="contract"):
                guards.require_schema(drifted, schema)
    assert guards.has_columns(empty(spark, schemas.TRADES), schemas.SLOT_DELAY_COLUMNS)
    assert not guards.has_columns(empty(spark, schemas.CANDLES), schemas.SLOT_DELAY_COLUMNS)


def test_full_trade_and_candle_audit(spark):
    good = dict(
        token_address="A", slot_index_id="000000000101" + "000001" + "0000", block_slot=101, tx_index=1, event_index=0,
        tx_hash="h", timestamp="1970-01-01T00:01:40Z", block_time=100, user_address="u", side="buy", program="pump",
        price_usd=1.0, price_sol=0.1, amount_usd=None, amount_sol=None, base_amount=1.0, quote_amount=1.0,
        quote_mint=quality.QUOTE_MINT, base_decimals=6, quote_decimals=9, deploy_block_time=90, deploy_block_slot=100,
        deploy_tx_index=0, deploy_tx_hash="d", deploy_tx_signer="s", creator_address="c",
    )
    bad = {**good, "slot_index_id": "1", "timestamp": "1970-01-01T00:01:41Z", "side": "swap", "program": "other",
           "price_usd": 0.0, "base_amount": 0.0, "quote_amount": -1.0, "quote_mint": "x", "block_slot": 99,
           "deploy_tx_hash": None}
    names = schemas.TRADES.names
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in (good, bad)], schemas.TRADES)
    report = quality.trade_audit(df, sides=quality.SIDES, programs=quality.PROGRAMS)
    row = report.first()
    for name in ("slot_index_encoding_mismatch_rows", "timestamp_mismatch_rows", "invalid_side_rows",
                 "invalid_program_rows", "nonpositive_price_or_base_rows", "negative_amount_rows",
                 "noncanonical_quote_rows", "pre_deploy_position_rows", "slot_plus_1_rows", "slot_plus_1_tokens"):
        assert row[name] == 1, name
    assert row.creator_signer_difference_rows == 2 and row.unique_tokens == 1
    context = ["deploy_block_time", "deploy_block_slot", "deploy_tx_index", "deploy_tx_hash", "deploy_tx_signer"]
    assert quality.keys_with_several_contexts(df, "token_address", context, "n").first().n == 1
    present = [n for n in quality.GUARDED_TRADE_COUNTERS if n in report.columns]
    status = quality.issues(report, present).first()
    assert status.source_validation_status == "requires_explicit_filters" and "invalid_side_rows" in status.quality_issues
    clean = quality.trade_audit(df.where("side = 'buy'"), sides=quality.SIDES, programs=quality.PROGRAMS)
    assert quality.issues(clean, present).first().source_validation_status == "passed"
    nulls = {r.column_name: r.null_rows for r in quality.null_report(df).collect()}
    assert nulls["amount_usd"] == 2 and nulls["deploy_tx_hash"] == 1 and nulls["side"] == 0
    from tidemark.plans.audits import audit_candles, audit_trades

    whole = audit_trades(df, key=["slot_index_id"]).first()
    assert whole.tokens_with_multiple_deploy_contexts == 1 and whole.duplicate_key_groups == 0
    assert whole.quality_issues.startswith("unexpected_null_values,null_amount_fields_require_size_filter")
    assert whole.exact_slot_delay_supported
    bars = spark.createDataFrame(
        [("A", "1s", 1000, 1, 500, 0, 1.0, 2.0, 3.0, 5.0, -1.0, 1.0)], schemas.CANDLES
    )
    audit = quality.bar_audit(bars).first()
    assert (audit.pre_deploy_rows, audit.minimum_pre_deploy_delta_ms, audit.invalid_ohlc_rows) == (1, -500, 1)
    assert (audit.second_alignment_violations, audit.negative_flow_rows, audit.pre_deploy_tokens) == (1, 1, 1)
    found = audit_candles(bars.unionAll(bars)).first()
    assert found.quality_issues == (
        "pre_deploy_candles_require_exclusion,second_timestamp_alignment,invalid_ohlc,negative_volume_or_amount,"
        "duplicate_token_resolution_time_keys"
    )
    assert not found.exact_slot_delay_supported


def write_lines(path, documents):
    with gzip.open(path, "wt", encoding="utf-8") as handle:
        for d in documents:
            handle.write(json.dumps(d) + "\n")
    return str(path)


def test_gzip_lines_are_numbered_and_sampled(spark, tmp_path):
    path = write_lines(tmp_path / "raw.jsonl.gz", [{"slot": i, "blockTime": 1_767_225_600 + i} for i in range(1, 101)])
    lines = tables.read_lines(spark, path, partitions=3)
    assert lines.rdd.getNumPartitions() == 3
    rows = lines.select("line_number", F.get_json_object("value", "$.slot").cast("long").alias("slot")).collect()
    assert len(rows) == 100 and all(r.line_number == r.slot for r in rows)
    sampled = tables.systematic_sample(lines, 25)
    assert sorted(r.line_number for r in sampled.collect()) == [25, 50, 75, 100]
    with pytest.raises(ValueError):
        tables.systematic_sample(lines, 0)
    with pytest.raises(ValueError):
        tables.read_lines(spark, "plain.jsonl")

    index = spark.createDataFrame(
        [(f"h{i}", i, 1_767_225_600 + i, i, f"t{i}", "s") for i in range(1, 101)],
        "tx_hash string, line_number long, block_time long, block_slot long, token_address string, tx_signer string",
    )
    negative = labelled_features(lines, index, 0, stride=25)
    positive = labelled_features(lines.where("line_number <= 3"), index, 1).withColumn("only_here", F.lit(1))
    both = combine_classes(positive, negative)
    assert both.count() == 7 and both.where("only_here is null").count() == 4
    thursday = both.where("token_address = 't1'").first()
    assert (thursday.decision_hour_utc, thursday.decision_weekday_utc, thursday.label) == (0, 3, 1)
    full = with_history(both, [index])
    assert {r.token_address: r.creator_prior_deploy_count for r in full.collect()}["t25"] == 24


def test_readers_see_the_old_or_the_new_version(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.publish(spark.range(10), path).count() == 10
    pinned = sinks.read_published(spark, path)

    def refuse(_):
        # While the new version is written and checked, a reader finds the old one.
        assert sinks.read_published(spark, path).count() == 10
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        sinks.publish(spark.range(3), path, check=refuse)
    assert sinks.read_published(spark, path).count() == 10
    checked = sinks.publish(spark.range(5), path, check=lambda df: joins.unique(df, ["id"]).count(), sort_within=["id"])
    assert checked.count() == sinks.read_published(spark, path).count() == 5 and pinned.count() == 10
    assert len([p for p in tmp_path.joinpath("out").iterdir() if p.name.startswith("CURRENT")]) == 1
    sinks.drop_versions(spark, path)
    assert sinks.read_published(spark, path).count() == 5
    assert len([p for p in tmp_path.joinpath("out").iterdir() if p.name.startswith("version-")]) == 1


def test_a_repeated_run_adds_no_ledger_row(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    for run, value in (("a", 1), ("b", 2), ("b", 2)):
        sinks.append_ledger(spark.createDataFrame([("e", value)], "experiment string, value int"), ledger, run)
    rows = spark.read.json(ledger).collect()
    assert sorted((r.run_id, r.value) for r in rows) == [("a", 1), ("b", 2)] and rows[0].recorded_at_utc


def test_lines_of_split_files_have_the_numbers_of_whole_ones(spark, tmp_path):
    texts = {"one.jsonl": [f"line {i} {'x' * (i % 50)}" for i in range(500)], "two.jsonl": ["", "only", ""], "none.jsonl": []}
    for name, rows in texts.items():
        (tmp_path / name).write_text("".join(r + "\n" for r in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(-(-(tmp_path / "one.jsonl").stat().st_size // 7)))
    try:
        found = tables.number_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    wanted = sorted((name, i + 1, r) for name, rows in texts.items() for i, r in enumerate(rows))
    assert sorted((r.file_path.rsplit("/", 1)[1], r.line_number, r.value) for r in found) == wanted


def test_files_in_order_of_names_are_one_text(spark, tmp_path):
    rows = [f"{i}" * (i % 90 + 1) for i in range(500)]
    for file, (lo, hi) in enumerate(((0, 120), (120, 120), (120, 500))):
        (tmp_path / f"part-{file}.txt").write_text("".join(f"{r}\n" for r in rows[lo:hi]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = tables.number_lines(spark, str(tmp_path), across_files=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line_number, r.value) for r in found) == [(i + 1, r) for i, r in enumerate(rows)]


def test_footers_answer_ranges_without_reading_rows(spark, sf_dir):
    out = tables.footer_ranges(spark, f"{sf_dir}/lineitem.parquet")
    assert "PushedAggregation: [MIN" in out._jdf.queryExecution().executedPlan().toString()
    row = out.where("column_name = 'l_quantity'").first()
    given = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.min("l_quantity"), F.max("l_quantity"), F.count("l_quantity")).first()
    assert (row.minimum, row.maximum, row.non_null_rows) == tuple(given)


def test_manifest_ignores_order_and_sees_changes(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    shuffled = df.repartition(7).orderBy(F.desc("v"))
    assert sinks.same_content(df, shuffled, "k")
    assert not sinks.same_content(df, df.withColumn("v", F.when(F.col("k") == 3, 0).otherwise(F.col("v"))), "k")
    assert not sinks.same_content(df, df.unionAll(df.where("k = 1")).unionAll(df.where("k = 1")), "k")
    expected = sinks.manifest(df, "k", {"odd": F.col("v") % 2 != 0})
    assert expected.first().odd == 0 and expected.first().unique_keys == 100
    assert sinks.verified(shuffled, expected, "k").count() == 100
    with pytest.raises(PySparkException, match="dataset manifest breaks its rules.*rows_differs"):
        sinks.verified(df.where("k > 0"), expected, "k").collect()
    ranges = {r.key_range: r.repeated for r in sinks.compare_ranges(df, shuffled, key="k").collect()}
    assert len(ranges) == 16 and all(ranges.values())
    other = df.withColumn("v", F.when(F.col("k") == 3, 0).otherwise(F.col("v")))
    assert [r.key_range for r in sinks.compare_ranges(df, other, key="k").collect() if not r.repeated] == ["e"]  # md5 of 3


def test_validated_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "k int, b string")
    assert joins.one_to_one(a, b, ["k"], keep_all_left=True).count() == 2
    with pytest.raises(PySparkException, match="lost"):
        joins.one_to_one(b, a, ["k"], keep_all_left=True).collect()
    with pytest.raises(PySparkException, match="left side is not unique"):
        joins.one_to_one(a.unionAll(a), b, ["k"]).collect()
    with pytest.raises(PySparkException, match="right side is not unique"):
        joins.one_to_one(a, b.unionAll(b), ["k"], "left").collect()
    holes = a.unionByName(spark.createDataFrame([(None, "n"), (None, "n")], "k int, a string"))
    assert joins.one_to_one(holes, b, ["k"], "left").count() == 4
    grid = b.where("k < 3").crossJoin(spark.range(3).withColumnRenamed("id", "d"))
    assert joins.one_to_many(a, grid, ["k"], 3).count() == 6
    with pytest.raises(PySparkException, match="3 joined rows"):
        joins.one_to_many(a, grid.where("d < 2"), ["k"], 3).collect()
    changed = b.withColumn("b", F.when(F.col("k") == 2, None).otherwise(F.col("b")))
    row = joins.compare_on_key(b, changed.where("k < 3"), ["k"], ["b"]).first()
    assert (row.matched_rows, row.unmatched_rows, row.b_mismatches) == (2, 1, 1)
    times = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1), (5, 0)], "t int, label int")
    assert sorted(r.t for r in joins.in_window(times, "t", F.col("label") == 1).collect()) == [2, 3, 4]


def test_read_table_checks_before_reading(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    contract = T.StructType([T.StructField("id", T.LongType())])
    assert tables.read_table(spark, path, contract=contract, required=["id"], view="ids").count() == 3
    assert spark.sql("SELECT count(*) AS n FROM ids").first().n == 3
    with pytest.raises(ValueError):
        tables.read_table(spark, path, required=["missing"])


def test_checkpoint_folder_of_the_session_is_used(spark):
    from tidemark.session import checkpoint_dir
    from tidemark.sources.scratch import materialise

    folder = checkpoint_dir(spark)
    assert checkpoint_dir(spark) == folder
    df = materialise(spark.range(5))
    assert df.count() == 5 and folder.split("/")[-1] in df.inputFiles()[0]


def test_trade_audit_reads_its_trades_once(spark, sf_dir):
    """Row and token counters come from one read of the trades; a row without token counts as a row only."""
    from catalog.quality_queries import wide_trades

    report = quality.trade_audit(wide_trades(spark, sf_dir), sides=("A", "N"), programs=quality.PROGRAMS)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Relation" in line and "l_orderkey" in line]) == 1
    schema = "token_address long, block_slot long, tx_index int, block_time long, deploy_block_slot long, deploy_tx_index int, deploy_block_time long, side string, price_usd double, price_sol double"
    rows = [(1, 6, 1, 60, 5, 0, 50, "buy", 1.0, 1.0), (1, 7, 1, 70, 5, 0, 50, "x", 1.0, 1.0), (None, 6, 1, 60, 5, 0, 50, "buy", 1.0, 1.0)]
    found = quality.trade_audit(spark.createDataFrame(rows, schema), sides=quality.SIDES).first()
    assert (found.rows, found.unique_tokens, found.slot_plus_1_rows, found.slot_plus_1_tokens, found.slot_plus_2_tokens) == (3, 1, 2, 1, 1)
    assert (found.min_block_time, found.max_block_slot, found.invalid_side_rows) == (60, 7, 1)
    none = quality.trade_audit(spark.createDataFrame([], schema), sides=quality.SIDES).first()
    assert (none.rows, none.unique_tokens, none.invalid_side_rows, none.min_block_time) == (0, 0, 0, None)
