"""Domain tables derived from the given tables, once as DataFrames and once as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clock import time_to_epoch
from tidemark.sources.tables import spread

# Position of a trade: month slot, day, line, then part and supplier to break the remaining ties.
ORDER = ("block_slot", "block_time", "tx_index", "part_key", "supp_key")
PAYLOAD = ("side", "price_usd", "price_sol")
HOLD_SECONDS = 30 * 86_400
# 2001-01-01T00:00:00Z, the outcome cutoff of the backtests.
CUTOFF = 978_307_200
# 2024-01-16T00:00:00Z and 2024-01-24T00:00:00Z bound the wallet development window.
WALLET_TRAIN_END = 1_705_363_200
WALLET_HOLDOUT = 1_706_054_400
NOTIONAL = 100.0
FEE_GRID = {"gross": 0.0, "training_median_fee": 300.0, "training_p90_fee": 700.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_slot(time: str) -> Column:
    return ((F.year(time) - 1995) * 12 + F.month(time) - 1).cast("long")


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("token_address"),
        F.col("o_custkey").alias("tx_signer"),
        month_slot("o_orderdate").alias("block_slot"),
        time_to_epoch("o_orderdate").alias("block_time"),
        F.pmod("o_orderkey", F.lit(4)).cast("int").alias("tx_index"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        time_to_epoch("o_orderdate").alias("decision_time"),
        "o_totalprice",
        "o_orderpriority",
        "o_orderstatus",
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deployments(spark, sf_dir).select(
        "token_address",
        "decision_time",
        "label",
        F.col("block_time").alias("deploy_block_time"),
        F.col("block_slot").alias("deploy_block_slot"),
        F.col("tx_index").alias("deploy_tx_index"),
    )


def weighted_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).withColumn(
        "population_weight", F.when(F.col("label") == 0, F.lit(25.0)).otherwise(F.lit(1.0))
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("token_address"),
        month_slot("l_shipdate").alias("block_slot"),
        time_to_epoch("l_shipdate").alias("block_time"),
        F.col("l_linenumber").alias("tx_index"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("l_returnflag").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_usd"),
        F.col("l_extendedprice").alias("price_sol"),
    )


def wallet(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "click", "sell")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", k)
        .select(
            F.col("user_id").alias("token_address"),
            F.col("event_id").alias("tx_hash"),
            time_to_epoch("ts").alias("timestamp"),
            kind.otherwise(F.col("event_type")).alias("event_type"),
            F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("S"), (F.col("event_id") % 5).cast("string"))).alias(
                "token_symbol"
            ),
            F.col("value").alias("cost_usd"),
            (F.col("k") / 100.0).alias("gas_usd"),
            ((F.col("event_id") % 10) / 100.0).alias("dex_usd"),
            (F.col("k") / 100.0).alias("gas_native"),
            ((F.col("k") % 7) / 100.0).alias("priority_fee"),
            ((F.col("k") % 3) / 100.0).alias("tip_fee"),
            (F.col("event_id") % 50 + 1).cast("double").alias("token_amount"),
            F.when(F.col("k") % 2 == 0, 1).otherwise(0).alias("is_open_or_close"),
        )
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("token_address"),
        F.col("quality").alias("label"),
        (F.col("n_chars") / (F.col("n_chars") + 500.0)).alias("probability"),
        F.when(F.col("quality") == 0, F.lit(25.0)).otherwise(F.lit(1.0)).alias("population_weight"),
        F.col("toxic"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles per event type; the decision lies one day after the start of the data."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("token_address"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"),
        "ts",
        "event_id",
        "value",
    )
    seconds = F.unix_seconds("hour")
    return (
        events.groupBy("token_address", "hour")
        .agg(
            F.min(F.struct("ts", "event_id", "value")).alias("f"),
            F.max(F.struct("ts", "event_id", "value")).alias("l"),
            F.max("value").alias("high_mcap"),
            F.min("value").alias("low_mcap"),
            F.sum(F.col("value").cast("decimal(28,10)")).cast("double").alias("volume"),
            F.count(F.lit(1)).cast("double").alias("amount"),
        )
        .select(
            "token_address",
            F.lit("1h").alias("resolution"),
            F.lit(1_704_153_600_000).alias("deploy_time_ms"),
            F.lit(1_704_153_600).cast("long").alias("deploy_time_s"),
            (seconds * 1000).alias("candle_time_ms"),
            seconds.alias("candle_time_s"),
            F.col("f.value").alias("open_mcap"),
            "high_mcap",
            "low_mcap",
            F.col("l.value").alias("close_mcap"),
            "volume",
            "amount",
        )
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested JSON document per text: lines become instructions, words accounts, sentences log messages."""
    d = spread(table(spark, sf_dir, "documents"))
    uri = F.concat(
        F.when(F.col("doc_id") % 2 == 0, F.lit("IPFS://")).otherwise(F.lit("https://")), F.col("source")
    )
    info = F.struct(uri.alias("uri"), F.col("lang").alias("name"), F.col("source").alias("symbol"))
    metadata = F.struct(
        F.when(F.col("doc_id") % 3 != 0, F.lit("initializeTokenMetadata")).otherwise(F.lit("transfer")).alias("type"),
        info.alias("info"),
    )
    other = F.struct(F.lit("transfer").alias("type"), info.alias("info"))
    item = lambda p: F.struct(p.alias("parsed"))
    no_items = F.lit(None).cast("array<struct<parsed:struct<type:string,info:struct<uri:string,name:string,symbol:string>>>>")
    inner = F.array(
        F.struct(F.array(item(other), item(metadata)).alias("instructions")),
        F.struct(no_items.alias("instructions")),
        F.struct(F.array(item(metadata)).alias("instructions")),
    )
    keep = lambda rule, value: F.when(rule, value)
    meta = F.struct(
        keep(F.col("doc_id") % 5 != 0, F.col("n_chars") * 10).alias("fee"),
        F.col("n_chars").alias("computeUnitsConsumed"),
        (F.col("n_chars") + 1).alias("costUnits"),
        keep(F.col("doc_id") % 11 == 0, F.struct(F.lit("failed").alias("reason"))).alias("err"),
        inner.alias("innerInstructions"),
        keep(F.col("doc_id") % 4 != 0, F.array(F.col("n_chars") * 100, F.lit(1).cast("long"))).alias("preBalances"),
        F.array(F.col("n_chars") * 90, F.lit(2).cast("long")).alias("postBalances"),
        F.split("text", "e").alias("preTokenBalances"),
        F.split("text", "a").alias("postTokenBalances"),
        F.split("text", r"\. ").alias("logMessages"),
    )
    transaction = F.struct(
        F.struct(
            F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("data"))).alias("instructions"),
            F.split("text", " ").alias("accountKeys"),
        ).alias("message"),
        F.array_repeat(F.lit("s"), F.pmod("doc_id", F.lit(3)).cast("int")).alias("signatures"),
    )
    document = F.struct(
        (F.col("doc_id") * 3600 + 1_780_272_000).alias("blockTime"),
        F.col("doc_id").alias("slot"),
        F.pmod("doc_id", F.lit(7)).alias("transactionIndex"),
        transaction.alias("transaction"),
        meta.alias("meta"),
    )
    return d.select((F.col("doc_id") + 1).alias("line_number"), F.to_json(document).alias("value"))


# The same tables as SQL.
DEPLOYMENTS_SQL = """deployments AS (
    SELECT o_orderkey AS token_address, o_custkey AS tx_signer,
           CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS block_slot,
           CAST(floor(epoch(o_orderdate)) AS BIGINT) AS block_time,
           CAST(o_orderkey % 4 AS INTEGER) AS tx_index,
           CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
           CAST(floor(epoch(o_orderdate)) AS BIGINT) AS decision_time,
           CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 25.0 END::DOUBLE AS population_weight,
           o_totalprice, o_orderpriority, o_orderstatus
    FROM orders)"""
TRADES_SQL = """trades AS (
    SELECT l_orderkey AS token_address,
           CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS BIGINT) AS block_slot,
           CAST(floor(epoch(l_shipdate)) AS BIGINT) AS block_time,
           l_linenumber AS tx_index, l_partkey AS part_key, l_suppkey AS supp_key, l_returnflag AS side,
           l_extendedprice / l_quantity AS price_usd, l_extendedprice AS price_sol
    FROM lineitem)"""
WALLET_SQL = """wallet AS (
    SELECT user_id AS token_address, event_id AS tx_hash, CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp",
           CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'click' THEN 'sell' ELSE event_type END AS event_type,
           CASE WHEN event_id % 3 <> 0 THEN 'S' || CAST(event_id % 5 AS VARCHAR) END AS token_symbol,
           value AS cost_usd, CAST(k AS DOUBLE) / 100.0::DOUBLE AS gas_usd,
           CAST(event_id % 10 AS DOUBLE) / 100.0::DOUBLE AS dex_usd,
           CAST(k AS DOUBLE) / 100.0::DOUBLE AS gas_native, CAST(k % 7 AS DOUBLE) / 100.0::DOUBLE AS priority_fee,
           CAST(k % 3 AS DOUBLE) / 100.0::DOUBLE AS tip_fee, CAST(event_id % 50 + 1 AS DOUBLE) AS token_amount,
           CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS is_open_or_close
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""
SCORED_SQL = """scored AS (
    SELECT doc_id AS token_address, quality AS label,
           CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + 500.0::DOUBLE) AS probability,
           CASE WHEN quality = 0 THEN 25.0 ELSE 1.0 END::DOUBLE AS population_weight, toxic
    FROM documents JOIN labels USING (doc_id))"""
BARS_SQL = """bars AS (
    SELECT event_type AS token_address, '1h' AS resolution, 1704153600000::BIGINT AS deploy_time_ms,
           1704153600::BIGINT AS deploy_time_s,
           CAST(epoch(date_trunc('hour', ts)) AS BIGINT) * 1000 AS candle_time_ms,
           CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS candle_time_s,
           first(value ORDER BY ts, event_id) AS open_mcap, max(value) AS high_mcap, min(value) AS low_mcap,
           last(value ORDER BY ts, event_id) AS close_mcap, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS volume,
           CAST(count(*) AS DOUBLE) AS amount
    FROM events GROUP BY event_type, date_trunc('hour', ts))"""
RAW_SQL = """raw AS (
    SELECT doc_id + 1 AS line_number, doc_id * 3600 + 1780272000 AS decision_epoch, doc_id AS block_slot,
           doc_id % 7 AS transaction_index,
           CASE WHEN doc_id % 5 <> 0 THEN n_chars * 10 END AS tx_fee_lamports,
           CASE WHEN doc_id % 5 <> 0 THEN greatest(0, n_chars * 10 - 5000 * greatest(1, doc_id % 3)) END
               AS priority_fee_lamports,
           n_chars AS compute_units, n_chars + 1 AS cost_units,
           len(string_split(text, chr(10))) AS outer_instruction_count, 3 AS inner_instruction_count,
           len(string_split(text, ' ')) AS account_count, doc_id % 3 AS signature_count,
           len(string_split(text, '. ')) AS log_message_count,
           len(string_split(text, 'e')) AS pre_token_balance_count,
           len(string_split(text, 'a')) AS post_token_balance_count,
           CASE WHEN doc_id % 4 <> 0 THEN n_chars * 90 - n_chars * 100 END AS signer_lamport_delta,
           CASE WHEN doc_id % 3 <> 0 THEN length(lang) ELSE 0 END AS metadata_name_length,
           CASE WHEN doc_id % 3 <> 0 THEN length(source) ELSE 0 END AS metadata_symbol_length,
           CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN 7 + length(source) ELSE 8 + length(source) END
               AS metadata_uri_length,
           CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN 1 ELSE 0 END AS metadata_uri_is_ipfs,
           CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END AS metadata_present,
           CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS transaction_error
    FROM documents)"""


def first_entries_sql(decisions: str = "deployments") -> str:
    """Entries at delays 0, 1 and 2 by ranking all later trades."""
    return f"""candidates AS (
    SELECT d.token_address, g.delay, t.*,
           row_number() OVER (PARTITION BY d.token_address, g.delay
               ORDER BY t.block_slot, t.block_time, t.tx_index, t.part_key, t.supp_key) AS rn
    FROM {decisions} d CROSS JOIN (VALUES (0), (1), (2)) g(delay)
    JOIN trades t ON t.token_address = d.token_address AND t.block_slot >= d.block_slot + g.delay
     AND (t.block_slot > d.block_slot OR t.tx_index > d.tx_index)),
entries AS (
    SELECT d.token_address, d.decision_time, d.label, d.population_weight, d.block_slot AS deploy_block_slot,
           d.tx_index AS deploy_tx_index, g.delay AS requested_delay_slots,
           d.block_slot + g.delay AS target_entry_slot, c.rn IS NOT NULL AS covered,
           c.block_slot AS entry_block_slot, c.block_time AS entry_block_time, c.tx_index AS entry_tx_index,
           c.part_key AS entry_part_key, c.supp_key AS entry_supp_key, c.side AS entry_side,
           c.price_usd AS entry_price_usd, c.price_sol AS entry_price_sol,
           c.block_slot - d.block_slot AS actual_delay_slots,
           c.block_slot - (d.block_slot + g.delay) AS wait_slots_beyond_target
    FROM {decisions} d CROSS JOIN (VALUES (0), (1), (2)) g(delay)
    LEFT JOIN candidates c ON c.token_address = d.token_address AND c.delay = g.delay AND c.rn = 1)"""


def marks_sql(entries: str = "entries") -> str:
    """Exit marks and returns of entries whose hold ends before the cutoff."""
    return f"""eligible AS (
    SELECT *, entry_block_time + {HOLD_SECONDS} AS exit_target_time FROM {entries}
    WHERE covered AND entry_block_time + {HOLD_SECONDS} < {CUTOFF}),
exits AS (
    SELECT e.token_address, e.requested_delay_slots, t.block_slot AS exit_block_slot, t.block_time AS exit_block_time,
           t.tx_index AS exit_tx_index, t.part_key AS exit_part_key, t.supp_key AS exit_supp_key,
           t.price_usd AS exit_price_usd,
           row_number() OVER (PARTITION BY e.token_address, e.requested_delay_slots
               ORDER BY t.block_slot DESC, t.block_time DESC, t.tx_index DESC, t.part_key DESC, t.supp_key DESC) AS rn
    FROM eligible e JOIN trades t ON t.token_address = e.token_address
     AND (t.block_slot, t.block_time, t.tx_index, t.part_key, t.supp_key)
         >= (e.entry_block_slot, e.entry_block_time, e.entry_tx_index, e.entry_part_key, e.entry_supp_key)
     AND t.block_time <= e.entry_block_time + {HOLD_SECONDS} AND t.block_time < {CUTOFF}),
marked AS (
    SELECT e.*, x.exit_block_slot, x.exit_block_time, x.exit_tx_index, x.exit_part_key, x.exit_supp_key,
           x.exit_price_usd, x.exit_price_usd / e.entry_price_usd - 1 AS gross_return,
           e.exit_target_time - x.exit_block_time AS mark_staleness_seconds
    FROM eligible e JOIN exits x USING (token_address, requested_delay_slots) WHERE x.rn = 1)"""
