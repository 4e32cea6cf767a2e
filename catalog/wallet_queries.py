from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.registry import query
from tidemark.functions.derived import fee_rate_bps
from tidemark.operators import cashflow
from tidemark.operators.quantiles import finite_summary
from tidemark.plans.audits import audit_wallet
from tidemark.plans.latency import entry_latency, latency_summary
from tidemark.sources.scratch import materialise

W = b.WALLET_SQL
TRADES_ONLY = "event_type IN ('buy', 'sell')"


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


SUMMARY_SQL = f"""summary AS (
    SELECT token_address, first(token_symbol ORDER BY "timestamp", tx_hash) FILTER (WHERE token_symbol IS NOT NULL)
               AS token_symbol,
           min("timestamp") AS first_event_time, max("timestamp") AS last_event_time,
           count(*) FILTER (WHERE event_type = 'buy') AS buy_transactions,
           count(*) FILTER (WHERE event_type = 'sell') AS sell_transactions,
           sum(cost_usd) FILTER (WHERE event_type = 'buy') AS gross_buy_usd,
           sum(cost_usd) FILTER (WHERE event_type = 'sell') AS gross_sell_usd,
           max("timestamp") - min("timestamp") AS hold_seconds
    FROM wallet WHERE {TRADES_ONLY} GROUP BY token_address)"""


@query(
    "wallet_summary",
    f"""WITH {W}, {SUMMARY_SQL}
    SELECT token_address, token_symbol, first_event_time, last_event_time, buy_transactions, sell_transactions,
           round(gross_buy_usd, 4) AS gross_buy_usd, round(gross_sell_usd, 4) AS gross_sell_usd,
           round(gross_sell_usd - gross_buy_usd, 4) AS gross_pnl_usd, hold_seconds FROM summary""",
)
def wallet_summary(spark, sf_dir):
    return rounded(
        cashflow.wallet_summary(b.wallet(spark, sf_dir)), ["gross_buy_usd", "gross_sell_usd", "gross_pnl_usd"], 4
    )


@query(
    "wallet_totals",
    f"""WITH {W}, {SUMMARY_SQL}
    SELECT (SELECT count(*) FROM wallet) AS row_count, (SELECT min("timestamp") FROM wallet) AS time_start,
           (SELECT max("timestamp") FROM wallet) AS time_end,
           (SELECT count(DISTINCT tx_hash) FROM wallet) AS transaction_count,
           count(token_address) AS unique_tokens_traded,
           count(*) FILTER (WHERE buy_transactions > 0) AS unique_tokens_bought,
           count(*) FILTER (WHERE sell_transactions > 1) AS tokens_with_multiple_sells,
           count(*) FILTER (WHERE sell_transactions = 0) AS tokens_without_observed_sell
    FROM summary""",
)
def wallet_totals(spark, sf_dir):
    wallet = b.wallet(spark, sf_dir)
    return cashflow.wallet_totals(wallet, cashflow.wallet_summary(wallet))


def _stats(measure, source):
    return f"""SELECT '{measure}' AS measure, count(v) AS count, round(avg(v), 6) AS mean,
        round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90
        FROM (SELECT CAST({measure} AS DOUBLE) AS v FROM {source})"""


@query(
    "wallet_finite_summary",
    f"""WITH {W}, {SUMMARY_SQL}, full_summary AS (SELECT *, gross_sell_usd - gross_buy_usd AS gross_pnl_usd FROM summary)
    {_stats('sell_transactions', 'full_summary')} UNION ALL {_stats('hold_seconds', 'full_summary')}
    UNION ALL {_stats('gross_pnl_usd', 'full_summary')}""",
)
def wallet_finite_summary(spark, sf_dir):
    summary = cashflow.wallet_summary(b.wallet(spark, sf_dir))
    return rounded(
        finite_summary(summary, ["sell_transactions", "hold_seconds", "gross_pnl_usd"]), ["mean", "median", "p90"]
    )


def _side(side, column):
    return f"coalesce(sum({column}) FILTER (WHERE event_type = '{side}'), 0)"


CASHFLOW_SQL = f"""raw_flows AS (
    SELECT token_address, min("timestamp") AS first_event_time, max("timestamp") AS last_event_time,
           min("timestamp") FILTER (WHERE event_type = 'buy') AS first_buy_time,
           max("timestamp") FILTER (WHERE event_type = 'sell') AS last_sell_time,
           count(*) FILTER (WHERE event_type = 'buy') AS buy_transactions,
           count(*) FILTER (WHERE event_type = 'sell') AS sell_transactions,
           bool_or(event_type = 'sell' AND is_open_or_close = 1) AS observed_close,
           {_side('buy', 'cost_usd')} AS gross_buy_usd, {_side('sell', 'cost_usd')} AS gross_sell_usd,
           {_side('buy', 'gas_usd')} AS buy_gas_usd, {_side('sell', 'gas_usd')} AS sell_gas_usd,
           {_side('buy', 'dex_usd')} AS buy_dex_usd, {_side('sell', 'dex_usd')} AS sell_dex_usd,
           {_side('buy', 'token_amount')} AS bought_token_amount, {_side('sell', 'token_amount')} AS sold_token_amount
    FROM wallet WHERE {TRADES_ONLY} GROUP BY token_address),
flows AS (
    SELECT *, buy_gas_usd + sell_gas_usd AS network_fee_usd, buy_dex_usd + sell_dex_usd AS dex_fee_usd,
           buy_gas_usd + sell_gas_usd + (buy_dex_usd + sell_dex_usd) AS total_fee_usd,
           gross_sell_usd - gross_buy_usd AS gross_pnl_usd,
           gross_sell_usd - gross_buy_usd - (buy_gas_usd + sell_gas_usd + buy_dex_usd + sell_dex_usd) AS net_pnl_usd,
           (gross_sell_usd - gross_buy_usd) / nullif(gross_buy_usd, 0) AS gross_roi,
           (gross_sell_usd - gross_buy_usd - (buy_gas_usd + sell_gas_usd + buy_dex_usd + sell_dex_usd))
               / nullif(gross_buy_usd, 0) AS net_roi,
           last_sell_time - first_buy_time AS hold_seconds,
           sold_token_amount / nullif(bought_token_amount, 0) AS inventory_exit_ratio
    FROM raw_flows),
closed AS (SELECT * FROM flows WHERE buy_transactions > 0 AND sell_transactions > 0 AND observed_close
    AND gross_buy_usd > 0)"""
_MONEY_COLUMNS = ["gross_buy_usd", "gross_sell_usd", "buy_gas_usd", "sell_gas_usd", "buy_dex_usd", "sell_dex_usd",
                  "network_fee_usd", "dex_fee_usd", "total_fee_usd", "gross_pnl_usd", "net_pnl_usd", "gross_roi",
                  "net_roi", "inventory_exit_ratio"]
_FLOW_KEEP = ["token_address", "first_event_time", "last_event_time", "first_buy_time", "last_sell_time",
              "buy_transactions", "sell_transactions", "observed_close", "bought_token_amount", "sold_token_amount",
              "hold_seconds"]


@query(
    "token_cashflow",
    f"WITH {W}, {CASHFLOW_SQL} SELECT {', '.join(_FLOW_KEEP)}, "
    + ", ".join(f"round({c}, 5) AS {c}" for c in _MONEY_COLUMNS)
    + " FROM flows",
)
def token_cashflow(spark, sf_dir):
    return rounded(cashflow.token_cashflow(b.wallet(spark, sf_dir)), _MONEY_COLUMNS, 5)


@query(
    "cashflow_checks",
    f"""WITH {W}, {CASHFLOW_SQL}
    SELECT (SELECT count(*) - count(DISTINCT tx_hash) FROM wallet WHERE {TRADES_ONLY}) AS duplicate_transaction_rows,
           (SELECT count(*) FROM wallet WHERE {TRADES_ONLY} AND (cost_usd IS NULL OR gas_usd IS NULL
                OR dex_usd IS NULL)) AS rows_with_missing_cash,
           (SELECT count(*) FROM wallet WHERE {TRADES_ONLY} AND (cost_usd < 0 OR gas_usd < 0 OR dex_usd < 0))
               AS rows_with_negative_cash,
           count(*) FILTER (WHERE first_event_time > last_event_time) AS reversed_event_times,
           count(*) FILTER (WHERE buy_transactions > 0 AND gross_buy_usd <= 0) AS bought_without_cost,
           count(*) FILTER (WHERE NOT isfinite(gross_buy_usd) OR NOT isfinite(gross_sell_usd)
               OR NOT isfinite(net_pnl_usd)) AS nonfinite_rows
    FROM flows""",
)
def cashflow_checks(spark, sf_dir):
    wallet = b.wallet(spark, sf_dir)
    return cashflow.cashflow_violations(wallet).crossJoin(
        cashflow.cashflow_integrity(cashflow.token_cashflow(wallet))
    )


def _q(column, p, name, digits=5):
    return f"round(quantile_cont(CAST({column} AS DOUBLE), {p}), {digits}) AS {name}"


PORTFOLIO_SQL = f"""changes AS (
    SELECT first_buy_time AS t, 1 AS kind, gross_buy_usd + buy_gas_usd + buy_dex_usd AS c FROM closed
    UNION ALL SELECT last_sell_time, 0, -(gross_buy_usd + buy_gas_usd + buy_dex_usd) FROM closed),
levels AS (SELECT sum(c) OVER (ORDER BY t, kind ROWS UNBOUNDED PRECEDING) AS level
    FROM (SELECT t, kind, sum(c) AS c FROM changes GROUP BY t, kind)),
peak AS (SELECT greatest(max(level), 0) AS capital FROM levels),
curve0 AS (SELECT last_sell_time AS t, sum(net_pnl_usd) AS p FROM closed GROUP BY last_sell_time),
curve1 AS (SELECT t, capital, capital + sum(p) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS equity
    FROM curve0, peak),
curve AS (SELECT *, greatest(capital, max(equity) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)) AS top FROM curve1),
worst AS (SELECT top - equity AS dd, top FROM curve ORDER BY round(top - equity, 9) DESC, t LIMIT 1)"""

_PORTFOLIO_SELECT = f"""count(*) AS token_rows, max(last_sell_time) AS outcome_time_end,
    {', '.join(f'round(sum({c}), 4) AS {c}' for c in ['gross_buy_usd', 'gross_sell_usd', 'gross_pnl_usd',
     'network_fee_usd', 'dex_fee_usd', 'total_fee_usd', 'net_pnl_usd'])},
    round(avg(gross_roi), 6) AS gross_mean_roi, round(avg(net_roi), 6) AS net_mean_roi,
    round(avg(CASE WHEN net_pnl_usd > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS net_hit_rate,
    round(avg(net_pnl_usd) FILTER (WHERE net_pnl_usd > 0), 4) AS average_win_usd,
    round(avg(net_pnl_usd) FILTER (WHERE net_pnl_usd <= 0), 4) AS average_loss_usd,
    round(sum(net_pnl_usd) / sum(gross_buy_usd), 6) AS net_notional_weighted_roi,
    {_q('gross_roi', 0.5, 'gross_median_roi')}, {_q('net_roi', 0.5, 'net_median_roi')},
    {_q('net_pnl_usd', 0.1, 'net_pnl_p10')}, {_q('net_pnl_usd', 0.5, 'net_pnl_median')},
    {_q('net_pnl_usd', 0.9, 'net_pnl_p90')}, {_q('net_pnl_usd', 0.99, 'net_pnl_p99')},
    {_q('hold_seconds', 0.5, 'hold_median')}, {_q('hold_seconds', 0.9, 'hold_p90')},
    {_q('sell_transactions', 0.5, 'sell_transactions_median')}, {_q('sell_transactions', 0.9, 'sell_transactions_p90')},
    {_q('inventory_exit_ratio', 0.5, 'inventory_exit_median')}, {_q('inventory_exit_ratio', 0.1, 'inventory_exit_p10')},
    {_q('inventory_exit_ratio', 0.9, 'inventory_exit_p90')},
    (SELECT round(capital, 4) FROM peak) AS capital_model_initial_usd,
    (SELECT round(equity, 4) FROM curve ORDER BY t DESC LIMIT 1) AS ending_equity_usd,
    (SELECT round(min(equity), 4) FROM curve) AS minimum_equity_usd,
    (SELECT min(equity) < 0 FROM curve) AS insolvent_under_capital_model,
    (SELECT round(dd, 4) FROM worst) AS max_drawdown_usd, (SELECT round(dd / top, 6) FROM worst) AS max_drawdown_fraction"""

_P4 = ["gross_buy_usd", "gross_sell_usd", "gross_pnl_usd", "network_fee_usd", "dex_fee_usd", "total_fee_usd",
       "net_pnl_usd", "average_win_usd", "average_loss_usd", "capital_model_initial_usd", "ending_equity_usd",
       "minimum_equity_usd", "max_drawdown_usd"]
_P5 = ["gross_median_roi", "net_median_roi", "net_pnl_p10", "net_pnl_median", "net_pnl_p90", "net_pnl_p99",
       "hold_median", "hold_p90", "sell_transactions_median", "sell_transactions_p90", "inventory_exit_median",
       "inventory_exit_p10", "inventory_exit_p90"]
_P6 = ["gross_mean_roi", "net_mean_roi", "net_hit_rate", "net_notional_weighted_roi", "max_drawdown_fraction"]


def rounded_portfolio(df):
    return rounded(rounded(rounded(df, _P4, 4), _P5, 5), _P6, 6)


@query("closed_portfolio", f"WITH {W}, {CASHFLOW_SQL}, {PORTFOLIO_SQL} SELECT {_PORTFOLIO_SELECT} FROM closed")
def closed_portfolio(spark, sf_dir):
    closed = materialise(cashflow.closed_positions(cashflow.token_cashflow(b.wallet(spark, sf_dir))))
    return rounded_portfolio(cashflow.closed_portfolio(closed))


_RATE = "10000 * (coalesce(gas_usd, 0) + coalesce(dex_usd, 0)) / nullif(cost_usd, 0)"


@query(
    "fee_rates",
    f"""WITH {W} SELECT event_type, tx_hash, round({_RATE}, 6) AS fee_bps FROM wallet WHERE {TRADES_ONLY}
    AND {_RATE} >= 0""",
)
def fee_rates(spark, sf_dir):
    rates = cashflow.trade_events(b.wallet(spark, sf_dir)).select("event_type", "tx_hash", fee_rate_bps().alias("fee_bps"))
    return rounded(rates.where(F.col("fee_bps").isNotNull()), ["fee_bps"])


_BEHAVIOR_SQL = f"""train AS (SELECT * FROM wallet WHERE {TRADES_ONLY} AND "timestamp" <= {b.WALLET_TRAIN_END}),
per_token AS (SELECT token_address, max("timestamp") - min("timestamp") AS hold,
    bool_or(event_type = 'buy') AS bought, bool_or(event_type = 'sell') AS sold FROM train GROUP BY token_address),
closed_tokens AS (SELECT * FROM per_token WHERE bought AND sold),
first_buys AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token_address ORDER BY "timestamp", tx_hash) AS rn
    FROM train WHERE event_type = 'buy') WHERE rn = 1),
rates AS (SELECT event_type, {_RATE} AS r FROM train),
stats AS (SELECT (SELECT count(*) FROM train) AS wallet_trade_rows, (SELECT count(*) FROM closed_tokens) AS closed_token_rows,
    (SELECT count(*) FROM first_buys) AS first_buy_rows, (SELECT avg(hold) FROM closed_tokens) AS hold_mean,
    (SELECT quantile_cont(CAST(hold AS DOUBLE), 0.5) FROM closed_tokens) AS hold_median,
    (SELECT quantile_cont(CAST(hold AS DOUBLE), 0.9) FROM closed_tokens) AS hold_p90,
    (SELECT quantile_cont(cost_usd, 0.5) FROM first_buys) AS first_buy_notional_median,
    (SELECT quantile_cont(r, 0.5) FROM rates WHERE event_type = 'buy' AND r >= 0) AS buy_fee_median_bps,
    (SELECT quantile_cont(r, 0.5) FROM rates WHERE event_type = 'sell' AND r >= 0) AS sell_fee_median_bps,
    (SELECT quantile_cont(r, 0.9) FROM rates WHERE event_type = 'buy' AND r >= 0) AS buy_fee_p90_bps,
    (SELECT quantile_cont(r, 0.9) FROM rates WHERE event_type = 'sell' AND r >= 0) AS sell_fee_p90_bps)"""
_BEHAVIOR = ["hold_mean", "hold_median", "hold_p90", "first_buy_notional_median", "buy_fee_median_bps",
             "sell_fee_median_bps", "buy_fee_p90_bps", "sell_fee_p90_bps"]


@query(
    "behavior_params",
    f"WITH {W}, {_BEHAVIOR_SQL} SELECT wallet_trade_rows, closed_token_rows, first_buy_rows, "
    + ", ".join(f"round({c}, 5) AS {c}" for c in _BEHAVIOR)
    + """, round(buy_fee_median_bps + sell_fee_median_bps, 5) AS roundtrip_median_bps,
    round(buy_fee_p90_bps + sell_fee_p90_bps, 5) AS roundtrip_p90_bps FROM stats""",
)
def behavior_params(spark, sf_dir):
    return rounded(
        cashflow.behavior_parameters(b.wallet(spark, sf_dir), b.WALLET_TRAIN_END),
        [*_BEHAVIOR, "roundtrip_median_bps", "roundtrip_p90_bps"], 5,
    )


@query(
    "fee_residual",
    f"""WITH {W}, r AS (SELECT gas_native - priority_fee - tip_fee AS x FROM wallet WHERE {TRADES_ONLY})
    SELECT count(*) AS trade_rows, round(min(x), 9) AS minimum, round(max(x), 9) AS maximum,
           count(*) FILTER (WHERE x < -1e-12) AS negative_rows, round(quantile_cont(x, 0.5), 9) AS median FROM r""",
)
def fee_residual(spark, sf_dir):
    return rounded(cashflow.fee_residual(b.wallet(spark, sf_dir)), ["minimum", "maximum", "median"], 9)


@query(
    "side_split",
    f"""WITH {W} SELECT token_address, round({_side('buy', 'cost_usd')}, 4) AS buy_cost_usd,
    round({_side('sell', 'cost_usd')}, 4) AS sell_cost_usd FROM wallet WHERE {TRADES_ONLY} GROUP BY token_address""",
)
def side_split(spark, sf_dir):
    flows = cashflow.token_cashflow(b.wallet(spark, sf_dir))
    return flows.select(
        "token_address", F.round("gross_buy_usd", 4).alias("buy_cost_usd"),
        F.round("gross_sell_usd", 4).alias("sell_cost_usd"),
    )


@query(
    "censored_outcomes",
    f"""WITH {W}, {CASHFLOW_SQL}
    SELECT last_event_time >= {b.WALLET_HOLDOUT} AS outcome_crosses_boundary, count(*) AS tokens,
           max(last_event_time) AS last_event_time FROM flows GROUP BY 1""",
)
def censored_outcomes(spark, sf_dir):
    flagged = cashflow.outcome_crosses(cashflow.token_cashflow(b.wallet(spark, sf_dir)), b.WALLET_HOLDOUT)
    return flagged.groupBy("outcome_crosses_boundary").agg(
        F.count(F.lit(1)).alias("tokens"), F.max("last_event_time").alias("last_event_time")
    )


# Decisions of the wallet view: the first signup of each user; a slot is one day, the position inside it the event id.
def wallet_decisions(spark, sf_dir):
    signups = b.wallet(spark, sf_dir).where(F.col("event_type") == "signup")
    first = cashflow.first_event(signups, [])
    return first.select(
        "token_address", "tx_hash", F.col("timestamp").alias("decision_time"), F.col("timestamp").alias("decision_epoch"),
        F.floor(F.col("timestamp") / 86400).alias("block_slot"), F.col("tx_hash").alias("tx_index"),
    )


def latency(spark, sf_dir):
    wallet = b.wallet(spark, sf_dir)
    positions = wallet.where(F.col("event_type") == "buy").select(
        F.col("tx_hash").alias("buy_tx_hash"), F.col("timestamp").alias("buy_block_time"),
        F.floor(F.col("timestamp") / 86400).alias("buy_slot"), F.col("tx_hash").alias("buy_tx_index"),
    )
    return entry_latency(wallet_decisions(spark, sf_dir), wallet, positions)


LATENCY_SQL = """firsts AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token_address, event_type ORDER BY "timestamp", tx_hash) AS rn
        FROM wallet WHERE event_type IN ('signup', 'buy')) WHERE rn = 1),
latency AS (
    SELECT d.token_address, d."timestamp" AS decision_time, p.tx_hash AS buy_tx_hash, p.cost_usd AS entry_cost_usd,
           p."timestamp" - d."timestamp" AS latency_seconds,
           CAST(floor(p."timestamp" / 86400) - floor(d."timestamp" / 86400) AS BIGINT) AS latency_slots,
           CASE WHEN floor(p."timestamp" / 86400) = floor(d."timestamp" / 86400) THEN p.tx_hash - d.tx_hash END
               AS same_slot_position_delta
    FROM (SELECT * FROM firsts WHERE event_type = 'signup') d
    LEFT JOIN (SELECT * FROM firsts WHERE event_type = 'buy') p USING (token_address))"""


@query("first_buy_latency", f"WITH {W}, {LATENCY_SQL} SELECT * FROM latency")
def first_buy_latency(spark, sf_dir):
    return latency(spark, sf_dir).select(
        "token_address", "decision_time", "buy_tx_hash", "entry_cost_usd", "latency_seconds", "latency_slots",
        "same_slot_position_delta",
    )


@query(
    "latency_summary",
    f"""WITH {W}, {LATENCY_SQL}, s AS (
    {_stats('latency_slots', 'latency')} UNION ALL {_stats('latency_seconds', 'latency')}
    UNION ALL {_stats('same_slot_position_delta', 'latency')}
    UNION ALL {_stats('entry_cost_usd', '(SELECT * FROM latency WHERE latency_slots IS NOT NULL)')})
    SELECT s.*, (SELECT count(*) FROM latency) AS deployment_rows,
           (SELECT count(latency_slots) FROM latency) AS matched_first_buys,
           (SELECT round(avg(CASE WHEN latency_slots = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 9) FROM latency
                WHERE latency_slots IS NOT NULL) AS zero_slot_share
    FROM s""",
)
def latency_summary_query(spark, sf_dir):
    summary = rounded(latency_summary(materialise(latency(spark, sf_dir))), ["mean", "median", "p90"])
    return rounded(summary, ["zero_slot_share"], 9)


@query(
    "position_params",
    f"""WITH {W}, {LATENCY_SQL}, gaps AS (SELECT CAST(same_slot_position_delta AS DOUBLE) AS g FROM latency
        WHERE decision_time <= {b.WALLET_TRAIN_END} AND latency_slots = 0 AND same_slot_position_delta > 0)
    SELECT count(*) AS rows, CAST(min(g) AS BIGINT) AS minimum, CAST(max(g) AS BIGINT) AS maximum,
           {', '.join(f'round(avg(CASE WHEN g <= {k} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share_at_or_before_{k}' for k in (10, 50, 100))},
           {', '.join(f'round(quantile_cont(g, {p}), 6) AS {n}' for n, p in cashflow.POSITION_PROBS.items())}
    FROM gaps""",
)
def position_params(spark, sf_dir):
    params = cashflow.position_parameters(latency(spark, sf_dir), b.WALLET_TRAIN_END)
    return rounded(params, [f"share_at_or_before_{k}" for k in (10, 50, 100)] + list(cashflow.POSITION_PROBS))


@query(
    "wallet_audit",
    f"""WITH {W}, {SUMMARY_SQL}, full_summary AS (SELECT *, gross_sell_usd - gross_buy_usd AS gross_pnl_usd FROM summary),
    buys AS (SELECT *, cost_usd AS all_buy_size_usd, cost_usd AS entry_size_usd,
        row_number() OVER (PARTITION BY token_address ORDER BY "timestamp", tx_hash) AS rn FROM wallet
        WHERE event_type = 'buy')
    {_stats('entry_size_usd', '(SELECT * FROM buys WHERE rn = 1)')} UNION ALL {_stats('all_buy_size_usd', 'buys')}
    UNION ALL {_stats('sell_transactions', 'full_summary')} UNION ALL {_stats('hold_seconds', 'full_summary')}
    UNION ALL {_stats('gross_pnl_usd', 'full_summary')}""",
)
def wallet_audit(spark, sf_dir):
    return rounded(audit_wallet(b.wallet(spark, sf_dir)), ["mean", "median", "p90"])
