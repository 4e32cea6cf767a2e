"""Wallet cash flows per token and behaviour parameters learned from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.derived import fee_rate_bps
from tidemark.operators.portfolio import equity_curve, peak_level, worst_drawdown
from tidemark.operators.quality import count_where
from tidemark.operators.quantiles import exact_quantiles, finite_sum, unpivot_measures

MONEY = "decimal(38,16)"
CASH_COLUMNS = ("cost_usd", "gas_usd", "dex_usd", "gas_native", "priority_fee", "tip_fee", "token_amount")


def money(value: Column) -> Column:
    """Exact type for sums, so that a total does not depend on how rows were partitioned."""
    return value.cast(MONEY)


def _exact_sum(value: Column) -> Column:
    """Sum of the present amounts; an amount that is no finite number stops the plan instead of vanishing."""
    unreadable = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return finite_sum(F.when(unreadable, F.raise_error(F.lit("a cash amount is not finite"))).otherwise(value))


def strict_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text or mixed numbers to double; what is no number stops the plan, and null stays null."""

    def strict(name: str) -> Column:
        number = F.col(name).try_cast("double")
        message = F.concat(F.lit(f"{name} is no number: "), F.col(name).cast("string"))
        return F.when(F.col(name).isNotNull() & number.isNull(), F.raise_error(message)).otherwise(number)

    return df.withColumns({c: strict(c) for c in columns})


def lenient_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text or mixed numbers to double; what cannot be read becomes null."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("double") for c in present})


def trade_events(wallet: DataFrame) -> DataFrame:
    return wallet.where(F.col("event_type").isin("buy", "sell"))


def wallet_summary(wallet: DataFrame) -> DataFrame:
    """Per token: first symbol, time range, transactions by side, gross amounts and holding time.

    A side without any amount gives null, not zero.
    """
    buy, sell = F.col("event_type") == "buy", F.col("event_type") == "sell"
    grouped = (
        lenient_numbers(trade_events(wallet), CASH_COLUMNS)
        .groupBy("token_address")
        .agg(
            F.min_by(
                "token_symbol",
                F.when(F.col("token_symbol").isNotNull(), F.struct("timestamp", "tx_hash")),
            ).alias("token_symbol"),
            F.min("timestamp").alias("first_event_time"),
            F.max("timestamp").alias("last_event_time"),
            F.count_if(buy).alias("buy_transactions"),
            F.count_if(sell).alias("sell_transactions"),
            _exact_sum(F.when(buy, F.col("cost_usd"))).alias("gross_buy_usd"),
            _exact_sum(F.when(sell, F.col("cost_usd"))).alias("gross_sell_usd"),
        )
    )
    return grouped.withColumns(
        {
            "gross_pnl_usd": F.col("gross_sell_usd") - F.col("gross_buy_usd"),
            "hold_seconds": F.col("last_event_time") - F.col("first_event_time"),
        }
    )


def wallet_totals(wallet: DataFrame, summary: DataFrame) -> DataFrame:
    """One row of counts over the whole wallet table and its token summary."""
    rows = wallet.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("timestamp").alias("time_start"),
        F.max("timestamp").alias("time_end"),
    )
    transactions = wallet.select("tx_hash").distinct().agg(F.count("tx_hash").alias("transaction_count"))
    tokens = summary.agg(
        F.count("token_address").alias("unique_tokens_traded"),
        count_where(F.col("buy_transactions") > 0).alias("unique_tokens_bought"),
        count_where(F.col("sell_transactions") > 1).alias("tokens_with_multiple_sells"),
        count_where(F.col("sell_transactions") == 0).alias("tokens_without_observed_sell"),
    )
    return rows.crossJoin(transactions).crossJoin(tokens)


def first_event(events: DataFrame, columns: Sequence[str], *, key: str = "token_address") -> DataFrame:
    """The earliest event of each key; equal times are decided by transaction hash."""
    return events.groupBy(key).agg(F.min(F.struct("timestamp", "tx_hash", *columns)).alias("_first")).select(
        key, F.col("_first.timestamp").alias("timestamp"), F.col("_first.tx_hash").alias("tx_hash"),
        *[F.col(f"_first.{c}").alias(c) for c in columns],
    )


def cashflow_violations(wallet: DataFrame) -> DataFrame:
    """Counts that must be zero before cash flows are built."""
    events = lenient_numbers(trade_events(wallet), CASH_COLUMNS)
    missing, negative = F.lit(False), F.lit(False)
    for c in ("cost_usd", "gas_usd", "dex_usd"):
        missing = missing | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        negative = negative | (F.col(c) < 0)
    per_hash = events.groupBy("tx_hash").agg(
        F.count(F.lit(1)).alias("_n"), count_where(missing).alias("_m"), count_where(negative).alias("_g")
    )
    return per_hash.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_transaction_rows"),
        F.coalesce(F.sum("_m"), F.lit(0)).alias("rows_with_missing_cash"),
        F.coalesce(F.sum("_g"), F.lit(0)).alias("rows_with_negative_cash"),
    )


def token_cashflow(wallet: DataFrame) -> DataFrame:
    """Per token: what was paid, received and charged. Priority and tip fees are inside gas and not added again."""
    buy, sell = F.col("event_type") == "buy", F.col("event_type") == "sell"

    def by_side(side: Column, column: str) -> Column:
        return F.coalesce(_exact_sum(F.when(side, F.col(column))), F.lit(0.0))

    grouped = (
        lenient_numbers(trade_events(wallet), CASH_COLUMNS)
        .groupBy("token_address")
        .agg(
            F.min("timestamp").alias("first_event_time"),
            F.max("timestamp").alias("last_event_time"),
            F.min(F.when(buy, F.col("timestamp"))).alias("first_buy_time"),
            F.max(F.when(sell, F.col("timestamp"))).alias("last_sell_time"),
            F.count_if(buy).alias("buy_transactions"),
            F.count_if(sell).alias("sell_transactions"),
            F.coalesce(F.bool_or(sell & (F.col("is_open_or_close") == 1)), F.lit(False)).alias("observed_close"),
            by_side(buy, "cost_usd").alias("gross_buy_usd"),
            by_side(sell, "cost_usd").alias("gross_sell_usd"),
            by_side(buy, "gas_usd").alias("buy_gas_usd"),
            by_side(sell, "gas_usd").alias("sell_gas_usd"),
            by_side(buy, "dex_usd").alias("buy_dex_usd"),
            by_side(sell, "dex_usd").alias("sell_dex_usd"),
            by_side(buy, "token_amount").alias("bought_token_amount"),
            by_side(sell, "token_amount").alias("sold_token_amount"),
        )
    )
    network = F.col("buy_gas_usd") + F.col("sell_gas_usd")
    dex = F.col("buy_dex_usd") + F.col("sell_dex_usd")
    gross = F.col("gross_sell_usd") - F.col("gross_buy_usd")
    net = gross - (network + dex)
    return grouped.withColumns(
        {
            "network_fee_usd": network,
            "dex_fee_usd": dex,
            "total_fee_usd": network + dex,
            "gross_pnl_usd": gross,
            "net_pnl_usd": net,
            "gross_roi": F.try_divide(gross, F.col("gross_buy_usd")),
            "net_roi": F.try_divide(net, F.col("gross_buy_usd")),
            "hold_seconds": F.col("last_sell_time") - F.col("first_buy_time"),
            "inventory_exit_ratio": F.try_divide(F.col("sold_token_amount"), F.col("bought_token_amount")),
        }
    )


def cashflow_integrity(flows: DataFrame) -> DataFrame:
    """Violation counts of a cash-flow table."""
    nonfinite = F.lit(False)
    for c in ("gross_buy_usd", "gross_sell_usd", "network_fee_usd", "dex_fee_usd", "gross_pnl_usd", "net_pnl_usd"):
        nonfinite = nonfinite | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
    return flows.agg(
        count_where(F.col("first_event_time") > F.col("last_event_time")).alias("reversed_event_times"),
        count_where((F.col("buy_transactions") > 0) & (F.col("gross_buy_usd") <= 0)).alias("bought_without_cost"),
        count_where(nonfinite).alias("nonfinite_rows"),
    )


def closed_positions(flows: DataFrame) -> DataFrame:
    return flows.where(
        (F.col("buy_transactions") > 0)
        & (F.col("sell_transactions") > 0)
        & F.col("observed_close")
        & (F.col("gross_buy_usd") > 0)
    )


def fee_residual(wallet: DataFrame) -> DataFrame:
    """What remains of the native fee after priority and tip: minimum, median, maximum and negative rows."""
    events = lenient_numbers(trade_events(wallet), CASH_COLUMNS)
    zero = F.lit(0.0)
    residual = events.select(
        (
            F.coalesce("gas_native", zero) - F.coalesce("priority_fee", zero) - F.coalesce("tip_fee", zero)
        ).alias("residual")
    )
    basic = residual.agg(
        F.count(F.lit(1)).alias("trade_rows"),
        F.min("residual").alias("minimum"),
        F.max("residual").alias("maximum"),
        count_where(F.col("residual") < -1e-12).alias("negative_rows"),
    )
    return basic.crossJoin(exact_quantiles(residual, value="residual", probs={"median": 0.5}).drop("value_rows"))


def behavior_parameters(wallet: DataFrame, cutoff: int | Column) -> DataFrame:
    """One row of holding time, first-buy amount and fee rates from events no later than the cutoff."""
    events = trade_events(wallet).where(F.col("timestamp") <= cutoff)
    buy = F.col("event_type") == "buy"
    per_token = events.groupBy("token_address").agg(
        F.max("timestamp").alias("_last"),
        F.min("timestamp").alias("_start"),
        F.bool_or(buy).alias("_bought"),
        F.bool_or(~buy).alias("_sold"),
        F.min(F.when(buy, F.struct("timestamp", "tx_hash", F.col("cost_usd").try_cast("double").alias("cost")))).alias(
            "_first"
        ),
    )
    closed = F.col("_bought") & F.col("_sold")
    measures = per_token.select(
        F.when(closed, (F.col("_last") - F.col("_start")).cast("double")).alias("hold"),
        F.col("_first.cost").alias("notional"),
    )
    rates = events.select(
        F.when(buy, fee_rate_bps()).alias("buy_bps"), F.when(~buy, fee_rate_bps()).alias("sell_bps")
    )
    tall = unpivot_measures(measures, [], ["hold", "notional"]).unionAll(
        unpivot_measures(rates, [], ["buy_bps", "sell_bps"])
    )
    q = exact_quantiles(tall, value="value", probs={"median": 0.5, "p90": 0.9}, keys=["measure"])
    of = lambda measure, stat: F.max(F.when(F.col("measure") == measure, F.col(stat)))
    stats = q.agg(
        of("hold", "median").alias("hold_median"),
        of("hold", "p90").alias("hold_p90"),
        of("notional", "median").alias("first_buy_notional_median"),
        of("buy_bps", "median").alias("buy_fee_median_bps"),
        of("sell_bps", "median").alias("sell_fee_median_bps"),
        of("buy_bps", "p90").alias("buy_fee_p90_bps"),
        of("sell_bps", "p90").alias("sell_fee_p90_bps"),
    ).withColumns(
        {
            "roundtrip_median_bps": F.col("buy_fee_median_bps") + F.col("sell_fee_median_bps"),
            "roundtrip_p90_bps": F.col("buy_fee_p90_bps") + F.col("sell_fee_p90_bps"),
        }
    )
    counts = per_token.agg(
        F.count_if(closed).alias("closed_token_rows"),
        F.count_if(F.col("_bought")).alias("first_buy_rows"),
        F.avg(F.when(closed, F.col("_last") - F.col("_start"))).alias("hold_mean"),
    )
    rows = events.agg(F.count(F.lit(1)).alias("wallet_trade_rows"))
    return rows.crossJoin(counts).crossJoin(stats)


POSITION_PROBS: Mapping[str, float] = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


def position_parameters(latency: DataFrame, cutoff: Column | object) -> DataFrame:
    """Distribution of positive same-slot position gaps of decisions no later than the cutoff."""
    gaps = latency.where(
        (F.col("decision_time") <= cutoff) & (F.col("latency_slots") == 0) & (F.col("same_slot_position_delta") > 0)
    ).select(F.col("same_slot_position_delta").alias("gap"))
    within = lambda k: F.avg((F.col("gap") <= k).cast("double")).alias(f"share_at_or_before_{k}")
    basic = gaps.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("gap").alias("minimum"),
        F.max("gap").alias("maximum"),
        within(10),
        within(50),
        within(100),
    )
    return basic.crossJoin(exact_quantiles(gaps, value="gap", probs=POSITION_PROBS).drop("value_rows"))


def closed_portfolio(closed: DataFrame) -> DataFrame:
    """One row about closed positions: totals, returns, quantiles, peak capital and realised drawdown.

    Positions that carry their ``decision_time`` also give the first and last one.
    """
    net = F.col("net_pnl_usd")
    totals = ["gross_buy_usd", "gross_sell_usd", "gross_pnl_usd", "network_fee_usd", "dex_fee_usd", "total_fee_usd",
              "net_pnl_usd"]
    decided = [
        f("decision_time").alias(name)
        for f, name in ((F.min, "decision_time_start"), (F.max, "decision_time_end"))
        if "decision_time" in closed.columns
    ]
    basic = closed.agg(
        F.count(F.lit(1)).alias("token_rows"),
        *decided,
        F.max("last_sell_time").alias("outcome_time_end"),
        *[_exact_sum(F.col(c)).alias(c) for c in totals],
        F.avg("gross_roi").alias("gross_mean_roi"),
        F.avg("net_roi").alias("net_mean_roi"),
        F.avg((net > 0).cast("double")).alias("net_hit_rate"),
        F.avg(F.when(net > 0, net)).alias("average_win_usd"),
        F.avg(F.when(net <= 0, net)).alias("average_loss_usd"),
    ).withColumn("net_notional_weighted_roi", F.try_divide(F.col("net_pnl_usd"), F.col("gross_buy_usd")))
    measures = ["gross_roi", "net_roi", "net_pnl_usd", "hold_seconds", "sell_transactions", "inventory_exit_ratio"]
    q = exact_quantiles(
        unpivot_measures(closed, [], measures),
        value="value",
        probs={"p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99},
        keys=["measure"],
    )
    wanted = {
        "gross_median_roi": ("gross_roi", "median"),
        "net_median_roi": ("net_roi", "median"),
        "net_pnl_p10": ("net_pnl_usd", "p10"),
        "net_pnl_median": ("net_pnl_usd", "median"),
        "net_pnl_p90": ("net_pnl_usd", "p90"),
        "net_pnl_p99": ("net_pnl_usd", "p99"),
        "hold_median": ("hold_seconds", "median"),
        "hold_p90": ("hold_seconds", "p90"),
        "sell_transactions_median": ("sell_transactions", "median"),
        "sell_transactions_p90": ("sell_transactions", "p90"),
        "inventory_exit_median": ("inventory_exit_ratio", "median"),
        "inventory_exit_p10": ("inventory_exit_ratio", "p10"),
        "inventory_exit_p90": ("inventory_exit_ratio", "p90"),
    }
    quantiles = q.agg(
        *[F.max(F.when(F.col("measure") == m, F.col(s))).alias(n) for n, (m, s) in wanted.items()]
    )
    capital = F.col("gross_buy_usd") + F.col("buy_gas_usd") + F.col("buy_dex_usd")
    peak = peak_level(
        closed.withColumn("_capital", capital), start="first_buy_time", end="last_sell_time", level="_capital",
        name="capital_model_initial_usd",
    )
    curve = equity_curve(closed, time="last_sell_time", pnl="net_pnl_usd", initial=peak,
                         initial_column="capital_model_initial_usd")
    return basic.crossJoin(quantiles).crossJoin(peak).crossJoin(worst_drawdown(curve))


def outcome_crosses(df: DataFrame, boundary: Column | object, last: str = "last_event_time") -> DataFrame:
    """Flag rows whose outcome reaches the boundary, so that it cannot leak across."""
    return df.withColumn("outcome_crosses_boundary", F.col(last) >= boundary)
