"""UTC clock columns. One function serves both classes, so no class can get another zone or weekday rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import require_utc


def epoch_to_time(epoch: str | Column) -> Column:
    return F.timestamp_seconds(epoch)


def time_to_epoch(time: str | Column) -> Column:
    """Whole seconds since 1970 in UTC; zone-less timestamps are read as UTC."""
    column = F.col(time) if isinstance(time, str) else time
    return F.unix_seconds(column.cast("timestamp"))


def add_utc_clock(
    df: DataFrame, time: str = "decision_time", hour: str = "decision_hour_utc", weekday: str = "decision_weekday_utc"
) -> DataFrame:
    """Hour 0..23 and weekday with Monday = 0."""
    require_utc(df.sparkSession)
    moment = F.col(time).cast("timestamp")
    moment = F.when(moment.isNull(), F.raise_error(F.lit(f"{time} is missing"))).otherwise(moment)
    return df.withColumns({hour: F.hour(moment), weekday: F.weekday(moment)})


def position_key(slot: str, tx: str, event: str) -> Column:
    """Zero-padded text whose order equals position order."""
    return F.format_string("%012d%06d%04d", F.col(slot), F.col(tx), F.col(event))
