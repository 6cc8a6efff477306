"""Event-time operators on streams (and, but for state, on tables)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 day", by: tuple[str, ...] = ("event_type",), offset: str | None = None) -> DataFrame:
    """Counts and sums by tumbling or sliding windows that begin ``offset`` after the epoch's; rows later
    than ``late``, and those without a time, are dropped."""
    at = F.window("ts", width, slide, offset) if slide else F.window("ts", width, startTime=offset)
    return (
        events.withWatermark("ts", late).groupBy(at.alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n", F.round("total", 4).alias("total"))
    )


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of a user's events that are less than ``gap`` apart."""
    return (
        events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
    )


def deduplicated(events: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def followed_by(first: DataFrame, then: DataFrame, within: str, late: str = "1 day", how: str = "inner") -> DataFrame:
    """Pairs of a user's rows of two streams, the second at most ``within`` after the first."""
    a = first.select(F.col("user_id").alias("a_user"), F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts")).withWatermark("a_ts", late)
    b = then.select(F.col("user_id").alias("b_user"), F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts")).withWatermark("b_ts", late)
    near = (F.col("a_user") == F.col("b_user")) & (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near, how).select("a_id", "b_id")


def totals_by_user(events: DataFrame) -> DataFrame:
    """Running count and sum of each user, kept as state between batches; a row per user and batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for rows in batches:
            n, total = n + len(rows), total + float(rows["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})

    return events.groupBy("user_id").applyInPandasWithState(
        update, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def idle_users(events: DataFrame, hours: int, late: str = "1 day") -> DataFrame:
    """Users, with the number and time of their events, once the watermark is ``hours`` past the last."""
    wait = hours * 3_600_000

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "seen": [pd.Timestamp(last)]})
            return
        for rows in batches:
            at = rows["ts"].max().to_datetime64()
            n, last = n + len(rows), at if last is None else max(pd.Timestamp(last).to_datetime64(), at)
        last = pd.Timestamp(last)
        state.update((n, last.to_pydatetime()))
        state.setTimeoutTimestamp(max(int(last.value // 1_000_000) + wait, state.getCurrentWatermarkMs() + 1))
        yield from ()

    found = events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(
        update, "user_id long, n long, seen timestamp", "n long, last timestamp", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("user_id", "n", F.col("seen").cast("timestamp_ntz").alias("seen"))
