"""Streaming forms: crawl state by jurisdiction, log statistics, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Minutes after which a running crawl counts as dead, and in which a failed one isn't started again.
STALE_MINUTES, COOLDOWN_MINUTES = 35, 10


def next_state(kind: str | None, since: float | None, event: str, at: float) -> tuple[str | None, float | None]:
    """State of a jurisdiction (active, failed or none) after an event at a time in seconds; a start clears a failure."""
    if event in ("start", "progress"):
        return "active", at
    if event == "fail":
        return "failed", at
    return None, None  # done


def current(kind: str | None, since: float | None, now: float) -> str | None:
    """The state as of now: stale runs and failures past their cooldown are forgotten."""
    limit = {"active": STALE_MINUTES, "failed": COOLDOWN_MINUTES}.get(kind or "", 0) * 60
    return kind if kind and now - since < limit else None


def may_start(kind: str | None, since: float | None, now: float) -> bool:
    return current(kind, since, now) is None


def crawl_states(events: DataFrame) -> DataFrame:
    """(jurisdiction, state, at) for each batch of a stream of (jurisdiction, event, ts), by keyed state that event time expires.

    A key's state is two numbers, whatever its history; expired keys leave the state store.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, since = state.get if state.exists else ("", 0.0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"jurisdiction": [key[0]], "state": ["expired"], "at": [since]})
            return
        for rows in batches:
            for event, at in sorted(zip(rows["event"], rows["ts"].astype("int64") / 1e9, strict=True), key=lambda x: x[1]):
                kind, since = next_state(kind or None, since, event, at)
                kind, since = kind or "", since or at
        if kind:
            state.update((kind, since))
            limit = {"active": STALE_MINUTES, "failed": COOLDOWN_MINUTES}[kind] * 60
            state.setTimeoutTimestamp(max(int((since + limit) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"jurisdiction": [key[0]], "state": [kind or "done"], "at": [since]})

    watched = events.withWatermark("ts", "1 minute").groupBy("jurisdiction")
    return watched.applyInPandasWithState(step, "jurisdiction string, state string, at double", "kind string, since double", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Rows by type in tumbling windows of a stream (or table) with ts and event_type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("at"), "event_type", "n")


def rate_limited(events: DataFrame, who: str, limit: int = 10, minutes: int = 60, slide: int = 5) -> DataFrame:
    """Keys that reach `limit` rows in a sliding window; rows without a key are exempt."""
    known = events.where(F.col(who).isNotNull()).withWatermark("ts", f"{minutes} minutes")
    return known.groupBy(F.window("ts", f"{minutes} minutes", f"{slide} minutes").alias("w"), who).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit).select(who, F.col("w.start").alias("at"), "n")
