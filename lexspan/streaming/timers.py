"""Crawl states with timers: heartbeats while a crawl runs, expiry of stale crawls and of cooldowns, answers that age."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .state import COOLDOWN_MINUTES, STALE_MINUTES

HEARTBEAT_SECONDS = 60
_LIMIT = {"active": STALE_MINUTES * 60, "failed": COOLDOWN_MINUTES * 60}

#: What a jurisdiction is: active, failed or '' (nothing), since when, and when its next heartbeat is due.
Crawl = tuple[str, float, float]


def advance(crawl: Crawl, now: float) -> tuple[Crawl, list[tuple[str, float]]]:
    """The state at a time, and the heartbeats and the expiry or end of cooldown that fall before it or on it."""
    kind, since, beat = crawl
    out: list[tuple[str, float]] = []
    if not kind:
        return crawl, out
    limit = since + _LIMIT[kind]
    while kind == "active" and beat <= min(now, limit):
        out.append(("heartbeat", beat))
        beat += HEARTBEAT_SECONDS
    if limit <= now:
        out.append(("expired" if kind == "active" else "cooled", limit))
        return ("", 0.0, 0.0), out
    return (kind, since, beat), out


def follow(crawl: Crawl, event: str, at: float) -> tuple[Crawl, list[tuple[str, float]]]:
    """The state after an event: a start of a running crawl changes nothing (running), one in a cooldown is refused."""
    kind, since, beat = crawl
    if event == "start":
        if kind:
            return crawl, [("refused" if kind == "failed" else "running", at)]
        return ("active", at, at + HEARTBEAT_SECONDS), [("active", at)]
    if event == "progress":
        return (kind, at, beat) if kind == "active" else crawl, []
    if event == "fail":
        return ("failed", at, 0.0), [("failed", at)]
    if event == "done":
        return ("", 0.0, 0.0), [("done", at)]
    return crawl, []


def crawl_timers(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(jurisdiction, kind, at) of a stream of (jurisdiction, event, ts): each change of state (active, failed, done), starts that
    meet a running crawl or a cooldown (running, refused), a heartbeat for each 60 seconds of stream time that a crawl runs,
    and the times when a crawl counts as dead (expired: 35 minutes after its last sign) or a cooldown ends (cooled: 10).

    A key's state is three values and one event-time timer; it leaves the state store when it ends. Timers that fall due
    before a later event of the same batch fire before it, so the rows don't depend on how events are batched, as long as they
    are in order for each key. A restart goes on from the checkpoint.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        crawl: Crawl = tuple(state.get) if state.exists else ("", 0.0, 0.0)
        out: list[tuple[str, float]] = []
        if state.hasTimedOut:
            crawl, out = advance(crawl, state.getCurrentWatermarkMs() / 1000)
        else:
            given = sorted(((at.timestamp(), event) for rows in batches for event, at in zip(rows["event"], rows["ts"], strict=True)), key=lambda x: x[0])
            for at, event in given:
                crawl, due = advance(crawl, at)
                crawl, made = follow(crawl, event, at)
                out += due + made
        if crawl[0]:
            state.update(crawl)
            limit = crawl[1] + _LIMIT[crawl[0]]
            due = min(crawl[2], limit) if crawl[0] == "active" else limit
            state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"jurisdiction": [key[0]] * len(out), "kind": [k for k, _ in out], "at": [float(t) for _, t in out]})

    watched = events.select("jurisdiction", "event", "ts").withWatermark("ts", late).groupBy("jurisdiction")
    return watched.applyInPandasWithState(step, "jurisdiction string, kind string, at double", "kind string, since double, beat double", "append", GroupStateTimeout.EventTimeTimeout)


def cached_answers(rows: DataFrame, seconds: int, late: str = "10 seconds") -> DataFrame:
    """(key, answer) for each question in a stream of (key, answer; null: a question; ts): the last answer less than `seconds` older
    than the question, else null. An answer leaves the state store when stream time has passed its end."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [], "answer": []}, dtype=object)
            return
        answer, since = state.get if state.exists else (None, 0.0)
        out = []
        for at, given in sorted(((at.timestamp(), given) for rows_ in batches for given, at in zip(rows_["answer"], rows_["ts"], strict=True)), key=lambda x: x[0]):
            if given is None or pd.isna(given):
                out.append(answer if answer is not None and at - since < seconds else None)
            else:
                answer, since = given, at
        if answer is not None:
            state.update((answer, since))
            state.setTimeoutTimestamp(max(int((since + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]] * len(out), "answer": out}, dtype=object)

    watched = rows.select("key", "answer", "ts").withWatermark("ts", late).groupBy("key")
    return watched.applyInPandasWithState(step, "key string, answer string", "answer string, since double", "append", GroupStateTimeout.EventTimeTimeout)


def minutes_running(found: DataFrame) -> DataFrame:
    """Heartbeats by jurisdiction, from crawl_timers()'s rows."""
    return found.where("kind = 'heartbeat'").groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("minutes"))
