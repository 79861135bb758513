"""Streaming twins of the guardrails: rate limits and sessions with keyed state."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from polka.operators.guardrails import Limiter

DECISIONS = "event_id bigint, user_id bigint, accepted boolean, retry_after double"
SESSIONS = "user_id bigint, session int, items bigint, bytes bigint, outcome string, at double"


def rate_limit_stream(events: DataFrame, most: int, window: float, gap: float = 0.0) -> DataFrame:
    """Decisions on a stream ``event_id, user_id, ts``; the state of a user is the accepted times of one window.

    Events of one trigger are taken in time order. Events without a user or a time are dropped.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limiter = Limiter(most, window, gap, list(state.get[0]) if state.exists else [])
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        out = [(e, key[0], *limiter.acquire(t)) for e, t in zip(rows["event_id"], rows["t"], strict=True)]
        state.update((list(limiter.times),))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "accepted", "retry_after"])

    timed = events.where("user_id is not null and ts is not null").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(decide, DECISIONS, "times array<double>", "append", GroupStateTimeout.NoTimeout)


class Session:
    """One user's uploads: pending ones expire, processing ones stay; the version rises with every end."""

    def __init__(self, ttl: float, most_items: int, per_item: int, most_bytes: int, state: tuple | None = None):
        self.ttl, self.most_items, self.per_item, self.most_bytes = ttl, most_items, per_item, most_bytes
        self.version, self.items, self.pending, self.processing, self.updated = state or (0, 0, 0, 0, 0.0)

    def state(self) -> tuple:
        return self.version, self.items, self.pending, self.processing, self.updated

    def expire(self, now: float) -> bool:
        """Exactly ``ttl`` idle seconds end the pending uploads."""
        if self.items and now - self.updated >= self.ttl:
            self.items = self.pending = 0
            self.version += 1
            return True
        return False

    def add(self, size: int, now: float, expected: int | None = None) -> str:
        """``ok`` or the first limit that is broken."""
        self.expire(now)
        if expected is not None and expected != self.version:
            return "session_closed"
        if self.processing:
            return "session_processing"
        if not 0 < size <= self.per_item:
            return "item_bytes"
        if self.items >= self.most_items:
            return "item_count"
        if self.pending + size > self.most_bytes:
            return "session_bytes"
        self.items, self.pending, self.updated = self.items + 1, self.pending + size, now
        return "ok"

    def take(self, now: float) -> int:
        """Pending uploads go to processing; their bytes stay reserved until released."""
        self.expire(now)
        n, self.items = self.items, 0
        self.processing, self.pending = self.processing + self.pending, 0
        self.version += bool(n)
        return n

    def cancel(self) -> bool:
        had = bool(self.items)
        self.items = self.pending = 0
        self.version += 1
        return had

    def release(self) -> bool:
        had, self.processing = bool(self.processing), 0
        return had


def session_stream(events: DataFrame, ttl: float = 1800.0, most_items: int = 50, per_item: int = 12 * 2**20, most_bytes: int = 75 * 2**20) -> DataFrame:
    """Outcomes of uploads ``user_id, ts, bytes``; a timer of processing time drops idle sessions."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        s = Session(ttl, most_items, per_item, most_bytes, held[:-1] if held else None)
        out, touched = [], time.time()
        if state.hasTimedOut and held and touched - held[-1] < ttl:  # the timer came early: wait for the rest
            state.update(held)
            state.setTimeoutDuration(int(ttl * 1000))
        elif state.hasTimedOut:
            if s.items:
                s.items = s.pending = 0
                s.version += 1
            out.append((key[0], s.version, 0, 0, "expired", s.updated))
            state.update((*s.state(), touched))
        else:
            rows = pd.concat(list(batches)).sort_values("t")
            for t, size in zip(rows["t"], rows["bytes"], strict=True):
                got = s.add(int(size) if size == size else 0, t)
                out.append((key[0], s.version, s.items, s.pending, got, t))
            state.update((*s.state(), touched))
            state.setTimeoutDuration(int(ttl * 1000))
        yield pd.DataFrame(out, columns=["user_id", "session", "items", "bytes", "outcome", "at"])

    timed = events.where("user_id is not null and ts is not null").select("user_id", F.col("bytes").cast("double").alias("bytes"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(step, SESSIONS, "version int, items bigint, pending bigint, processing bigint, updated double, touched double", "append", GroupStateTimeout.ProcessingTimeTimeout)
