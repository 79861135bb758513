"""Limits on event streams, as batch operators: rate limits, session expiry, budgets, circuit breakers."""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Limiter:
    """Accepts at most ``most`` events in any window of ``window`` seconds, ``gap`` seconds apart at least.

    Rejected events leave no trace. An event exactly ``window`` old no longer counts. The gap
    is checked first; ``acquire`` returns (accepted, seconds to wait).
    """

    def __init__(self, most: int, window: float, gap: float = 0.0, times: list[float] | None = None):
        self.most, self.window, self.gap, self.times = most, window, gap, deque(times or [])

    def acquire(self, now: float) -> tuple[bool, float]:
        while self.times and self.times[0] <= now - self.window:
            self.times.popleft()
        if self.gap and self.times and now - self.times[-1] < self.gap:
            return False, max(1.0, math.ceil(self.gap - (now - self.times[-1])))
        if len(self.times) >= self.most:
            wait = max(0.0, self.times[0] + self.window - now)
            return False, max(1.0, math.ceil(wait)) if self.gap else wait
        self.times.append(now)
        return True, 0.0


def rate_limit(events: DataFrame, most: int, window: float, gap: float = 0.0, by: str | None = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """``key, by, accepted, retry_after`` in time order per ``by`` (NULL is a key of its own).

    Whether an event is accepted depends on all accepted before it, so the events of a key are
    read in order by one task; they are streamed in batches with only the accepted times of
    one window as state, however many events a hot key has. ``by=None`` limits all events together.
    """
    cols = events.select(F.col(key).alias("event_id"), (F.col(by).cast("string") if by else F.lit("all")).alias("who"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))

    def run(batches):
        who, state = object(), None
        for df in batches:
            out = []
            for e, w, t in zip(df["event_id"], df["who"], df["t"], strict=True):
                if w != who:
                    who, state = w, Limiter(most, window, gap)
                out.append((e, w, *state.acquire(t / 1e6)))
            yield pd.DataFrame(out, columns=["event_id", "who", "accepted", "retry_after"])

    ordered = cols.where("t is not null").repartition("who").sortWithinPartitions("who", "t", "event_id")
    return ordered.mapInPandas(run, "event_id bigint, who string, accepted boolean, retry_after double")


def sessions(events: DataFrame, ttl: float, by: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """``key, by, session``: a session ends when nothing came for ``ttl`` seconds or more (exactly ``ttl`` ends it)."""
    order = Window.partitionBy(by).orderBy(ts, key)
    idle = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(order)
    return events.withColumn("_new", F.coalesce((idle >= int(ttl * 1_000_000)).cast("int"), F.lit(1))).withColumn("session", F.sum("_new").over(order)).drop("_new")


def within_budget(items: DataFrame, size: str, order: list[str], per_item: int, most_items: int, total: int, by: list[str] | None = None) -> DataFrame:
    """Adds running ``items_so_far`` and ``bytes_so_far`` and the first broken limit as ``problem`` (NULL if none)."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    run = items.withColumn("items_so_far", F.row_number().over(w)).withColumn("bytes_so_far", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("problem", F.when(~F.coalesce(F.col(size) >= 0, F.lit(False)), "size").when(F.col(size) > per_item, "item_bytes").when(F.col("items_so_far") > most_items, "item_count").when(F.col("bytes_so_far") > total, "total_bytes"))


def breaker_runs(outcomes: DataFrame, failed: Column, by: list[str], order: list[str], trip: int = 3) -> DataFrame:
    """Runs of consecutive failures per key (gaps and islands): ``by, run_start, run_length, tripped``."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = outcomes.withColumn("_f", F.coalesce(failed, F.lit(False)))
    df = df.withColumn("_island", F.sum((~F.col("_f")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.where("_f").groupBy(*by, "_island").agg(F.min(order[0]).alias("run_start"), F.count("*").alias("run_length")).withColumn("tripped", F.col("run_length") >= trip).drop("_island")


def allowed_ids(texts: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``ids``: positive 64-bit ids parted by blanks, commas or semicolons; NULL if any is bad or none is there."""
    parts = F.filter(F.split(F.col(column), r"[\s,;]+"), lambda x: x != "")
    good = F.forall(parts, lambda x: x.rlike(r"^[1-9][0-9]*$") & x.try_cast("bigint").isNotNull()) & (F.size(parts) > 0)
    return texts.withColumn("ids", F.when(good, F.array_distinct(F.transform(parts, lambda x: x.try_cast("bigint")))))


def authorized(events: DataFrame, ids: DataFrame, by: str = "user_id") -> DataFrame:
    return events.where(F.col(by) > 0).join(ids.select(F.col("id").cast("bigint").alias(by)).distinct(), by, "left_semi")
