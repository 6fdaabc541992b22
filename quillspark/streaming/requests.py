"""Streaming operators; each takes a streaming or a batch DataFrame.

The reference behaviour has no late data rule: a watermark of ten minutes is this engine's choice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE, ONCE, IDLE, ROLL_UP = "10 minutes", "2100 seconds", "12 hours", "30 minutes"


def once_each(requests: DataFrame, key: str = "request_id", ts: str = "ts") -> DataFrame:
    """A stream of requests without repeats of a key within 2100 seconds."""
    return requests.withWatermark(ts, ONCE).dropDuplicatesWithinWatermark([key])


def idle_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions that end after twelve idle hours."""
    base = events.withWatermark(ts, LATE) if events.isStreaming else events
    s = F.session_window(ts, IDLE)
    return base.groupBy(key, s).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expires"), "n")


def error_windows(events: DataFrame, kind: str = "event_type", ts: str = "ts") -> DataFrame:
    """Counts by kind in half-hour windows."""
    base = events.withWatermark(ts, LATE) if events.isStreaming else events
    return base.groupBy(F.window(ts, ROLL_UP), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("started"), kind, "n")


def kept_steps(steps: DataFrame, kind: str = "event_type", unkept: tuple[str, ...] = ("heartbeat", "final")) -> DataFrame:
    """The step events that are stored: all but heartbeats and the final one; those of unknown kind stay."""
    return steps.where(F.coalesce(~F.col(kind).isin(*unkept), F.lit(True)))


def rules_in_force(ops: DataFrame, key: str = "session") -> DataFrame:
    """A stream of (session, rule, op, content, at) as (session, rule, op, content, at): the last operation of each rule so far, in update mode.

    REMOVE rows are kept so that a later view drops the rule; a group's state is one row whatever its number of operations.
    """
    last = F.max(F.struct("at", "op", "content"))
    return ops.groupBy(key, "rule").agg(last.alias("x")).select(key, "rule", "x.op", "x.content", "x.at")


def _entry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's entry: its last access and how often it was hit; it times out when it was idle too long."""
    idle = int(pd.Timedelta(IDLE).total_seconds() * 1000)
    if state.hasTimedOut:
        last, hits = state.get
        state.remove()
        yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="ms"), hits, "expired")], columns=["key", "last", "hits", "event"])
        return
    times = [t for batch in batches for t in batch["ts"]]
    newest = int(max(times).timestamp() * 1000)
    last, hits = state.get if state.exists else (0, 0)
    event = "hit" if state.exists else "opened"
    state.update((max(last, newest), hits + len(times)))
    state.setTimeoutTimestamp(max(last, newest) + idle)
    yield pd.DataFrame([(key[0], pd.Timestamp(max(last, newest), unit="ms"), hits + len(times), event)], columns=["key", "last", "hits", "event"])


def expiring_entries(accesses: DataFrame, key: str = "session", ts: str = "ts") -> DataFrame:
    """A stream of accesses as (key, last, hits, event): an entry is opened, hit, and expired after IDLE without access.

    A stateful stream: a key's state is one row, and it ends with the watermark. The bound on entries is that of ``ingest.cache_entries``.
    """
    base = accesses.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts")).withWatermark("ts", LATE)
    return base.groupBy("key").applyInPandasWithState(_entry, "key string, last timestamp, hits long, event string", "last long, hits long", "append", GroupStateTimeout.EventTimeTimeout)
