"""Channels of events: each job's events are numbered without gaps, its newest are held for replay, and a closed job expires.

The log of numbered events is the buffer. The state of a stream is three
numbers a job; which events a job holds follows from its last number.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.streaming.progress import RING, _watermarked

# Fixed value: minutes that a closed job's channel stays.
KEEP_MINUTES = 30


def arrivals(events: DataFrame, terminal: tuple[str, ...] = ("error",), keep_minutes: int = KEEP_MINUTES, late: str = "1 minute") -> DataFrame:
    """(job_id, opened_at, seq, event_id, event_type, ts) of a stream's events, numbered from 1 as they arrive.

    Events that arrive together are numbered by time and id. The earliest
    terminal event closes the channel; later ones are still numbered until
    ``keep_minutes`` of event time after it. Then the channel goes, and an event
    that comes later opens a new one, numbered from 1 with its own
    ``opened_at``. Events without a job or a time are left out, and so are those
    later than ``late`` behind the stream.
    """

    def track(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        opened, closed, n = state.get if state.exists else (-1, -1, 0)
        for rows in batches:
            rows = rows.sort_values(["micros", "event_id"])
            opened = int(rows["micros"].iloc[0]) if opened < 0 else opened
            ends = rows.loc[rows["ends"], "micros"]
            if len(ends):
                closed = int(ends.min()) if closed < 0 else min(closed, int(ends.min()))
            yield pd.DataFrame(
                {"job_id": [key[0]] * len(rows), "opened": opened, "seq": range(n + 1, n + 1 + len(rows)), "event_id": rows["event_id"], "event_type": rows["event_type"], "micros": rows["micros"]}
            )
            n += len(rows)
        state.update((opened, closed, n))
        if closed >= 0:
            state.setTimeoutTimestamp(max(closed // 1000 + keep_minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    rows = _watermarked(events.where("job_id IS NOT NULL AND ts IS NOT NULL"), late)
    ends = F.coalesce(F.col("event_type").isin(*terminal), F.lit(False)).alias("ends")
    rows = rows.select("job_id", "ts", "event_id", "event_type", F.unix_micros("ts").alias("micros"), ends)
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("job_id", "event_id", "event_type")}
    out = rows.groupBy("job_id").applyInPandasWithState(
        track, f"job_id {kinds['job_id']}, opened bigint, seq bigint, event_id {kinds['event_id']}, event_type {kinds['event_type']}, micros bigint",
        "opened bigint, closed bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return out.select("job_id", F.timestamp_micros("opened").alias("opened_at"), "seq", "event_id", "event_type", F.timestamp_micros("micros").alias("ts"))


def held(log: DataFrame, keep: int = RING) -> DataFrame:
    """The newest ``keep`` events of each job's last channel, of a log of numbered events.

    A job's last number tells them, so no job is sorted; logs without ``opened_at`` have one channel a job.
    """
    place = F.struct("opened_at", "seq") if "opened_at" in log.columns else F.struct("seq")
    last = log.groupBy("job_id").agg(F.max(place).alias("last"))
    kept = log.join(last, "job_id").where(F.col("seq") > F.col("last.seq") - keep)
    return (kept.where(F.col("opened_at") == F.col("last.opened_at")) if "opened_at" in log.columns else kept).drop("last")


def tail(history: DataFrame, live: DataFrame, late: str = "2 days") -> DataFrame:
    """Events of ``live``, a batch or a stream, that a subscriber who has replayed ``history`` has not had; each once."""
    fresh = _watermarked(live, late).dropDuplicates(["job_id", "seq", "ts"])
    return fresh.join(history.select("job_id", "seq"), ["job_id", "seq"], "left_anti")


def replay_then_tail(log: DataFrame, live: DataFrame, keep: int = RING) -> DataFrame:
    """What a subscriber gets of batches: the events held, then those of ``live`` that weren't among them."""
    replayed = held(log, keep)
    return replayed.unionByName(tail(replayed, live).select(*replayed.columns))
