"""Ingestion progress: batch forms and their Structured Streaming counterparts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators.ordered import in_blocks, with_before, with_blocks

RING = 500


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """Streams need instants; a batch keeps its times as they are."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late)


def numbered(events: DataFrame) -> DataFrame:
    """Events with a gap-free number within their job; a job of many events is numbered in many tasks."""
    rows = with_before(in_blocks(events, "job_id", "ts", "event_id"), "job_id", ["ts", "event_id"], F.lit(1))
    return rows.withColumn("seq", F.col("before") + 1).drop("before", "block")


def ring_buffer(events: DataFrame, keep: int = RING) -> DataFrame:
    """The newest ``keep`` events of each job."""
    newest = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= keep)


def latest_state(events: DataFrame) -> DataFrame:
    """(job_id, file_id, state, n_events, total): the last event of each file and running totals; mergeable, so it streams."""
    return events.groupBy("job_id", "file_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")
    )


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(job_id, start, n_events): events of each window; streams drop what is later than ``late``."""
    counts = _watermarked(events, late).groupBy("job_id", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n_events"))
    return counts.select("job_id", F.col("window.start").alias("start"), "n_events")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "2 days") -> DataFrame:
    """(job_id, start, n_events): runs of a job's events with pauses below ``gap``; events without a time are in none.

    A batch splits jobs of many events over tasks; a stream keeps open sessions as state.
    """
    if not events.isStreaming:
        return _batch_sessions(events.where(F.col("ts").isNotNull()), gap)
    counts = _watermarked(events, late).groupBy("job_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_events"))
    return counts.select("job_id", F.col("session_window.start").alias("start"), "n_events")


def _batch_sessions(events: DataFrame, gap: str) -> DataFrame:
    blocked = in_blocks(events.groupBy("job_id", "ts").agg(F.count(F.lit(1)).alias("n")), "job_id", "ts")
    ends = blocked.groupBy("job_id", "block").agg(F.max("ts").alias("end"))
    ends = ends.select("job_id", "block", F.lag("end").over(Window.partitionBy("job_id").orderBy("block")).alias("end_before"))
    last = F.coalesce(F.lag("ts").over(Window.partitionBy("job_id", "block").orderBy("ts")), F.col("end_before"))
    opens = with_blocks(blocked, ends, "job_id").withColumn("last", last)
    opens = opens.withColumn("opens", F.when(F.col("ts") < F.col("last") + F.expr(f"INTERVAL {gap}"), 0).otherwise(1))
    number = (F.col("before") + F.col("opens")).alias("number")
    rows = with_before(opens, "job_id", ["ts"], F.col("opens")).select("job_id", "ts", "n", number)
    return rows.groupBy("job_id", "number").agg(F.min("ts").alias("start"), F.sum("n").alias("n_events")).drop("number")


def distinct_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event of a job once, also where it is delivered again."""
    return _watermarked(events, late).dropDuplicates(["job_id", "event_id", "ts"])


def closed_jobs(events: DataFrame, terminal: tuple[str, ...] = ("error",), keep_minutes: int = 30, late: str = "1 minute") -> DataFrame:
    """(job_id, closed_at, n_events, n_late) of a stream's closed jobs, each when it goes out of state.

    The earliest terminal event closes a job. Events that come after are counted
    too, and as late where their time is after the close known by then. A closed
    job goes ``keep_minutes`` of event time after its close; an event of
    it that comes still later opens it anew. State is a few numbers a job,
    however many its events. Events without a job or a time are left out.
    """

    def track(key: tuple, batches, state: GroupState):
        closed, n, n_late = state.get if state.exists else (-1, 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "closed_ms": [closed], "n_events": [n], "n_late": [n_late]})
            return
        for rows in batches:
            ends = rows.loc[rows["ends"], "ms"]
            if len(ends):
                closed = int(ends.min()) if closed < 0 else min(closed, int(ends.min()))
            n += len(rows)
            n_late += int((rows["ms"] > closed).sum()) if closed >= 0 else 0
        state.update((closed, n, n_late))
        if closed >= 0:
            state.setTimeoutTimestamp(max(closed + keep_minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    rows = _watermarked(events.where("job_id IS NOT NULL AND ts IS NOT NULL"), late)
    rows = rows.select("job_id", "ts", F.unix_millis("ts").alias("ms"), F.coalesce(F.col("event_type").isin(*terminal), F.lit(False)).alias("ends"))
    numbers = "n_events bigint, n_late bigint"
    kind = events.schema["job_id"].dataType.simpleString()
    out = rows.groupBy("job_id").applyInPandasWithState(
        track, f"job_id {kind}, closed_ms bigint, {numbers}", f"closed_ms bigint, {numbers}", "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.select("job_id", F.timestamp_millis("closed_ms").alias("closed_at"), "n_events", "n_late")


def replay(source: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, mode: str = "append"):
    """Run a streaming transform over all that is there and stop."""
    query = transform(source).writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    query = query.format("parquet").option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def follow(source: DataFrame, keys: list[str], path: str, checkpoint: str):
    """A change feed written at least once: each batch lands in its own folder, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
