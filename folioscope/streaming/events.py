"""Event streams: windows, first sights, stage pairing and state, each with its batch counterpart."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a file's status may turn to.
NEXT_STATUS = {"pending": ("parsing", "failed"), "parsing": ("indexing", "failed"), "indexing": ("ready", "failed"), "ready": (), "failed": ("pending",)}
IN_FLIGHT = ("parsing", "indexing")


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A replayable stream of event files, from the first on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; late rows past the watermark are dropped in streams."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of users: events with less than the gap between them."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def stage_pairs(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Starts (run, stage, phase, ts) with their dones, by a stream-stream join with a bound on time."""
    a = events.filter("phase = 'start'").select("run", "stage", F.col("ts").alias("start_ts")).withWatermark("start_ts", late)
    b = events.filter("phase = 'done'").select(F.col("run").alias("r"), F.col("stage").alias("s"), F.col("ts").alias("done_ts")).withWatermark("done_ts", late)
    j = a.join(b, F.expr("run = r AND stage = s AND done_ts >= start_ts AND done_ts <= start_ts + INTERVAL 1 HOUR"))
    return j.select("run", "stage", "start_ts", "done_ts", (F.unix_millis("done_ts") - F.unix_millis("start_ts")).alias("elapsed_ms"))


def _novel(keep_us: int):
    """The state is when an item was seen last; its timer ends it once the watermark is past that by the time to keep."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        us = np.sort(np.concatenate([pdf["us"].to_numpy(np.int64) for pdf in parts]))
        before = np.concatenate([us[:1] if last is None else [last], us[:-1]])
        new = us - before > keep_us
        new[0] |= last is None
        last = int(max(us[-1], before[0]))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + keep_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run": key[0], "item": key[1], "us": us, "is_new": new})

    return run


def novelty(events: DataFrame, keep: timedelta = timedelta(days=7), late: str = "1 hour") -> DataFrame:
    """(run, ts, item, is_new): whether an item is new to its run, or was last seen longer ago than `keep`; across batches.

    The state is one mark for each item of a run seen within `keep`: a timer drops it when the watermark, `late` behind
    the newest event, is past. What is dropped would count as new again anyway, so batches of events that come in
    order change no result. Of rows of one batch the earliest is new. Rows without a time are left out, as are
    rows behind the watermark.
    """
    seen = events.filter("ts IS NOT NULL").withWatermark("ts", late).select("run", "item", "ts", F.unix_micros("ts").alias("us"))
    out = "run string, item string, us bigint, is_new boolean"
    marked = seen.groupBy("run", "item").applyInPandasWithState(_novel(keep // timedelta(microseconds=1)), out, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return marked.select("run", F.timestamp_micros("us").alias("ts"), "item", "is_new")


def _status(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get[0] if state.exists else "pending"
    rows = []
    # A file's steps of one batch may come in several parts: their order is that of all of them.
    for at, to in sorted(step for pdf in parts for step in zip(pdf["ts"], pdf["status"], strict=True)):
        ok = to in NEXT_STATUS.get(now, ())
        rows.append((key[0], at, now, to, ok))
        now = to if ok else now
    state.update((now,))
    yield pd.DataFrame(rows, columns=["file_id", "ts", "status_from", "status_to", "allowed"])


def status_changes(events: DataFrame) -> DataFrame:
    """(file_id, ts, status_from, status_to, allowed): steps of each file's state machine."""
    return events.groupBy("file_id").applyInPandasWithState(
        _status, "file_id string, ts timestamp, status_from string, status_to string, allowed boolean", "status string", "append", GroupStateTimeout.NoTimeout
    )


def reconcile(files: DataFrame) -> DataFrame:
    """After a crash: rows in flight are failed with a reason."""
    lost = F.col("status").isin(*IN_FLIGHT)
    return files.withColumn("error_msg", F.when(lost, "interrupted").otherwise(F.col("error_msg"))).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now and ends. The checkpoint folder must be shared by all executors."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
