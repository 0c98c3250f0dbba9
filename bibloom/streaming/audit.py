"""The audit log as a stream: following it, and error summaries by time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, folder: str, schema: T.StructType, files_at_a_time: int = 50) -> DataFrame:
    """New Parquet files of a folder as they arrive, each row once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(folder)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks bound the state of streams; they need times with a zone."""
    if not events.isStreaming:
        return events
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def counts_by_window(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) of tumbling windows; works on batches and, with a watermark that bounds
    the state, on streams."""
    timed = _timed(events, time, late)
    return timed.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, start, finish, n) of runs of events without a longer gap."""
    timed = _timed(events, time, late)
    grouped = timed.groupBy(user, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def export_lines(events: DataFrame, as_csv: bool = False) -> DataFrame:
    """(created_at, line) of audit events (created_at, stage, level, tag, message, record_001) in
    order of time, as plain text or as cells of CSV."""
    time = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if as_csv:
        quoted = lambda v: F.when(v.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
        line = F.concat_ws(",", time, *(quoted(blank(c)) for c in ("stage", "level", "tag", "message", "record_001")))
    else:
        stage = F.when(blank("stage") != "", F.concat(F.lit("[stage "), blank("stage"), F.lit("]"))).otherwise("[global]")
        line = F.concat_ws("  ", time, stage, blank("tag"), F.concat(F.lit("["), F.upper("level"), F.lit("]")), blank("message"))
    return events.select("created_at", line.alias("line")).orderBy("created_at", "line")


def recent_summary(events: DataFrame, since: str, time: str = "ts", kind: str = "event_type") -> DataFrame:
    """(kind, n, latest) of events since a time, the most frequent first."""
    some = events.where(F.col(time) >= F.lit(since).cast("timestamp"))
    return some.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("latest")).orderBy(F.col("n").desc(), kind)


def error_count(events: DataFrame, now: Column, hours: int = 24, time: str = "created_at", level: str = "level") -> DataFrame:
    """One row: events of level error in the last hours before ``now``, its beginning included."""
    since = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    return events.agg(F.count_if((F.col(level) == "error") & (F.col(time) >= since)).alias("errors"))


# ---- tasks that went quiet

def stalled_tasks(events: DataFrame, now: Column, quiet_sec: int = 3600) -> DataFrame:
    """(task_id, kind, last_at, quiet_sec) of the tasks in a log (task_id, kind, at, status) whose last
    event isn't their end (status done or failed) and is longer ago than ``quiet_sec`` at ``now``."""
    last = events.groupBy("task_id").agg(F.max_by(F.struct("kind", "status", "at"), F.struct("at", "status")).alias("e"))
    quiet = F.unix_timestamp(now) - F.unix_timestamp("e.at")
    return last.where(~F.col("e.status").isin(*ENDS) & (quiet > quiet_sec)).select("task_id", "e.kind", F.col("e.at").alias("last_at"), quiet.alias("quiet_sec"))


#: Statuses after which a task says nothing more.
ENDS = ("done", "failed")


def watch_stalled(events: DataFrame, quiet_sec: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(task_id, kind, last_at) of a stream, as it happens: a row once the watermark has passed a task's last event by
    ``quiet_sec``, without the log being read again. A task that speaks again is watched anew.

    State is the last event of each task that hasn't ended; ended and reported ones are forgotten.
    """
    timed = _timed(events, "at", late)
    timed = timed.withColumn("micros", F.unix_micros(F.col("at").cast("timestamp")))

    def follow_one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            kind, at = state.get
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "kind": [kind], "micros": [at]})
            return
        last = state.get if state.exists else (None, -1)
        ended = False
        for batch in batches:
            for kind, at, status in zip(batch["kind"], batch["micros"], batch["status"], strict=True):
                if at >= last[1]:
                    last, ended = (kind, int(at)), status in ENDS
        if ended:
            state.remove()
        else:
            state.update(last)
            # a time that the watermark has passed already can't be waited for: the next one is
            state.setTimeoutTimestamp(max(last[1] // 1000 + quiet_sec * 1000, state.getCurrentWatermarkMs() + 1))

    found = timed.groupBy("task_id").applyInPandasWithState(follow_one, "task_id string, kind string, micros bigint", "kind string, at bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("task_id", "kind", F.timestamp_micros("micros").alias("last_at"))
