"""Live tables about jobs, as streams; every operator also runs on a batch table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Moves of a publish attempt (fixed values).
EDGES = (
    ("draft", "validating"),
    ("validating", "uploading"),
    ("validating", "failed"),
    ("uploading", "processing"),
    ("uploading", "published"),
    ("uploading", "failed"),
    ("processing", "published"),
    ("processing", "failed"),
    ("failed", "validating"),
    ("failed", "uploading"),
)
#: Moves of a job outside its stages: where each status may go (fixed values).
JOB_MOVES = {
    "pending": ("queued", "failed", "canceled"),
    "queued": ("paused", "failed", "canceled", "needs_review", "done"),
    "paused": ("queued", "failed", "canceled"),
    "needs_review": ("queued", "done", "failed", "canceled"),
    "done": ("queued", "needs_review", "failed", "canceled"),
    "failed": ("queued", "needs_review", "canceled"),
    "canceled": ("queued", "needs_review"),
    "canceling": ("canceled", "failed"),
}
JOB_EDGES = tuple((a, b) for a, after in JOB_MOVES.items() for b in after)


def tail_events(events: DataFrame, after: int, keep: int = 500) -> DataFrame:
    """Events behind an id, no older than the newest `keep` ids. The newest id is one row."""
    newest = events.agg(F.max("id").alias("_newest"))
    return events.filter(F.col("id") > after).join(F.broadcast(newest)).filter(F.col("id") > F.col("_newest") - keep).drop("_newest")


def latest_state(updates: DataFrame) -> DataFrame:
    """The row of the highest version of each job; runs on batch tables and, in update or complete
    mode, on streams. Later rows of lower versions change nothing."""
    return updates.groupBy("job").agg(
        F.max("version").alias("version"), F.max_by("status", F.struct("version", "status")).alias("status")
    )


def check_transitions(events: DataFrame, key: str, order: list[str], edges: tuple = EDGES) -> DataFrame:
    """Adds allowed: whether each status may follow the one before it, in one of the two machines."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(*order))
    ok = F.lit(False)
    for a, b in edges:
        ok = ok | ((F.col("_before") == a) & (F.col("status") == b))
    return events.withColumn("_before", before).withColumn("allowed", F.col("_before").isNull() | ok).drop("_before")


def accepted_transitions(stream: DataFrame) -> DataFrame:
    """stream (key, seq, status) -> (key, seq, status, allowed): each move against the last accepted status."""

    def move(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        allowed = []
        for s in rows["status"]:
            ok = last is None or (last, s) in EDGES
            allowed.append(ok)
            last = s if ok else last
        state.update((last,))
        yield rows.assign(allowed=allowed)[["key", "seq", "status", "allowed"]]

    return stream.groupBy("key").applyInPandasWithState(
        move, "key long, seq long, status string, allowed boolean", "last string", "append", GroupStateTimeout.NoTimeout
    )


def upload_progress(events: DataFrame, order: list[str]) -> DataFrame:
    """Bytes that never fall and never exceed the total."""
    run = Window.partitionBy("attempt_id").orderBy(*order)
    return events.withColumn("uploaded_bytes", F.least("total_bytes", F.max("uploaded_bytes").over(run)))


def upload_totals(stream: DataFrame) -> DataFrame:
    """The streaming form: the furthest each attempt got."""
    return stream.groupBy("attempt_id").agg(
        F.least(F.max("uploaded_bytes"), F.max("total_bytes")).alias("uploaded_bytes")
    )


def heartbeat_timeout(stream: DataFrame, seconds: int = 30) -> DataFrame:
    """stream (job, at timestamp), watermarked on at -> (job, lost_at): jobs without a sign for so long."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "lost_at": [pd.Timestamp(last + seconds * 1000, unit="ms")]})
            return
        last = state.get[0] if state.exists else 0
        for pdf in batches:
            last = max(last, int(pdf["at"].max().timestamp() * 1000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": [], "lost_at": []}).astype({"job": "int64", "lost_at": "datetime64[ns]"})

    return stream.groupBy("job").applyInPandasWithState(
        watch, "job long, lost_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def stable_media(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Files that look the same in two sightings (path, size, mtime): they are written to no more."""
    return later.join(earlier, ["path", "size", "mtime"], "left_semi")
