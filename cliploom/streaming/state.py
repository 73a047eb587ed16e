"""Streams with state of their own that ends: latest states, lost jobs, files that stopped growing; and a
tail table that takes every batch once.

The processors keep one small value a key in RocksDB, so what is held grows with the keys that are alive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from cliploom.streaming.jobs import tail_events

#: Statuses behind which a job's state isn't needed any more (fixed values).
TERMINAL = ("needs_review", "done", "failed", "canceled")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession, idle_batches: bool = True) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB. Without idle_batches only new rows make a batch: a
    query with timers of the wall clock would else never come to an end when it is drained."""
    own = {_PROVIDER: _ROCKS, _IDLE: str(idle_batches).lower()}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class _Latest(StatefulProcessor):
    def __init__(self, idle_ms: int | None, linger_ms: int, terminal: tuple[str, ...]):
        self.idle_ms, self.linger_ms, self.terminal = idle_ms, linger_ms, terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "version long, status string", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = before = self.latest.get() if self.latest.exists() else None
        for pdf in rows:
            own = max(zip(pdf["version"].tolist(), pdf["status"].tolist(), strict=True))
            best = own if best is None or own > tuple(best) else best
        if best != before:
            self.latest.update(tuple(best))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if best[1] in self.terminal:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.linger_ms)
            yield pd.DataFrame({"job": [key[0]], "version": [best[0]], "status": [best[1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.latest.clear()
        yield from ()

    def close(self) -> None:
        pass


def latest_states(stream: DataFrame, idle_seconds: int | None = None, linger_seconds: int = 3600, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """stream (job, version, status) -> the same columns, a row whenever a job's latest state rises.

    A lower version, or an equal one with a status that isn't greater, changes nothing. The state of a
    job goes `linger_seconds` after it has come to an end, by a timer, so that stragglers within that
    time are still told apart; `idle_seconds` ends the state of jobs nobody has heard of for so long. For
    update mode, inside rocksdb(), without idle batches where the stream is drained.
    """
    idle = None if idle_seconds is None else idle_seconds * 1000
    return stream.select("job", "version", "status").groupBy("job").transformWithStateInPandas(
        _Latest(idle, linger_seconds * 1000, terminal), f"job {stream.schema['job'].dataType.simpleString()}, version long, status string", "Update", "ProcessingTime"
    )


class _Lost(StatefulProcessor):
    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def _rows(self, key, at: list[int]) -> Iterator[pd.DataFrame]:
        if at:
            yield pd.DataFrame({"job": [key[0]] * len(at), "lost_ms": at})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        signs = sorted(int(x) for pdf in rows for x in pdf["at_ms"])
        lost = []
        for at in signs:
            if last is not None and at - last > self.after_ms:
                lost.append(last + self.after_ms)
            last = at if last is None else max(last, at)
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.after_ms)
        yield from self._rows(key, lost)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = self.last.get()[0] + self.after_ms
        self.last.clear()
        yield from self._rows(key, [at])

    def close(self) -> None:
        pass


def lost_jobs(stream: DataFrame, seconds: int = 30) -> DataFrame:
    """stream (job, at timestamp), watermarked on at -> (job, lost_at): each time a job gave no sign for longer
    than so many seconds, told by its next sign or by the watermark, whichever comes first.

    Only jobs that may still be lost have state. For append mode, inside rocksdb().
    """
    # whole milliseconds in the processor, which no session's time zone shifts
    rows = stream.select("job", "at", F.unix_millis("at").alias("at_ms")).groupBy("job").transformWithStateInPandas(
        _Lost(seconds * 1000), f"job {stream.schema['job'].dataType.simpleString()}, lost_ms long", "Append", "EventTime"
    )
    return rows.select("job", F.timestamp_millis("lost_ms").alias("lost_at"))


class _Stable(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "size long, mtime long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        size, mtime, told = self.seen.get() if self.seen.exists() else (None, None, False)
        out = []
        for at, new, when in sorted(r for pdf in rows for r in zip(pdf["seen_at"], pdf["size"], pdf["mtime"], strict=True)):
            if not told and size == new and mtime == when:
                told = True
                out.append((key[0], int(new), int(when), at))
            size, mtime = int(new), int(when)
        self.seen.update((size, mtime, told))
        if out:
            yield pd.DataFrame(out, columns=["path", "size", "mtime", "seen_at"])

    def close(self) -> None:
        pass


def stable_files(sightings: DataFrame) -> DataFrame:
    """sightings (path, size, mtime in seconds, seen_at) -> the sighting in which a file first looks as it did the time
    before: it is written to no more. Each path once. For append mode, inside rocksdb()."""
    kinds = ", ".join(f"{c} {sightings.schema[c].dataType.simpleString()}" for c in ("path", "size", "mtime", "seen_at"))
    return sightings.select("path", "size", "mtime", "seen_at").groupBy("path").transformWithStateInPandas(_Stable(), kinds, "Append", "None")


# ---- tables that streams fill ----


def into(path: str, then: Callable[[SparkSession, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """What foreachBatch needs to append to a Parquet table: a batch has a folder named by its number, so one
    that runs twice is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then is not None:
            then(batch.sparkSession, number)

    return write


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there to read, through the stream into a table below folder; `batch` is the batch's number."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(into(f"{folder}/rows"))
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


def prune_tail(spark: SparkSession, path: str, keep: int) -> None:
    """Deletes batches whose every id is `keep` or more behind the newest. The others hold one of the newest
    ids each, so the driver sees no more than `keep` rows of the table's (batch, greatest id)."""
    per = spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy("batch").agg(F.max("id").alias("id")).collect()
    newest = max((r["id"] for r in per if r["id"] is not None), default=None)
    for r in per:
        if newest is not None and (r["id"] is None or r["id"] <= newest - keep):
            there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={r['batch']}")
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def tail_table(stream: DataFrame, path: str, checkpoint: str, keep: int = 500, **trigger) -> StreamingQuery:
    """Starts a stream of events (id, ...) into the table below path, of which the newest `keep` ids stay."""
    write = into(path, lambda spark, _: prune_tail(spark, path, keep))
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def read_tail(spark: SparkSession, path: str, after: int = 0, keep: int = 500) -> DataFrame:
    """Events of a tail table behind an id, no older than the newest `keep` ids."""
    return tail_events(spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch"), after, keep)


def record_sighting(spark: SparkSession, root: str, path: str) -> None:
    """Appends what lies below root now to a table of sightings; no content is read."""
    from cliploom.sources.files import media_catalog

    seen = media_catalog(spark, root).select("path", "size", F.unix_timestamp("modified_at").alias("mtime"), F.current_timestamp().alias("seen_at"))
    seen.write.mode("append").parquet(path)
