"""Queries that send a table through a stream with state and read back what it filled, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions.lineage import shared_folder
from cliploom.plans.fixtures import Views
from cliploom.plans.oracles import sql
from cliploom.streaming import state

HOURS = 3_600
TAIL = 2_000


class Streamed(Views):
    """The same views over tables that are read as streams."""

    def table(self, name: str) -> DataFrame:
        # a pattern, as a stream reads folders and patterns, and the table may be one file
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.parque[t]")


def _folder(v: Views) -> str:
    return f"{shared_folder(v.spark)}/streams/{uuid.uuid4().hex}"


def r1_tail(v: Views) -> DataFrame:
    e = Streamed(v.spark, v.sf_dir).events().select(F.col("event_id").alias("id"), "event_type", "job_id")
    folder = _folder(v)
    state.tail_table(e, f"{folder}/rows", f"{folder}/checkpoint", TAIL).awaitTermination()
    return state.read_tail(v.spark, f"{folder}/rows", after=1000, keep=TAIL)


def r2_latest(v: Views) -> DataFrame:
    e = Streamed(v.spark, v.sf_dir).events().select(F.col("job_id").alias("job"), (F.col("event_id") % 1009).alias("version"), F.col("event_type").alias("status"))
    with state.rocksdb(v.spark, idle_batches=False):
        rows = state.drained(state.latest_states(e, terminal=("purchase",)), _folder(v), "update")
    last = rows.groupBy("job").agg(F.max_by(F.struct("version", "status"), "batch").alias("s"))
    return last.select("job", "s.version", "s.status")


def r5_lost(v: Views) -> DataFrame:
    """Users silent for over twelve hours; the last sign of each is told only by the watermark, so it is left to it."""
    e = Streamed(v.spark, v.sf_dir).events().select(F.col("job_id").alias("job"), F.timestamp_micros(F.col("us") + 1_704_067_200_000_000).alias("at")).withWatermark("at", "1 second")
    with state.rocksdb(v.spark):
        rows = state.drained(state.lost_jobs(e, 12 * HOURS), _folder(v))
    return rows.select("job", F.unix_millis("lost_at").alias("lost_ms"))


def r6_stable(v: Views) -> DataFrame:
    """Each user's file, seen at every event, with the size and time that the event's kind stands for."""
    e = Streamed(v.spark, v.sf_dir).events()
    kind = F.length("event_type").cast("long")
    seen = e.select(F.concat(F.lit("in/"), "job_id", F.lit(".mp4")).alias("path"), kind.alias("size"), (kind * 7).alias("mtime"), (F.col("us") * 1000 + F.col("event_id") % 1000).alias("seen_at"))
    with state.rocksdb(v.spark):
        return state.drained(state.stable_files(seen), _folder(v)).drop("batch")


#: name: (query over Views, SQL or None)
QUERIES = {
    "r1_tail_stream": (r1_tail, sql(f"SELECT event_id AS id, event_type, job_id FROM ev WHERE event_id > 1000 AND event_id > (SELECT max(event_id) FROM ev) - {TAIL}")),
    "r2_latest_state_stream": (r2_latest, sql("SELECT job_id AS job, max(event_id % 1009) AS version, arg_max(event_type, {'a': event_id % 1009, 'b': event_type}) AS status FROM ev GROUP BY 1")),
    "r5_lost_jobs_stream": (
        r5_lost,
        sql(
            f"SELECT job_id AS job, sign + {12 * HOURS * 1000} AS lost_ms FROM (SELECT job_id, sign, lead(sign) OVER (PARTITION BY job_id ORDER BY sign) AS nxt, max(sign) OVER () AS newest FROM (SELECT job_id, epoch_us(ts) // 1000 AS sign FROM ev))"
            f" WHERE coalesce(nxt, newest - 1000) - sign > {12 * HOURS * 1000} OR nxt IS NULL AND newest - 1000 - sign = {12 * HOURS * 1000}"
        ),
    ),
    "r6_stable_files_stream": (
        r6_stable,
        sql(
            "SELECT path, CAST(size AS BIGINT) AS size, CAST(size * 7 AS BIGINT) AS mtime, min(seen_at) AS seen_at FROM (SELECT *, lag(size) OVER (PARTITION BY path ORDER BY seen_at, size) AS p,"
            " row_number() OVER (PARTITION BY path ORDER BY seen_at, size) AS r FROM (SELECT 'in/' || job_id || '.mp4' AS path, length(event_type) AS size, us * 1000 + event_id % 1000 AS seen_at FROM ev)) WHERE p = size"
            " GROUP BY path, size QUALIFY row_number() OVER (PARTITION BY path ORDER BY min(seen_at), size) = 1"
        ),
    ),
}
