"""A library of recordings as tables that are written once, bucketed and sorted by job.

Joins, groupings and windows by job on these tables need no exchange: both sides lie in the same buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from threading import RLock

from pyspark.sql import DataFrame, SparkSession

from cliploom.functions.lineage import shared_folder

#: Sort columns of each table, behind the job. spoken: segments with their words as an array.
TABLES = {
    "durations": (),
    "invalid": ("start_ms", "end_ms"),
    "clips": ("idx",),
    "scenes": ("time_ms",),
    "highlights": ("start_ms",),
    "segments": ("start_ms", "seg_idx"),
    "spoken": ("start_ms", "seg_idx"),
}


class Library:
    """Bucketed tables by name; drop() removes them and their files. Those that wait are written when first asked for."""

    def __init__(self, spark: SparkSession, prefix: str, path: str, names: list[str], waiting: dict | None = None, buckets: int = 1):
        self.spark, self.prefix, self.path, self.names = spark, prefix, path, names
        self._waiting, self._buckets, self._lock = waiting or {}, buckets, RLock()

    def __getitem__(self, name: str) -> DataFrame:
        with self._lock:
            if name in self._waiting:
                df = self._waiting[name]
                df = df(self) if callable(df) else df
                df, *then = df if isinstance(df, tuple) else (df,)
                write_table(df, f"{self.prefix}_{name}", f"{self.path}/{name}", TABLES.get(name, ()), self._buckets, *then)
                del self._waiting[name]
                self.names.append(name)
        return self.spark.table(f"{self.prefix}_{name}")

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")
        there = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)


def write_table(df: DataFrame, name: str, path: str, sort: tuple[str, ...], buckets: int, then: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """df bucketed by job: dealt by the buckets' own hash first, so each bucket is one file; `then` may widen the dealt rows."""
    dealt = then(df.repartition(buckets, "job_id"))
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, "job_id").sortBy("job_id", *sort).saveAsTable(name)


def write_library(spark: SparkSession, tables, buckets: int | None = None, folder: str | None = None, lazy: bool = False) -> Library:
    """tables: pairs of name and DataFrame, each with a column job_id; one may be built on others, if it is a
    function of the Library, and may be a pair with what widens its rows once they are dealt. All get the same number of buckets (default: the session's shuffle partitions).
    With lazy=True each is written when it is first asked for, else all are written in turn."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefix = f"library_{uuid.uuid4().hex}"
    out = Library(spark, prefix, f"{folder or shared_folder(spark)}/{prefix}", [], dict(tables), buckets)
    for name in [] if lazy else list(out._waiting):
        out[name]
    return out
