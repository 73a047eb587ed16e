"""Reports about jobs that are made again only where the jobs' windows changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions.lineage import checkpointed
from cliploom.operators.edges import window_fingerprint


def _there(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def refresh_reports(windows: DataFrame, report: Callable[[DataFrame], DataFrame], path: str, parts: int = 64) -> list[int]:
    """Brings the table below path (job_id, fingerprint, *report columns, part) up to windows; the parts it wrote.

    report(windows) gives one row a job. Only jobs whose fingerprint isn't stored are reported again; they, and
    jobs that are gone, decide which parts (hash buckets of the jobs) are written anew, by dynamic partition
    overwrite; other parts' files aren't touched. `parts` has to stay the same for one table.
    """
    spark = windows.sparkSession
    part = F.pmod(F.xxhash64("job_id"), F.lit(parts)).cast("int")
    now = window_fingerprint(windows).withColumn("part", part)
    files, there = _there(spark, path)
    old = spark.read.parquet(path) if files.exists(there) else None
    if old is None:
        changed, touched = checkpointed(now), None
    else:
        stored = old.select("job_id", F.col("fingerprint").alias("_was"))
        changed = checkpointed(now.join(stored, "job_id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("_was"))).drop("_was"))
        gone = old.join(now.select("job_id"), "job_id", "left_anti").select("part")
        # one number a part at most
        touched = sorted(r["part"] for r in changed.select("part").union(gone).distinct().collect())
        if not touched:
            return []
    fresh = report(windows.join(changed.select("job_id"), "job_id", "left_semi")).join(changed, "job_id")
    if old is not None:
        same = now.join(changed.select("job_id"), "job_id", "left_anti").select("job_id")
        kept = old.filter(F.col("part").isin(touched)).join(same, "job_id", "left_semi")
        fresh = fresh.select(*kept.columns).unionByName(kept)
    fresh = checkpointed(fresh)
    written = sorted(r["part"] for r in fresh.select("part").distinct().collect())
    fresh.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for p in set(touched or ()) - set(written):  # all of its jobs are gone
        files, there = _there(spark, f"{path}/part={p}")
        files.delete(there, True)
    return written if touched is None else touched
