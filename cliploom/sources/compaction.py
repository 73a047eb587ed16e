"""Job states kept as dated Parquet: each state file is read once, and again only after it changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.functions.lineage import checkpointed
from cliploom.sources.files import JOB_STATE
from cliploom.sources.incremental import _there


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """The job.json files right below the directories of root, dot directories left out; Spark lists them, contents
    are read only where they are selected."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "job.json").load(root)
    files, there = _there(spark, root)
    head = files.makeQualified(there).toString() + "/"
    inside = F.split(F.substring("path", len(head) + 1, 1 << 20), "/")
    return found.filter(F.startswith("path", F.lit(head)) & (F.size(inside) == 2) & ~inside[0].startswith(".")).withColumn("job_id", inside[0])


def compact_job_states(spark: SparkSession, root: str, path: str) -> int:
    """Appends the states of new and changed root/*/job.json to the table below path; the number of files read.

    A file counts as read while the table has a row of its path, length and modification time. A
    stream over files wouldn't do: it knows files by path alone, and states are written in place. Contents are
    read only of files that changed no earlier than the oldest unread one, by a filter in the scan. Each
    file gives one row in the part of its day (`date`, of updated_at, else of the file's time); unreadable ones
    have readable = false and aren't tried again until they change. A run that dies leaves whole rows or
    none of each file, so the next one reads what is missing.
    """
    files, there = _there(spark, path)
    listed = _listed(spark, root)
    key = ["path", "length", "modificationTime"]
    unread = listed.select("job_id", *key)
    if files.exists(there):
        unread = unread.join(spark.read.parquet(path).select(*key), key, "left_anti")
    unread = checkpointed(unread)
    many, oldest = unread.agg(F.count(F.lit(1)), F.min("modificationTime")).first()
    if not many:
        return 0
    # a file that changes meanwhile has another time, and is left to the next run
    fresh = listed.filter(F.col("modificationTime") >= F.lit(oldest)).join(unread.drop("job_id"), key, "left_semi")
    state = F.from_json(F.col("content").cast("string"), JOB_STATE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = fresh.withColumn("_s", state).select("job_id", *key, (F.col("_s").isNotNull() & F.col("_s._bad").isNull()).alias("readable"), "_s.*").drop("_bad")
    day = F.coalesce(F.col("updated_at").try_cast("date"), F.to_date("modificationTime"))
    rows.withColumn("date", day).repartition("date").write.mode("append").partitionBy("date").parquet(path)
    return many


def compacted_job_states(spark: SparkSession, path: str) -> DataFrame:
    """The state of each job that holds: the highest state_version, then the latest update, then the latest file."""
    order = Window.partitionBy("job_id").orderBy(F.coalesce("state_version", F.lit(0)).desc(), F.col("updated_at").desc_nulls_last(), F.col("modificationTime").desc(), F.col("length").desc())
    states = spark.read.parquet(path).filter("readable").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return states.drop("_n", "path", "length", "modificationTime", "readable", "date")
