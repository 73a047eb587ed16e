"""What several operators of this package share: the shared folder, tables cut from their lineage,
word splitting and bucket splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every operator here: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only in local mode.

    A cluster without that setting is refused: each executor would write to its own disk and what is
    read back would be incomplete.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """A small table with its lineage cut: Spark's reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths of tables written inside the settled() around; each thread (or other context) has its own.
_OPEN: ContextVar[list[str] | None] = ContextVar("open", default=None)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """A table written as Parquet in the shared folder and read again; survives lost executors.

    It goes when the session ends, or with the settled() around it: results read it lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    there, files = _place(spark, path)
    files.deleteOnExit(there)
    if (inner := _OPEN.get()) is not None:
        inner.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that make() gives, written; the tables that make() wrote on its way are deleted."""
    inner: list[str] = []
    before = _OPEN.set(inner)
    try:
        df = make()
    finally:
        _OPEN.reset(before)
    out = stored(df, name)
    for path in inner:
        there, files = _place(spark, path)
        files.delete(there, True)
    return out


def _place(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text"):
    """The bytes of a text, none for null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def row_hash():
    """Tells rows of one doc_id apart by their raw text."""
    return F.xxhash64(F.col("text").cast("string"))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column has it (case doesn't count)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def by_group(rows: DataFrame, groups: DataFrame, key: list[str], n: str, most: int = 1000) -> DataFrame:
    """rows joined with groups, one row a key, where one group may hold any share of the rows.

    `n` is a column of groups: how many rows each has. Groups over 1/`most` of all rows, fewer than
    `most` by that, are sent to every task; the others are joined by a shuffle. Keys aren't null.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * F.lit(most) > F.lit(total)
    many = groups.filter(hot)
    if many.isEmpty():
        return rows.join(groups, key)
    rest = rows.join(F.broadcast(many.select(*key)), key, "left_anti").join(groups.filter(~hot), key)
    return rows.join(F.broadcast(many), key).unionByName(rest)


def keep_one(docs: DataFrame, decided: DataFrame, *group: str) -> DataFrame:
    """docs with one row of each group: the smallest doc_id (null last), then the smallest row_hash.

    decided (doc_id, row_hash, *group) has a row for each row of docs and is a written table; no group
    is null. The rows that go are a written table, which Spark broadcasts only if its size allows;
    texts are shuffled otherwise. Columns of docs keep their values whatever their names.
    """
    last = F.lit((1 << 63) - 1)
    key = decided.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("_id"), F.col("row_hash").alias("_hash"), *group)
    stay = key.groupBy(*group).agg(F.min(F.struct("_id", "_hash")).alias("_stay"), F.count(F.lit(1)).alias("_n"))
    # groups of one row have nobody to go
    stay = stored(stay.filter("_n > 1"), "stay")
    gone = by_group(key, stay, list(group), "_n").filter(F.struct("_id", "_hash") != F.col("_stay"))
    gone = stored(gone.select("_id", "_hash").distinct(), "gone")
    again = stored(key.groupBy("_id", "_hash").count().filter("count > 1").drop("count"), "again")
    names = unused(docs.columns, "_id", "_hash")
    gone, again = gone.toDF(*names), again.toDF(*names)
    keyed = docs.withColumns({names[0]: F.coalesce(F.col("doc_id").cast("long"), last), names[1]: row_hash()})
    left = keyed.join(gone, names, "left_anti")
    if not again.isEmpty():  # rows repeated whole
        once = left.join(again, names, "left_semi").dropDuplicates(names)
        left = left.join(again, names, "left_anti").unionByName(once)
    return left.select(*docs.columns)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `pos`, each row's place in its group by `order`, from 0 without gaps.

    rows is a written table (it is read for the range bounds and again to be dealt); no group is null.
    Rows are range-partitioned by group and order, so a group of any size lies in several tasks. A
    place is the row's place in its partition, and what its group has in earlier partitions: sums over
    one row for each partition and group. Equal rows get places in any order.
    """
    key = [*group, *order]
    dealt = rows.repartitionByRange(parts(rows), *key).sortWithinPartitions(*key)
    # the upper bits of this id are the partition, the lower 33 count its rows in order
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    begin = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = begin.withColumn("_add", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
    begin = stored(begin.select(*group, "_part", "_add"), f"{name}-begin")
    return placed.join(begin, [*group, "_part"]).withColumn("pos", F.col("_at") + F.col("_add")).drop("_at", "_part", "_add")


def parts(df: DataFrame, least: int = 8) -> int:
    """How many partitions a keyed repartition gets: the session's setting, or `least`."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_buckets(rows: DataFrame, key: list[str], identity: str, limit: int) -> DataFrame:
    """Prepare all-pairs work inside buckets so that no task gets a whole hot bucket.

    A bucket of n rows is dealt into s = ceil(n / limit) chunks by a hash of `identity`; each pair of
    chunks (lo, hi) becomes a cell, and a row goes to the s cells of its chunk. Every pair of rows of
    a bucket meets in exactly one cell, and a cell has at most about 2 * limit rows. Buckets of one
    row have no pairs and go. Adds the columns lo, hi, chunk.
    """
    counts = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "buckets")
    s = F.ceil(F.col("_n") / F.lit(limit)).cast("int")
    return (
        by_group(rows, counts, key, "_n")
        .withColumn("_s", s)
        .withColumn("chunk", F.pmod(F.xxhash64(identity, F.lit("chunk")), F.col("_s")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
        .withColumn("lo", F.least("chunk", "_o"))
        .withColumn("hi", F.greatest("chunk", "_o"))
        .drop("_n", "_s", "_o")
    )


def pairs_in_cells(start: np.ndarray, size: np.ndarray, most: int = 1 << 21):
    """Index pairs i < j inside consecutive groups of rows, in slices of about `most` pairs.

    start, size: each group's first row and number of rows. A group's pairs are never all in memory
    unless they fit the slice: its rows are taken in blocks against the rows behind them.
    """
    first = np.repeat(start, size) + _within(size)
    behind = np.repeat(start + size, size) - first - 1
    ends = np.cumsum(behind)
    at = 0
    while at < len(first):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        n = behind[at:to]
        left = np.repeat(first[at:to], n)
        yield left, left + 1 + _within(n)
        at = to


def _within(size: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of size, one after another."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return np.arange(total) - np.repeat(ends - size, size)


def whole_groups(batches, key_of):
    """Rows of Arrow batches, regrouped so that equal consecutive keys are never cut.

    key_of(table) -> list of arrays; yields (table, start, size). Rows must come sorted by the key.
    """
    import pyarrow as pa

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if len(held) < 1:
            continue
        start, size = _runs(key_of(held))
        if len(start) > 1:
            cut = int(start[-1])
            yield held.slice(0, cut).combine_chunks(), start[:-1], size[:-1]
            held = held.slice(cut)
    if held is not None and len(held):
        start, size = _runs(key_of(held))
        yield held.combine_chunks(), start, size


def _runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, n))


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For rows 0..n-1 and links between them, each row's smallest linked row."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root
