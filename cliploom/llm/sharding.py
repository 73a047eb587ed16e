"""Sharding by sampled splitters: equal bytes for every shard, groups of equal texts kept together.

Records are keyed by (hash of the text, doc_id); rows repeated whole are one key, cut into parts of a
bounded number of rows. A sample drawn in proportion to size gives quantile boundaries of that key,
records are dealt to the ranges between them, and overfull ranges are divided by boundaries from a
closer sample. Exact running sums over the ranges then place the shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import checkpoint, parts, stored

#: Added to the text's bytes for each record.
OVERHEAD = 16
#: Rows to a part of a key that is repeated.
PART = 1024
_ID = -(1 << 63)
_KEY = ("h", "id", "part")


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h, id, part, m, bytes): what sharding needs of the records; null texts
    have no bytes. m is how many equal rows a line stands for, bytes the sum of their sizes."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    each = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("h"),
    )
    same = each.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count(F.lit(1)).alias("c"))
    return (
        same.withColumn("id", F.coalesce("doc_id", F.lit(_ID)))
        .withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("c") - 1) / PART).cast("int"))))
        .withColumn("m", F.least(F.lit(PART), F.col("c") - F.col("part") * PART))
        .withColumn("bytes", F.col("m") * F.col("size"))
        .drop("c")
    )


def _draw(rows: DataFrame, expected: int, total: int, salt: str) -> np.ndarray:
    """About `expected` keys, each drawn with a chance in proportion to its bytes, as often as its bytes
    hold; a bounded sample, the same in every run. Sorted by key."""
    step = max(1, total // expected)
    chance = F.pmod(F.xxhash64(*_KEY, F.lit(salt)), F.lit(step))
    hits = F.expr(f"bytes div {step}") + F.when(chance < F.pmod("bytes", F.lit(step)), 1).otherwise(0)
    drawn = rows.withColumn("hits", hits).filter("hits > 0").select(*_KEY, "hits").collect()
    out = np.zeros(len(drawn), [(c, "<i8") for c in (*_KEY, "hits")])
    out[:] = sorted(map(tuple, drawn))
    return out


def _quantiles(sample: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """n - 1 boundaries at equal weights of the sample. A boundary comes before its key's whole group
    of equal texts, unless the group holds several boundaries: then it divides the group by id and part."""
    if not len(sample):
        return []
    upto = np.cumsum(sample["hits"])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)
    h, count = np.unique(sample["h"][at], return_counts=True)
    hot = set(h[count > 1].tolist())
    return sorted({tuple(map(int, k)) if int(k[0]) in hot else (int(k[0]), _ID, 0) for k in sample[list(_KEY)][at].tolist()})


def _upto(edges: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted edges are at or below each key; both given by columns."""
    last = np.searchsorted(edges[0], keys[0], side="right")
    if len(edges) == 1:
        return last
    place = np.searchsorted(edges[0], keys[0], side="left")
    tied = np.flatnonzero(place < last)
    for a in np.unique(place[tied]):
        rows = tied[place[tied] == a]
        b = last[rows[0]]
        last[rows] = a + _upto([c[a:b] for c in edges[1:]], [c[rows] for c in keys[1:]])
    place[tied] = last[tied]
    return place


def ranged(rows: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    """rows with `range`: how many boundaries are at or below a row's key."""
    edges = list(np.array(bounds, np.int64).reshape(-1, len(_KEY)).T)

    def run(batches):
        for batch in batches:
            place = _upto(edges, [batch.column(c).to_numpy() for c in _KEY])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int32))], names=[*batch.schema.names, "range"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, schema + ", range int")


def ranges_for(rows: int, shards: int, fineness: int = 32) -> int:
    """How many ranges: `fineness` a shard, more where a range would get over 250,000 rows; 65,536 at most."""
    return max(shards * fineness, min(1 << 16, rows // 250_000))


def shard(docs: DataFrame, shards: int = 40, fineness: int = 32, draws: int = 32) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: shards hold nearly equal sizes. Equal texts are neighbours and share a shard,
    unless their group alone is over one range's share (1 / ranges_for() of all bytes); such groups are
    divided row by row. A shard's size is therefore within two such shares, or the largest record if
    that is more, of the mean. slot counts from 0 without gaps in each shard; grown_shard is null under
    this law. Null texts have size 16 and form one group, null doc_ids come first in their group,
    repeated rows take slots of their own, and an empty table gives no rows. A shard may be empty if
    there are fewer records than shards, or one record is larger than a shard.
    """
    rows = stored(records(docs.select("doc_id", "text")), "records")
    total, many = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    n = ranges_for(many, shards, fineness)
    # what the driver collects: 40,960 keys, 8 a range where ranges are many
    expected = n * max(8, min(draws, (1 << 19) // n))
    bounds = _quantiles(_draw(rows, expected, total, "first"), n)
    placed = stored(ranged(rows, bounds), "ranged")
    for salt in ("second", "third"):
        # ranges of over twice their share are divided by a closer sample of them alone
        over = [r["range"] for r in placed.groupBy("range").agg(F.sum("bytes").alias("b")).filter(F.col("b") > 2.0 * total / n).collect()]
        if not over:
            break
        inside = placed.filter(F.col("range").isin(over))
        much = inside.agg(F.sum("bytes")).first()[0]
        more = _draw(inside, 4 * draws * len(over), much, salt)
        finer = set(bounds)
        edges = list(np.array(bounds, np.int64).reshape(-1, len(_KEY)).T)
        place = _upto(edges, [more[c] for c in _KEY])
        for r in over:
            own = more[place == r]
            if len(own):
                finer |= set(_quantiles(own, int(own["hits"].sum() * (much / more["hits"].sum()) * n / total) + 2))
        if finer == set(bounds):
            break
        bounds = sorted(finer)
        placed = stored(ranged(rows, bounds), "ranged")

    # the table of ranges is bounded by the number of boundaries
    ranges = placed.groupBy("range").agg(F.sum("bytes").alias("b"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = checkpoint(ranges.select("range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base")))
    line = ["h", "id", "doc_id", "size", "text_crc32", "part"]
    inside = Window.partitionBy("range").orderBy(*line)
    group = Window.partitionBy("range", "h")
    # a group that fills much of a range is divided row by row; others go where their middle is
    middle = F.when(F.col("group") * n > total, F.col("begin") + (F.col("row") + F.lit(0.5)) * F.col("size")).otherwise(
        F.col("first") + F.col("group") / 2
    )
    at = (
        placed.join(F.broadcast(ranges), "range")
        .repartition(parts(rows), "range")
        .withColumn("begin", F.col("base") + F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes"))
        .withColumn("group", F.sum("bytes").over(group))
        .withColumn("first", F.min("begin").over(group))
        .withColumn("row", F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1)))).cast("int"))
    )
    order = Window.partitionBy("range", "shard").orderBy(*line, "row")
    at = stored(
        at.withColumn("place", F.row_number().over(order) - 1).select("doc_id", "size", "text_crc32", "range", "shard", "place"),
        "sharded",
    )
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cells = at.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.select("shard", "range", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("slots"))
    return at.join(F.broadcast(cells), ["shard", "range"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slots") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
