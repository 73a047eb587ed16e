"""Exact deduplication: static binary-fuse filters of immutable snapshots screen incoming digests."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import SPACE, by_group, checkpoint, keep_one, row_hash, settled, stored

#: Distinct digests to one filter; filters are built and probed bucket by bucket.
BUCKET = 1 << 16


# ---- the filter: three cells per key in consecutive segments, 16-bit fingerprints ----


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _cells(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The key's cells: one in each of three consecutive segments."""
    first = (h >> np.uint64(40)).astype(np.int64) % segments
    low = [(h >> np.uint64(s)).astype(np.int64) & (segment - 1) for s in (0, 13, 26)]
    return np.stack([(first + i) * segment + low[i] for i in range(3)], axis=1)


def fuse_build(keys: np.ndarray) -> bytes:
    """Binary-fuse filter of distinct 64-bit keys, about 18 to 20 bits a key.

    Keys whose cell nobody else uses are peeled off in rounds, all of a round at once; cells are
    then set in reverse, so that the three cells of each key xor to its fingerprint.
    """
    keys = np.unique(keys)
    n = len(keys)
    segment = 1 << min(13, max(2, int(math.log2(max(n, 4)) * 0.7)))
    cells = max(int(n * (1.125 + 0.9 * min(1.0, 50 / max(n, 1) ** 0.6)) + 32), 3 * segment)
    segments = max(1, -(-cells // segment) - 2)
    for seed in range(1, 200):
        h = _mix(keys, seed)
        at = _cells(h, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for i in range(3):
            np.bitwise_xor.at(owner, at[:, i], np.arange(n))
        rounds = []
        left = n
        while left:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            key, first = np.unique(owner[single], return_index=True)
            rounds.append((key, single[first]))
            left -= len(key)
            for i in range(3):
                np.subtract.at(count, at[key, i], 1)
                np.bitwise_xor.at(owner, at[key, i], key)
        if not left:
            table = np.zeros(size, np.uint16)
            mark = (h ^ (h >> np.uint64(32))).astype(np.uint16)
            for key, cell in reversed(rounds):
                table[cell] = 0
                table[cell] = mark[key] ^ table[at[key, 0]] ^ table[at[key, 1]] ^ table[at[key, 2]]
            return np.array([seed, segment, segments], np.int64).tobytes() + table.tobytes()
        if seed % 4 == 0:
            segments += 1 + segments // 8
    raise ArithmeticError("no filter found")


def fuse_probe(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key of the filter and for about 1 in 65,536 others."""
    seed, segment, segments = np.frombuffer(filter_, np.int64, 3).tolist()
    table = np.frombuffer(filter_, np.uint16, offset=24)
    h = _mix(keys, seed)
    at = _cells(h, segment, segments)
    return (table[at[:, 0]] ^ table[at[:, 1]] ^ table[at[:, 2]]) == (h ^ (h >> np.uint64(32))).astype(np.uint16)


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of digests of one length as numbers, shorter ones filled with zeros."""
    some = digests.to_pylist()
    if not some:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1)[:, :8]
    out = np.zeros((len(some), 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view("<u8").ravel()


# ---- the operator ----


def normalised(column: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), SPACE, " ")


def digests(docs: DataFrame, bits: int = 256) -> DataFrame:
    """(row_key, doc_id, sha, digest): sha is the SHA-256 of the normalised text, digest its first bits."""
    sha = F.unhex(F.sha2(normalised(), 256))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("row_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        row_hash().alias("row_hash"),
        sha.alias("sha"),
    ).withColumn("digest", F.substring("sha", 1, bits // 8))


def snapshot(each: DataFrame) -> DataFrame:
    """The exact buckets of a set of rows: (digest, keep_id, n)."""
    return each.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def build_filters(snap: DataFrame, buckets: int) -> DataFrame:
    """One static filter (bucket int, filter binary) for each bucket of an immutable snapshot."""

    def build(t: pa.Table) -> pa.Table:
        return pa.table({"bucket": t.column("bucket")[:1], "filter": pa.array([fuse_build(_keys(t["digest"]))])})

    return _bucketed(snap, buckets).select("bucket", "digest").groupBy("bucket").applyInArrow(
        build, "bucket int, filter binary"
    )


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The rows (digest, keep_id, n) of incoming whose digest a filter lets pass; none of the snapshot's is lost."""

    def probe(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.select(["digest", "keep_id", "n"])
        if not len(rows) or not len(found):
            return rows.slice(0, 0)
        return rows.filter(pa.array(fuse_probe(found["filter"][0].as_py(), _keys(rows["digest"]))))

    return (
        _bucketed(incoming, buckets)
        .groupBy("bucket")
        .cogroup(filters.groupBy("bucket"))
        .applyInArrow(probe, "digest binary, keep_id long, n long")
    )


def exact_dedup(docs: DataFrame, bits: int = 256, cut: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row_hash.

    Texts are equal when identical after each run of white space became one blank; null is empty. Of
    equal texts the row with the smallest doc_id stays. Rows up to doc_id `cut` (default: the median)
    form the immutable snapshot, the rest the incoming batch: the batch's own duplicates are grouped
    first, each distinct digest is screened by the snapshot's filters, and what passes joins the exact
    buckets. Every row of a group of two or more is then compared byte for byte with the text of the
    row that stays; rows that differ (a digest collision) are grouped anew by their bytes. `bits`
    shortens the digest, for tests of that path.

    Null doc_ids come last: such a row stays only if its group has no id. Repeated rows with one
    doc_id all count, and are all marked kept if it is the smallest. Empty tables give no rows.
    """
    docs = docs.select("doc_id", "text")
    each = stored(digests(docs, bits), "digests")
    if cut is None:
        cut = each.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    old = F.coalesce(F.col("doc_id") <= F.lit(cut), F.lit(False))
    snap = stored(snapshot(each.filter(old)), "snapshot")
    batch = stored(snapshot(each.filter(~old)), "batch")
    buckets = max(32, -(-max(snap.count(), batch.count()) // BUCKET))
    filters = checkpoint(build_filters(snap, buckets))
    hits = checkpoint(
        screen(batch, filters, buckets)
        .withColumnsRenamed({"keep_id": "new_id", "n": "new_n"})
        .join(snap, "digest")
        .select(
            "digest",
            F.least("keep_id", "new_id").alias("keep_id"),
            (F.col("n") + F.col("new_n")).alias("n"),
        )
    )
    alone = snap.union(batch).join(hits, "digest", "left_anti")
    classes = stored(alone.select("digest", "keep_id", "n").union(hits), "classes")
    found = by_group(each, classes, ["digest"], "n")
    wrong = _unequal(docs, found.filter("n > 1"))
    if not wrong.isEmpty():
        found = _regrouped(found, wrong)
    return found.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "row_hash",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept."""
    decided = settled(docs.sparkSession, lambda: exact_dedup(docs), "copies").withColumn("keep_id", F.coalesce("keep_id", F.lit(-(1 << 63))))
    return keep_one(docs, decided, "keep_id", "text_sha256")


def _unequal(docs: DataFrame, doubled: DataFrame, part: int = 256) -> DataFrame:
    """Byte check: of the rows in groups, those whose text differs from that of the row that stays.

    A group of n rows is dealt into ceil(n / part) parts, each with a copy of the text that stays, so
    no task gets a whole group.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    texts = docs.select(key.alias("row_key"), normalised().alias("norm"))
    rows = texts.join(doubled.select("row_key", "doc_id", "sha", "digest", "keep_id", "n").distinct(), "row_key").filter(
        F.unhex(F.sha2("norm", 256)) == F.col("sha")
    )
    parts = F.ceil(F.col("n") / F.lit(part)).cast("int")
    stays = (
        rows.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest", "n")
        .agg(F.min("norm").alias("stays"))
        .select("digest", "stays", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    )
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row_key"), parts).cast("int"))
    return stored(
        dealt.join(stays, ["digest", "part"])
        .filter("norm <> stays")
        .select("row_key", "sha", "digest", "doc_id", "norm"),
        "unequal",
    )


def _regrouped(found: DataFrame, wrong: DataFrame) -> DataFrame:
    """Groups by bytes where a digest stood for several texts."""
    anew = wrong.groupBy("digest", "norm").agg(F.min("doc_id").alias("own_id"), F.count(F.lit(1)).alias("own_n"))
    own = wrong.join(anew, ["digest", "norm"]).select("row_key", "sha", "own_id", "own_n").distinct()
    gone = wrong.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    return (
        found.join(gone, "digest", "left")
        .join(own, ["row_key", "sha"], "left")
        .withColumn("n", F.coalesce("own_n", F.col("n") - F.coalesce("gone", F.lit(0))))
        .withColumn("keep_id", F.when(F.col("own_n").isNull(), F.col("keep_id")).otherwise(F.col("own_id")))
    )
