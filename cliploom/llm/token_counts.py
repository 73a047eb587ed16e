"""Token counts from flat, unindexed token files: a separator scan stitched across blocks.

A token file is a run of little-endian ids (16 bits, 32 for vocabularies over 65,536), each document
closed by the end-of-document id, with no list of documents. It is cut in blocks of fixed size wherever they fall. Each block is searched at
once for the end id; what lies before a block's first end belongs to a document of earlier blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import stored, utf8
from cliploom.llm.words import encoder, ended, id_kind, slices

BLOCK = 1 << 18


def write_flat(docs: DataFrame, path: str, end: int, block: int = BLOCK, kind: str = "<u2") -> tuple[DataFrame, DataFrame]:
    """Token files of docs as they come: (files (part, block, ids binary), order (part, place, doc_id)).

    One file for each partition of docs, in blocks of `block` ids. `order` only names the documents of
    a file in their order, for reports; the scan doesn't read it.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t"))

    def run(batches):
        part, number, place, held, n = TaskContext.get().partitionId(), 0, 0, [], 0

        def rows(ids):
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([ids.astype(kind).tobytes()], pa.binary()), pa.array([None], pa.int64())],
                names=["part", "number", "ids", "doc_id"],
            )

        for batch in batches:
            texts = batch.column(1)
            for some in slices(texts):
                ids, _ = ended(*encoder(path, True).encode(some), end)
                held.append(ids)
                n += len(ids)
                if n >= block:
                    flat = np.concatenate(held)
                    for a in range(0, n - block + 1, block):
                        yield rows(flat[a : a + block])
                        number += 1
                    held, n = [flat[n - n % block :]], n % block
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(texts), part, np.int32)),
                    pa.array(np.arange(place, place + len(texts))),
                    pa.nulls(len(texts), pa.binary()),
                    batch.column(0),
                ],
                names=["part", "number", "ids", "doc_id"],
            )
            place += len(texts)
        if n:
            yield rows(np.concatenate(held))

    table = stored(ordered.mapInArrow(run, "part int, number long, ids binary, doc_id long"), "flat-tokens", compression="zstd")
    files = table.filter("ids is not null").select("part", F.col("number").alias("block"), "ids")
    return files, table.filter("ids is null").select("part", F.col("number").alias("place"), "doc_id")


def scan(files: DataFrame, end: int, kind: str = "<u2") -> DataFrame:
    """files (part, block, ids) -> (part, place, start, n_tokens): every document of every file, in order.

    n_tokens counts the end id; start counts ids within the file. Ids after a file's last end id are a
    document that was cut off and have no row. Files without ids give no rows.
    """

    def search(batches):
        for batch in batches:
            for part, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, kind)
                at = np.flatnonzero(ids == end)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([block], pa.int64()),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
                    ],
                    names=["part", "block", "n", "ends"],
                )

    found = stored(files.mapInArrow(search, "part int, block long, n long, ends array<int>"), "ends")
    # prefix scan over a file's blocks: ids and documents before, and where the last document ended
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        found.select("part", "block", "n", F.size("ends").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("last"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("place", F.coalesce(F.sum("k").over(before), F.lit(0)))
        .withColumn("from", F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0)))
        .select("part", "block", "base", "place", "from")
    )
    each = found.select("part", "block", F.posexplode("ends").alias("i", "at"), "ends").select(
        "part", "block", "i", "at", F.when(F.col("i") > 0, F.expr("ends[i - 1]")).alias("previous")
    )
    start = F.coalesce(F.col("base") + F.col("previous") + 1, F.col("from"))
    return each.join(blocks, ["part", "block"]).select(
        "part",
        (F.col("place") + F.col("i")).alias("place"),
        start.alias("start"),
        (F.col("base") + F.col("at") + 1 - start).alias("n_tokens"),
    )


def token_counts(docs: DataFrame, path: str, end: int = 49_407, block: int = BLOCK, vocabulary: int = 49_408) -> DataFrame:
    """One row per document: doc_id, n_tokens (with the end id), from the written token files.

    Special tokens' strings inside texts are ordinary text, so the end id only ends documents. Null
    and empty texts count 1; null doc_ids and repeated rows are documents like others; an empty table
    gives no rows.
    """
    kind = id_kind(vocabulary)
    files, order = write_flat(docs.select("doc_id", "text"), path, end, block, kind)
    return order.join(scan(files, end, kind), ["part", "place"]).select("doc_id", "n_tokens")
