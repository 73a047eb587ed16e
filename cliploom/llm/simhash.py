"""SimHash near-duplicates with pivot distance tables.

Fingerprints within `k` bits are linked. By the triangle inequality two such fingerprints differ by at
most k in their distance to any reference fingerprint, so a table of distances to many references
discards most pairs by the largest coordinate difference before the exact test. Distances of unrelated
fingerprints to one reference lie close together (a single reference keeps over half of all pairs), so
a pivot table alone would still have to look at every pair; therefore pairs come from buckets that lose
nothing: with the 64 bits cut in b blocks, two fingerprints within k bits agree on at least b - k whole
blocks. In a bucket the pivot table does the discarding, and the survivors are verified bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import (
    by_group,
    keep_one,
    local_roots,
    pairs_in_cells,
    parts,
    row_hash,
    settled,
    split_buckets,
    stored,
    utf8,
    whole_groups,
)
from cliploom.llm.components import connected_components
from cliploom.llm.resemblance import resembling
from cliploom.llm.shingling import of_hashes, shingles, signed
from cliploom.llm.shingling import pivots as reference_pivots



def fingerprint(text: bytes, width: int) -> int:
    """64-bit SimHash of a text: a bit is 1 if set in over half of its shingles' hashes."""
    return of_hashes(shingles(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, row_hash, fp long) of every document: lower-cased A-Z, words, shingles of `width` words.

    Texts of fewer words hash as one shingle; null, empty and blank texts get fingerprint zero.
    """

    def run(batches):
        for batch in batches:
            fp = [fingerprint(t, width) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "row_hash", "fp"]
            )

    given = docs.select(F.col("doc_id").cast("long"), row_hash().alias("row_hash"), utf8().alias("t"))
    return given.mapInArrow(run, "doc_id long, row_hash long, fp long")


def _bands(n: int, k: int) -> list[np.ndarray]:
    """Bit masks of the lossless tables, finer for more fingerprints: about 512 or fewer to a bucket."""
    for b in range(k + 1, k + 4):
        if n >> (64 * (b - k) // b) <= 512:
            break
    edge = [64 * i // b for i in range(b + 1)]
    block = [sum(1 << x for x in range(edge[i], edge[i + 1])) for i in range(b)]
    return [sum(block[i] for i in c) for c in combinations(range(b), b - k)]


def links(fps: DataFrame, k: int = 4, pivots: int = 24, limit: int = 512) -> DataFrame:
    """fps (fp long, distinct) -> (a, b): links between fingerprints within k bits, enough to connect
    each cell's linked fingerprints (a spanning star per cell, not all pairs)."""
    masks = _bands(fps.count(), k)
    reference = reference_pivots(pivots)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(signed(m)).alias("m")) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(tables).alias("x")).select(
        F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("band"), "fp"
    )
    key = ["t", "band"]
    cells = split_buckets(rows, key, "fp", limit)
    order = [*key, "lo", "hi"]
    cells = cells.select(*order, "chunk", "fp").repartition(parts(fps), *order).sortWithinPartitions(*order)

    def run(batches):
        for t, start, size in whole_groups(batches, lambda t: [t.column(c).to_numpy() for c in order]):
            fp = t.column("fp").to_numpy().view(np.uint64)
            chunk = t.column("chunk").to_numpy()
            mixed = t.column("lo").to_numpy() != t.column("hi").to_numpy()
            # the pivot distance table of these rows
            distance = np.stack([np.bitwise_count(fp ^ p) for p in reference]).astype(np.int8)
            found = []
            for i, j in pairs_in_cells(start, size):
                keep = ~mixed[i] | (chunk[i] != chunk[j])
                i, j = i[keep], j[keep]
                for row in distance:  # largest coordinate difference, one coordinate after another
                    keep = np.abs(row[i] - row[j]) <= k
                    i, j = i[keep], j[keep]
                keep = np.bitwise_count(fp[i] ^ fp[j]) <= k
                found.append((i[keep], j[keep]))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
            root = local_roots(len(fp), i, j)
            own = np.flatnonzero(root != np.arange(len(fp)))
            fp = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, row_hash) of every document.

    component_id is the smallest doc_id reachable over links of at most k bits. Copies share one
    fingerprint, so only distinct fingerprints are compared. Null doc_ids keep their row and take the
    class of their fingerprint (null if nobody in it has an id); repeated rows stay; an empty table
    gives an empty result. Other columns of docs, whatever their names, are not read.
    """
    each = stored(fingerprints(docs, width), "fingerprints")
    nodes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    found = connected_components(links(nodes.select("fp"), k))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    rooted = stored(rooted, "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps")), "least")
    label = stored(by_group(rooted.select("fp", "n", "root"), least, ["root"], "fps").select("fp", "n", "component_id"), "label")
    return by_group(each, label, ["fp"], "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row_hash"
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each group of near duplicates, all columns kept.

    The rule is a Jaccard similarity of `least` or more on shingles of `width` words. Such texts differ
    in up to a dozen fingerprint bits or so, too many for lossless buckets of fingerprints, so pairs
    come from shared shingles; pivot distances and fingerprints discard most, and whole sets of shingles
    verify the survivors (see resemblance.py).
    """
    return keep_one(docs, settled(docs.sparkSession, lambda: resembling(docs, width, least), "classes"), "class")
