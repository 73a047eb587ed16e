"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking.

A code is cut into as many parts as there are tables, and a vector goes into one bucket of each. The
parts get longer as the table grows, so buckets hold about as many unrelated vectors at every size, and
their number follows from how often a part survives at the threshold, measured on the sample.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.llm.common import by_group, checkpoint, local_roots, pairs_in_cells, parts, settled, split_buckets, stored, whole_groups
from cliploom.llm.components import connected_components

#: Bits of a part, at least and at most, and how much shorter a part is than log2 of the vectors.
SHORTEST, LONGEST, SPARE = 8, 40, 4
_ORDER = ["dim", "t", "key", "lo", "hi"]


def fit_itq(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): the rotation of the principal axes that loses least by taking signs.

    Alternates between the binary codes of the rotated sample and the rotation nearest to them
    (orthogonal Procrustes). Shorter vectors than `bits` get several rotations, side by side.
    """
    mean = sample.mean(0)
    x = sample - mean
    d = x.shape[1]
    axes = np.linalg.eigh(x.T @ x / max(1, len(x)))[1][:, ::-1]
    made = []
    for k in range(-(-bits // d)):
        use = axes[:, : min(bits, d)]
        v = x @ use
        rotation = np.linalg.qr(np.random.default_rng(seed + k).normal(size=(v.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ wt).T
        made.append(use @ rotation)
    return mean, np.concatenate(made, axis=1)[:, :bits]


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length as double rows of length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # by the largest component first, so that squares neither vanish nor overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Codes of vectors: signs along learnt axes for vectors of the fitted length, along random ones,
    drawn from their length, for others. Kept in `tables` parts of `width` bits."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, width: int, tables: int):
        self.mean, self.axes, self.width, self.tables = mean, axes, width, tables
        self.bits = width * tables
        self.padded = -(-self.bits // 64) * 64

    def _signs(self, x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        if d == len(self.mean):
            return (x - self.mean) @ self.axes[:, : self.bits] >= 0
        total = np.zeros((len(x), self.bits))
        for a in range(0, d, 1024):  # axes of very long vectors are never whole in memory
            part = x[:, a : a + 1024]
            total += part @ np.random.default_rng([d, a]).normal(size=(part.shape[1], self.bits))
        return total >= 0

    def code(self, x: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(x), self.padded), bool)
        bits[:, : self.bits] = self._signs(x)
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def parts(self, code: np.ndarray) -> np.ndarray:
        """(tables, rows): the parts of codes as numbers."""
        bits = np.unpackbits(code.view(np.uint8), axis=1, bitorder="little")[:, : self.bits]
        weight = np.int64(1) << np.arange(self.width, dtype=np.int64)
        return np.ascontiguousarray((bits.reshape(len(code), self.tables, self.width) @ weight).T)


def random_axes(d: int, bits: int, seed: int = 0) -> np.ndarray:
    """Axes through the origin in random directions, at right angles in blocks of d."""
    rng = np.random.default_rng(seed)
    blocks = [np.linalg.qr(rng.normal(size=(d, min(d, bits - at))))[0] for at in range(0, bits, d)]
    return np.concatenate(blocks, axis=1)


def _tables(same: float, recall: float) -> float:
    """How many tables find a pair with probability `recall` whose parts are equal with probability `same`."""
    if same >= 1:
        return 2
    return max(2, math.ceil(math.log(1 - recall) / math.log1p(-same))) if same > 0 else math.inf


def fitted(sample: np.ndarray, vectors: int, threshold: float, recall: float, most_tables: int = 256) -> tuple[Codes, int]:
    """(codes, radius) for so many vectors.

    The sample's vectors are turned by the threshold's angle in random directions; the share of parts
    that stay equal gives the number of tables that finds such pairs with probability `recall`, and the
    distance of their codes the radius, four deviations wide. Closer pairs are found more often.

    Where vectors lie in so narrow a cone that the learnt axes, which go through its centre, separate
    pairs at the threshold too often for `most_tables`, axes through the origin take their place: there a
    bit survives with a probability that depends on the angle alone, and parts are shortened until the
    tables suffice.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine over 0, up to 1")
    width = min(LONGEST, max(SHORTEST, int(math.log2(max(vectors, 2))) - SPARE))
    mean, axes = fit_itq(sample, 4 * width)
    rng = np.random.default_rng(1)
    x = sample[rng.integers(0, len(sample), 4000)]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    length = np.linalg.norm(noise, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * noise / np.where(length > 0, length, 1)
    trial = Codes(mean, axes, width, 4)
    tables = _tables(float((trial.parts(trial.code(x)) == trial.parts(trial.code(y))).mean()), recall)
    if tables <= most_tables:
        codes = Codes(*fit_itq(sample, width * tables), width, tables)
    else:
        bit = 1 - math.acos(threshold) / math.pi
        while (tables := _tables(bit**width, recall)) > most_tables:
            width -= 1
        codes = Codes(np.zeros(x.shape[1]), random_axes(x.shape[1], width * tables), width, tables)
    apart = np.bitwise_count(codes.code(x) ^ codes.code(y)).sum(axis=1)
    return codes, math.ceil(apart.mean() + 4 * apart.std())


def _given(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, class, twin, v): two hashes name a vector's value; both null where it can't link."""
    kind = vectors.schema["embedding"].dataType.elementType
    v = F.col("embedding") if isinstance(kind, T.FloatType | T.DoubleType) else F.col("embedding").cast("array<double>")
    zero = F.lit(0.0).cast("float") if isinstance(kind, T.FloatType) else F.lit(0.0)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(usable, F.transform(v, lambda x: x + zero)).alias("v"),  # no negative zeros
    ).select(
        "vec_id",
        F.size("v").alias("dim"),
        F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("class"),
        F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("twin"),
        "v",
    )


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.97, most: int = 20_000, limit: int = 256) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    The index is fitted on at most `most` distinct vectors of the commonest length (in the order of a
    hash) and holds all of them. Vectors that share a bucket of a table and differ in few bits of the
    code are candidates; they are reranked by the cosine of the original vectors in double precision,
    and a pair is counted in the first table that holds it. A pair at the threshold is found with a
    probability of `recall` or so, closer ones more surely. Equal vectors are one row of the index;
    n_links counts all of them.

    Null, zero and empty vectors and those with null or non-finite components link with nothing, nor
    do vectors of different length. Null vec_ids keep their row: they are linked and counted, but a
    component's id is the smallest that isn't null. Empty tables give no rows.
    """
    given = stored(_given(vectors), "vectors")
    usable = given.filter("class is not null")
    # copies are combined before the shuffle; the hashes are the key, not the vector
    index = usable.groupBy("dim", "class", "twin").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    # from here on a distinct vector is named by a number of its own
    index = stored(index.withColumn("node", F.monotonically_increasing_id()), "distinct")
    lengths = index.groupBy("dim").agg(F.count(F.lit(1)).alias("many"))
    common = lengths.orderBy(F.col("many").desc(), "dim").limit(1)
    common = common.select("dim").first()
    if common is None:
        linked = given.sparkSession.createDataFrame([], "a long, b long, links long")
    else:
        sample = index.filter(F.col("dim") == common[0]).orderBy(F.xxhash64("class"), "class", "twin").limit(most)
        codes, radius = fitted(_unit(sample.select("v").toArrow()["v"]), index.count(), threshold, recall)
        linked = settled(given.sparkSession, lambda: _links(index, codes, threshold, radius, limit), "links")
    # each class: its own copies and those of the classes it is linked with
    degree = linked.groupBy("a").agg(F.sum("links").alias("others"))
    roots = connected_components(linked.select("a", "b"))
    label = checkpoint(
        index.select("node", "class", "twin", "n")
        .join(degree.withColumnRenamed("a", "node"), "node", "left")
        .join(roots, "node", "left")
        .select(
            "class",
            "twin",
            "n",
            (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    each = stored(by_group(usable.select("vec_id", "class", "twin"), label, ["class", "twin"], "n").select("vec_id", "n_links", "root"), "linked")
    least = stored(each.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    alone = given.filter("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        by_group(each, least, ["root"], "n")
        .select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
        .unionByName(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def _bytes_of(code: np.ndarray) -> pa.Array:
    width = code.shape[1] * 8
    offsets = np.arange(0, (len(code) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(code))])


def _links(index: DataFrame, codes: Codes, threshold: float, radius: int, limit: int) -> DataFrame:
    """(a, b, links): for each vector in a cell its root there (b) and the copies it is linked with."""

    def encode(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                some = batch.filter(pa.array(dims == d))
                code = codes.code(_unit(some.column("v")))
                raw = _bytes_of(code)
                for t, key in enumerate(codes.parts(code)):
                    yield pa.RecordBatch.from_arrays(
                        [some.column("dim"), pa.array(np.full(len(key), t, np.int32)), pa.array(key), some.column("node"), raw],
                        names=["dim", "t", "key", "node", "code"],
                    )

    rows = index.select("dim", "node", "v").mapInArrow(encode, "dim int, t int, key long, node long, code binary")
    cells = split_buckets(stored(rows, "buckets-of-codes"), _ORDER[:3], "node", limit).select(*_ORDER, "chunk", "node", "code")
    cells = cells.repartition(parts(index), *_ORDER).sortWithinPartitions(*_ORDER)

    def pairs(t, start, size):
        """Candidates of cells: in the first table that holds them, within the radius."""
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), "<u8").reshape(len(t), -1)
        chunk = t.column("chunk").to_numpy()
        apart = t.column("lo").to_numpy() != t.column("hi").to_numpy()
        own = t.column("t").to_numpy()
        part = codes.parts(code)
        for i, j in pairs_in_cells(start, size, 1 << 19):
            keep = ~apart[i] | (chunk[i] != chunk[j])
            i, j = i[keep], j[keep]
            keep = np.bitwise_count(code[i] ^ code[j]).sum(axis=1) <= radius
            i, j = i[keep], j[keep]
            for k in range(codes.tables):  # found already by an earlier table
                keep = (own[i] <= k) | (part[k][i] != part[k][j])
                i, j = i[keep], j[keep]
            yield i, j

    def candidates(batches):
        for t, start, size in whole_groups(batches, _keys):
            hit = np.zeros(len(t), bool)
            for i, j in pairs(t, start, size):
                hit[i] = hit[j] = True
            yield from t.filter(pa.array(hit)).to_batches()

    schema = "dim int, t int, key long, lo int, hi int, chunk int, node long, code binary"
    # only rows with a candidate take their vectors along
    found = stored(cells.mapInArrow(candidates, schema), "candidates")
    full = found.join(index.select("node", "n", "v"), "node")
    full = full.repartition(parts(index), *_ORDER).sortWithinPartitions(*_ORDER)

    def rerank(batches):
        for t, start, size in whole_groups(batches, _keys):
            dims = t.column("dim").to_numpy()
            for d in np.unique(dims):  # sorted, so each length's groups stand together
                a, b = np.searchsorted(dims, [d, d + 1])
                g = (start >= a) & (start < b)
                yield from _reranked(t.slice(a, b - a), start[g] - a, size[g])

    def _reranked(t, start, size):
        v, n, name = _unit(t.column("v")), t.column("n").to_numpy(), t.column("node").to_numpy()
        links, left, right = np.zeros(len(t), np.int64), [], []
        for i, j in pairs(t, start, size):
            for at in range(0, len(i), 1 << 16):
                a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                keep = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
                a, b = a[keep], b[keep]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                left.append(a)
                right.append(b)
        if left:
            root = local_roots(len(t), np.concatenate(left), np.concatenate(right))
            on = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(name[on]), pa.array(name[root[on]]), pa.array(links[on])], names=["a", "b", "links"])

    return full.mapInArrow(rerank, "a long, b long, links long")


def _keys(t: pa.Table) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in _ORDER]
