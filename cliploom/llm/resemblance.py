"""Groups of texts by the Jaccard similarity of their word shingles: prefix tables, SimHash pivots, whole sets.

Prefix tables: put every set of n shingles in one order common to all sets, whatever it is. Two sets
with similarity t or more share at least ceil(t n) shingles of either, so they share one of the first
n - ceil(t n) + 1 of each; and behind the first one that they share, both have enough left. Shingles
that a sample of the texts shows often come last, which keeps the tables' buckets small; the order
decides only the time, never the result.

Pairs that meet are discarded by the largest difference of their fingerprints' distances to the
pivots, then by the fingerprints' own distance, and the whole sets of the survivors are compared. At a
similarity of 0.8 fingerprints differ in about 10 of 64 bits, with a deviation of 3, so a radius of 24
loses next to nothing; but 3 % of all unrelated pairs are within it too. Two words more, of the same
shingles hashed anew, are held against it together with the first: 60 of 192 bits lose less still
(Bin(192, 0.15) is above 60 once in 10^8), and unrelated pairs are within them once in 10^7. Only between
sets of few shingles can fingerprints differ in more; sets under `_FEW` go past the screen.

Only what connects is needed. First every member of a bucket is held against two members that lead
the bucket, which is linear in the bucket. Members that this leaves in different components are then
screened in their buckets, but no pair leaves a bucket: each gives only what spans its groups of pairs
within the radius. The sets of such a group are brought together once, however many buckets its members
share, and compared where they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import by_group, local_roots, pairs_in_cells, parts, row_hash, settled, split_buckets, stored, utf8, whole_groups
from cliploom.llm.components import connected_components
from cliploom.llm.shingling import of_hashes, pivots, shingles, signed

_LAST = (1 << 63) - 1
_FEW = 8
#: The words of a set's fingerprint.
_WORDS = ["fp", "fq", "fr"]


def _prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a sorted set in the common order: those not in `common` by value, then by rank."""
    n = len(own)
    length = min(n, n - int(np.ceil(least * n - 1e-9)) + 1)
    if not len(common):
        return own[:length]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    known = common[at] == own
    rare = own[~known]
    if len(rare) >= length:
        return rare[:length]
    often = own[known][np.argsort(rank[at[known]])]
    return np.concatenate([rare, often[: length - len(rare)]])


def _common(docs: DataFrame, width: int, rows: int = 20_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that about `rows` documents hold at least twice, sorted, their ranks by count, and their counts.

    What the driver collects is bounded by `most`; it decides an order and how rows are dealt, not a result.
    """
    n = docs.count()
    part = int((1 << 30) * min(1.0, rows / max(n, 1)))
    some = docs.select(utf8().alias("t"), F.col("doc_id").cast("long").alias("doc_id"))
    some = some.filter(F.pmod(F.xxhash64("doc_id", "t"), F.lit(1 << 30)) < part).select("t")

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingles(t, width)) for t in batch.column(0).to_pylist()]
            h, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    found = some.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c > 1")
    got = found.orderBy(F.col("c").desc(), "h").limit(most).toPandas()
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    # rarer ones first; equal counts in the order of the hash, so that ranks are unique
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, got["c"].to_numpy(np.int64)))] = np.arange(len(h))
    return h[order], rank[order], got["c"].to_numpy(np.int64)[order]


def _small(batches, rows: int = 500):
    """Arrow batches in slices, so that few texts and their sets are in memory at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _words(own: np.ndarray) -> list[int]:
    """The words of a set's fingerprint: its SimHash, and those of its shingles hashed anew."""
    out = [of_hashes(own)]
    for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = (own ^ (own >> np.uint64(31))) * np.uint64(k)
        out.append(of_hashes((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)))
    return out


def _sets(docs: DataFrame, width: int, least: float, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(doc_id, row_hash, node, size, *_WORDS, prefix, row) of every document; node: a digest of its set;
    row: a number of its own."""
    names = ["doc_id", "row_hash", "node", "size", *_WORDS, "prefix"]

    def run(batches):
        import xxhash

        for batch in _small(batches):
            node, size, words, prefix = [], [], [], []
            for t in batch.column(2).to_pylist():
                h = shingles(t, width)
                own = np.unique(h)
                node.append(xxhash.xxh64_intdigest(own.tobytes()))
                size.append(len(own))
                words.append(_words(own))
                prefix.append(_prefix(own, common, rank, least).view(np.int64))
            words = np.array(words, np.uint64).reshape(-1, len(_WORDS)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(np.array(node, np.uint64).view(np.int64)),
                    pa.array(size, pa.int32()),
                    *[pa.array(np.ascontiguousarray(w)) for w in words.T],
                    pa.array(prefix, pa.list_(pa.int64())),
                ],
                names=names,
            )

    given = docs.select(F.col("doc_id").cast("long"), row_hash().alias("row_hash"), utf8().alias("t"))
    words = ", ".join(f"{w} long" for w in _WORDS)
    each = given.mapInArrow(run, f"doc_id long, row_hash long, node long, size int, {words}, prefix array<long>")
    return stored(each.withColumn("row", F.monotonically_increasing_id()), "shingles")


def _nodes(each: DataFrame) -> DataFrame:
    """(node, size, *_WORDS, id, hash, row, n): distinct sets, each with one of the n documents that have it."""
    one = F.first(F.struct("size", *_WORDS, F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.col("row_hash").alias("hash"), "row"))
    return stored(each.groupBy("node").agg(one.alias("one"), F.count(F.lit(1)).alias("n")).select("node", "one.*", "n"), "nodes")


def _met(each: DataFrame, nodes: DataFrame, hot: DataFrame, leaders: int) -> DataFrame:
    """(h, at, node, n, leads): the prefix tables' buckets of two or more; at: a shingle's place in the set.

    Buckets of the shingles in `hot` (h), which many documents have, are counted before they are dealt;
    all others are dealt once and counted where they lie.
    """
    several = nodes.filter("n > 1").select("node", F.col("row").alias("own"), "n")
    spare = by_group(each.select("node", "row"), several, ["node"], "n").filter("row <> own").select("row")
    rows = each.join(stored(spare, "spare"), "row", "left_anti").select(F.posexplode("prefix").alias("at", "h"), "node")
    # two members lead each bucket: by an order of its own, and by one of a few that many buckets share. So a
    # document is held against several of its group, among them ones that most of the group is held against
    leads = [F.min_by("node", F.xxhash64("node", k)) for k in ("h", F.pmod("h", F.lit(leaders)))]
    bucket = Window.partitionBy("h")
    rest = rows.join(F.broadcast(hot), "h", "left_anti").withColumn("n", F.count(F.lit(1)).over(bucket))
    rest = rest.filter("n > 1").withColumn("leads", F.array(*[lead.over(bucket) for lead in leads]))
    often = rows.join(F.broadcast(hot), "h")
    buckets = often.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.array(*leads).alias("leads"))
    names = ["h", "at", "node", "n", "leads"]
    often = often.join(F.broadcast(buckets.filter("n > 1")), "h")
    return stored(rest.select(*names).unionByName(often.select(*names)), "met")


def _alike(n: str, m: str, least: float):
    """Whether sets of these sizes can have a similarity of `least`."""
    return F.least(n, m) >= F.lit(least) * F.greatest(n, m) - 1e-9


def _screened(pairs: DataFrame, nodes: DataFrame, least: float, radius: int, wide: int, references: int) -> DataFrame:
    """Those of pairs (a, b) whose pivot distances and fingerprints differ by at most `radius` in the first
    word and by at most `wide` in all, and those with a set of few shingles."""
    who = nodes.select("node", "size", *_WORDS)
    x, y = ([f"{side}{w}" for w in _WORDS] for side in "xy")
    both = pairs.join(who.toDF("a", "n", *x), "a").join(who.toDF("b", "m", *y), "b").filter(_alike("n", "m", least))

    def distance(fp: str, pivot: int):
        return F.bit_count(F.col(fp).bitwiseXOR(F.lit(signed(int(pivot)))))

    apart = [F.abs(distance(x[0], p) - distance(y[0], p)) for p in pivots(references)]
    bits = [F.bit_count(F.col(v).bitwiseXOR(F.col(w))) for v, w in zip(x, y, strict=True)]
    near = (F.greatest(*apart) <= radius) & (bits[0] <= radius) & (sum(bits[1:], bits[0]) <= wide)
    return both.filter((F.least("n", "m") < _FEW) | near).select("a", "b")


def _near(i: np.ndarray, j: np.ndarray, n: np.ndarray, words: list[np.ndarray], distance: np.ndarray, radius: int, wide: int):
    """The screen on rows of one table: those of the index pairs i, j that pass."""
    few = np.minimum(n[i], n[j]) < _FEW
    for row in distance:
        keep = few | (np.abs(row[i] - row[j]) <= radius)
        i, j, few = i[keep], j[keep], few[keep]
    bits = np.zeros(len(i), np.int16)
    for k, w in enumerate(words):
        bits += np.bitwise_count(w[i] ^ w[j])
        keep = few | (bits <= (wide if k else radius))
        i, j, few, bits = i[keep], j[keep], few[keep], bits[keep]
    return i, j


def _table(t: pa.Table, reference: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The fingerprints of rows, and the pivot distance table of their first word."""
    words = [t.column(w).to_numpy().view(np.uint64) for w in _WORDS]
    return words, np.stack([np.bitwise_count(words[0] ^ p) for p in reference]).astype(np.int8)


def _groups(met: DataFrame, who: DataFrame, least: float, limit: int, radius: int, wide: int, references: int) -> DataFrame | None:
    """met (h, at, node), who (node, size, *_WORDS, root) -> (node, root) of the nodes with a partner of another
    root that shares a bucket and passes the screen; partners get the same root here. None where no
    bucket has two roots.

    Buckets are dealt into cells as in split_buckets. A cell gives what spans its partners, fewer rows
    than it has, not their pairs.
    """
    rooted = stored(met.join(who, "node"), "rooted")
    mixed = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    mixed = stored(mixed.filter("low <> high").select("h", "n"), "mixed")
    if mixed.isEmpty():
        return None
    s = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    cells = (
        by_group(rooted, mixed, ["h"], "n")
        .withColumn("s", s)
        .withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("s")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        .select("h", F.least("chunk", "o").alias("lo"), F.greatest("chunk", "o").alias("hi"), "chunk", "at", "node", "size", *_WORDS, "root")
    )
    order = ["h", "lo", "hi"]
    dealt = cells.repartition(parts(cells), *order).sortWithinPartitions(*order, "node")
    reference = pivots(references)

    def run(batches):
        for t, start, size in whole_groups(batches, lambda t: [t.column(c).to_numpy() for c in order]):
            node, n, root, chunk, at = (t.column(c).to_numpy() for c in ("node", "size", "root", "chunk", "at"))
            words, distance = _table(t, reference)
            apart = t.column("lo").to_numpy() != t.column("hi").to_numpy()
            rest = n - at  # with the shared shingle itself
            group = np.arange(len(t))
            for i, j in pairs_in_cells(start, size, 1 << 18):
                keep = (root[i] != root[j]) & (group[i] != group[j])
                keep &= np.minimum(rest[i], rest[j]) * (1 + least) >= least * (n[i] + n[j]) - 1e-9
                keep &= ~apart[i] | (chunk[i] != chunk[j])
                i, j = _near(i[keep], j[keep], n, words, distance, radius, wide)
                if len(i):
                    own = np.flatnonzero(group != np.arange(len(t)))
                    group = local_roots(len(t), np.concatenate([own, i]), np.concatenate([group[own], j]))
            own = np.flatnonzero(group != np.arange(len(t)))
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[group[own]])], names=["a", "b"])

    return connected_components(dealt.mapInArrow(run, "a long, b long"))


def _across(found: DataFrame, who: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, least: float, limit: int, radius: int, wide: int, references: int) -> DataFrame:
    """(a, b): links between nodes of one group in `found` (node, root) but of different roots in `who`, enough
    to connect what is linked. Sets meet in cells, as in split_buckets, and are compared there."""
    found = stored(found.select("node", F.col("root").alias("grp")), "groups")
    held = _held(found.select("node"), nodes, docs, width).select("node", "own")
    order = ["grp", "lo", "hi"]
    cells = split_buckets(found.join(who, "node"), ["grp"], "node", limit).join(held, "node")
    dealt = cells.repartition(parts(cells), *order).sortWithinPartitions(*order)
    reference = pivots(references)

    def run(batches):
        for t, start, size in whole_groups(batches, lambda t: [t.column(c).to_numpy() for c in order]):
            node, n, root, chunk = (t.column(c).to_numpy() for c in ("node", "size", "root", "chunk"))
            own = t.column("own").combine_chunks()
            words, distance = _table(t, reference)
            apart = t.column("lo").to_numpy() != t.column("hi").to_numpy()
            # rows of one root in one cell are connected already; `first` names such a row for each
            cell = np.repeat(np.arange(len(start)), size)
            _, first, of = np.unique(np.stack([cell, root]), axis=1, return_index=True, return_inverse=True)
            up = first[of.ravel()]

            def top(x, up=up):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            a, b = [], []
            for i, j in pairs_in_cells(start, size, 1 << 18):
                keep = (up[i] != up[j]) & (~apart[i] | (chunk[i] != chunk[j]))
                keep &= np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
                for x, y in zip(*(k.tolist() for k in _near(i[keep], j[keep], n, words, distance, radius, wide)), strict=True):
                    p, q = top(x), top(y)
                    if p != q and _similar(own[x], own[y], least):
                        up[max(p, q)] = min(p, q)
                        a.append(node[x])
                        b.append(node[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _similar(x: pa.Scalar, y: pa.Scalar, least: float) -> bool:
    """Whether two sets, as bytes, have a Jaccard similarity of `least` or more."""
    x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
    return len(np.intersect1d(x, y, True)) * (1 + least) >= least * (len(x) + len(y)) - 1e-9


def _with_sets(pairs: DataFrame, held: DataFrame, column: str, key: str, other: str, name: str, part: int = 4096) -> DataFrame:
    """pairs with what `column` has of the set of `key`; where a node has many pairs they are dealt into parts of about `part`."""
    sets = held.select(F.col("node").alias(key), F.col(column).alias(name))
    many = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > part)
    many = stored(many, "many")
    if many.isEmpty():
        return pairs.join(sets, key)
    # fewer than one node in `part`, each with its number of pairs
    deal = F.coalesce(F.ceil(F.col("many") / F.lit(part)), F.lit(1)).cast("int")
    sets = sets.join(many, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), deal - 1))).drop("many")
    total = pairs.count()
    hot = many.filter(F.col("many") * 1000 > total)  # fewer than a thousand, so it may be sent to every task
    rest = many.filter(F.col("many") * 1000 <= total)
    dealt = pairs.join(F.broadcast(hot.withColumnRenamed("many", "hot")), key, "left").join(rest, key, "left")
    deal = F.coalesce(F.ceil(F.coalesce("hot", "many") / F.lit(part)), F.lit(1)).cast("int")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(other), deal).cast("int")).drop("many", "hot")
    return dealt.join(sets, [key, "part"]).drop("part")


def _parity(own: np.ndarray) -> bytes:
    """A set's size, and for each value of the lower bits of a hash whether an odd number of the set's has it:
    a bit each, four to eight times as many as the set has members. About a tenth of the set's bytes."""
    b = max(64, 1 << (4 * len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount((own & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1
    return np.int64(len(own)).tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _may_be_similar(x: pa.Scalar, y: pa.Scalar, least: float) -> bool:
    """False only where sets of these parities can't have a similarity of `least`: they differ in as many
    members as their parities in bits, or more. The longer one is folded; that is its parity of fewer bits."""
    x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
    both = int(x[0] + y[0])
    x, y = sorted((x[1:], y[1:]), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (1 + least) <= both * (1 - least) + 1e-9


def _held(ids: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, own, parity): the sets of ids (node), made again of the texts, and their parities."""
    # 24 bytes for each document that met another one: Spark sends it to every task only if it is small
    chosen = stored(ids.join(nodes.select("node", "id", "hash"), "node"), "chosen")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), row_hash().alias("hash"), utf8().alias("t"))

    def hashes(batches):
        for batch in _small(batches):
            own = [np.unique(shingles(t, width)) for t in batch.column(1).to_pylist()]
            both = [pa.array([f(x) for x in own], pa.binary()) for f in (np.ndarray.tobytes, _parity)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *both], names=["node", "own", "parity"])

    held = stored(texts.join(chosen, ["id", "hash"]).select("node", "t").mapInArrow(hashes, "node long, own binary, parity binary"), "held")
    if held.count() > chosen.count():  # rows repeated whole
        held = stored(held.dropDuplicates(["node"]), "held")
    return held


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """Those of pairs (a, b) whose whole sets have a Jaccard similarity of `least` or more. Their parities,
    a tenth of the bytes, discard those well below it without loss."""
    pairs = stored(pairs.select("a", "b"), "pairs")
    held = _held(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, docs, width)

    def kept(pairs: DataFrame, column: str, alike: Callable) -> DataFrame:
        sets = held.select("node", column)
        both = _with_sets(_with_sets(pairs, sets, column, "a", "b", "x"), sets, column, "b", "a", "y")

        def run(batches):
            for batch in batches:
                keep = [alike(x, y, least) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return both.mapInArrow(run, "a long, b long")

    return kept(stored(kept(pairs, "parity", _may_be_similar), "close"), "own", _similar)


def resembling(
    docs: DataFrame, width: int = 5, least: float = 0.8, limit: int = 512, radius: int = 24, wide: int = 60, references: int = 16, leaders: int = 8
) -> DataFrame:
    """(doc_id, row_hash, class) of every document: documents are of one class if shingle sets of
    Jaccard similarity `least` or more connect them. Texts without words are alike.

    radius is that of the fingerprints' first word, wide that of all words; leaders is how many orders of
    the sets there are, by each of which a bucket may choose its leader.
    """
    spark = docs.sparkSession
    common, rank, count = _common(docs, width)
    each = _sets(docs, width, least, common, rank)
    nodes = _nodes(each)
    # of about 20,000 documents; a bucket of others has less than a hundredth of all documents
    hot = spark.createDataFrame([(h,) for h in common[count > 64].view(np.int64).tolist()], "h long")

    def pass_one() -> DataFrame:
        led = met.select("node", F.explode(F.array_distinct("leads")).alias("lead")).filter("node <> lead")
        pairs = led.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
        return _verified(_screened(pairs, nodes, least, radius, wide, references), nodes, docs, width, least)

    met = _met(each, nodes, hot, leaders)
    first = settled(spark, pass_one, "resembling")
    # two rounds join most of what is connected; what they leave apart is only compared again
    roots = stored(connected_components(first, rounds=2), "roots")
    who = nodes.select("node", "size", *_WORDS).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def pass_two() -> DataFrame:
        # where at most one member doesn't lead, all pairs have been compared
        more = met.filter(F.col("n") > F.size(F.array_distinct("leads")) + 1).select("h", "at", "node")
        found = _groups(more, who, least, limit, radius, wide, references)
        return first.limit(0) if found is None else _across(found, who, nodes, docs, width, least, min(limit, 256), radius, wide, references)

    roots = connected_components(first.union(settled(spark, pass_two, "across")))
    each = each.select("doc_id", "row_hash", "node")
    copies = nodes.select("node", "n").join(roots, "node", "left")
    label = stored(copies.select("node", "n", F.coalesce("root", "node").alias("class")), "label")
    return by_group(each, label, ["node"], "n").select("doc_id", "row_hash", "class")
