"""Best-fit packing of documents into sequences by exact-complement hashing.

What can share a sequence depends on lengths alone, so the packing is planned on the table of how many
pieces have each length: at most `capacity` numbers, however many documents there are. The plan says
how often each combination of lengths is used; Spark numbers the pieces of each length without gaps and
deals them into the combinations' places by number.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import numbered, row_hash, settled, stored, utf8
from cliploom.llm.words import ByteEncoder, encoder, ended, id_kind, packed, slices


class Sums:
    """Index of the sums of one, two and three lengths, as far as pieces of them are left.

    left[n] pieces have length n. Counts only fall, so each sum's pairs (and triples) are gone through
    once, the greatest first length first, and what is used up isn't looked at again.
    """

    def __init__(self, left: np.ndarray):
        self.left = left.tolist()
        self.pair_at = list(range(-1, len(left) - 1))
        self.triple_at = list(range(-2, len(left) - 2))

    def single(self, n: int) -> tuple[int, ...] | None:
        return (n,) if self.left[n] else None

    def pair(self, n: int, held: int = 0) -> tuple[int, ...] | None:
        """Two lengths of sum n, one piece of length `held` being spoken for."""
        left, x, settled_ = self.left, self.pair_at[n], True
        while 2 * x >= n:
            y = n - x
            if left[x] and left[y] and (x != y or left[x] > 1):
                need = 1 + (x == y)
                if held not in (x, y) or left[held] > need:
                    return x, y
                settled_ = False  # only held back for now
            elif settled_:
                self.pair_at[n] = x - 1
            x -= 1
        return None

    def triple(self, n: int) -> tuple[int, ...] | None:
        x = self.triple_at[n]
        while 3 * x >= n:
            if self.left[x] and (rest := self.pair(n - x, x)):
                return x, *rest
            x -= 1
            self.triple_at[n] = x
        return None


def exact(counts: np.ndarray, deep: int = 3) -> tuple[list[tuple[int, tuple[int, ...]]], np.ndarray]:
    """(how often, lengths) of combinations that fill a sequence wholly, and the counts of what is left.

    counts[n] pieces have length n; the last index is the capacity. Longest first, the gap behind a piece
    is looked up as one length, a pair, then a triple (up to `deep` lengths); a combination is used as often as all of its
    lengths are there. A length whose gap none of them fills is set aside.
    """
    room = len(counts) - 1
    found = [(int(counts[room]), (room,))] if counts[room] else []
    sums = Sums(counts)
    left, rest = sums.left, np.zeros_like(counts)
    left[room] = 0
    for longest in range(room - 1, 0, -1):
        gap = room - longest
        while left[longest]:
            left[longest] -= 1  # the piece itself
            fill = sums.single(gap) or deep > 1 and sums.pair(gap) or deep > 2 and sums.triple(gap)
            left[longest] += 1
            if not fill:
                rest[longest], left[longest] = left[longest], 0
                break
            lengths = (longest, *fill)
            times = min(left[n] // k for n, k in Counter(lengths).items())
            for n in lengths:
                left[n] -= times
            found.append((times, lengths))
    return found, rest


def best_fit(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths) by best fit, longest first: each piece goes where the least room is left."""
    room = len(counts) - 1
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    gaps = np.zeros(room + 1, np.int64)  # how many sequences have each gap

    def put(gap: int, times: int, lengths: tuple[int, ...]) -> None:
        if times:
            open_.setdefault(gap, []).append((times, lengths))
            gaps[gap] += times

    for n in range(room, 0, -1):
        many = int(counts[n])
        while many:
            fitting = np.flatnonzero(gaps[n:])
            gap = n + int(fitting[0]) if len(fitting) else room
            times, lengths = open_[gap].pop() if len(fitting) else (many, ())
            gaps[gap] -= times if len(fitting) else 0
            each = gap // n  # so many fit one behind the other
            full = min(times, many // each)
            put(gap - each * n, full, lengths + (n,) * each)
            many, times = many - full * each, times - full
            if many and times and many < each:
                put(gap - many * n, 1, lengths + (n,) * many)
                many, times = 0, times - 1
            if len(fitting):
                put(gap, times, lengths)
    return [x for own in open_.values() for x in own]


def plan(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths) of all sequences: exact complements first, then best fit of what they leave.

    Short pieces used up in pairs and triples can be missing later, most where pieces are few; so the
    plan with the fewest sequences of those with up to three, two or one lengths to a gap is taken.
    """
    plans = []
    for deep in (3, 2, 1):
        found, rest = exact(counts, deep)
        plans.append(found + best_fit(rest))
    return min(plans, key=lambda p: sum(times for times, _ in p))


def places(found: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first number, sequence_id of that, offset), sorted: of a length, the pieces from one
    first number up to the next go to consecutive sequences, each at the offset."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for times, lengths in found:
        at = 0
        for n in lengths:
            rows.append((n, used[n], sequence, at))
            used[n] += times
            at += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, path: str, capacity: int, end: int = 0, vocabulary: int = 50_257, with_ids: bool = False) -> DataFrame:
    """(doc_id, salt, piece, start, length, ids_crc32[, ids]) of every document, written.

    A document's ids and the end id are cut from behind into pieces of `capacity`, so only the first may
    be shorter. Null texts count as empty and have the end id alone. salt tells rows of one doc_id apart.
    """
    kind = id_kind(vocabulary)

    def run(batches):
        code = encoder(path, kind=ByteEncoder)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(2)):
                ids, size = ended(*code.encode(texts), end)
                own = [c.slice(at, len(texts)) for c in batch.columns[:2]]
                at += len(texts)
                yield _cut(own, ids, size)

    def _cut(own, ids, size):
        many = -(-size // capacity)
        doc = np.repeat(np.arange(len(size)), many)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        first = size - (many - 1) * capacity
        start = np.where(number == 0, 0, first[doc] + (number - 1) * capacity)
        length = np.where(number == 0, first[doc], capacity)
        raw = memoryview(ids.astype("<u4").tobytes())
        ends = (4 * np.cumsum(length)).tolist()
        crc = [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        columns = [c.take(pa.array(doc)) for c in own]
        columns += [pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(crc, np.int64))]
        names = ["doc_id", "salt", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(packed(ids.astype(kind), length))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("salt"), utf8().alias("t"))
    schema = "doc_id long, salt long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return stored(given.mapInArrow(run, schema), "pieces", compression="zstd")


def counted(cut: DataFrame, capacity: int) -> np.ndarray:
    """How many pieces have each length up to the capacity; what is collected is one row a length."""
    out = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        out[r["length"]] = r["count"]
    return out


def placed(cut: DataFrame, capacity: int) -> DataFrame:
    """The pieces with sequence_id and offset."""
    table = places(plan(counted(cut, capacity)))
    key = (table[:, 0] << 48) | table[:, 1]  # a length's pieces are fewer than 2**48

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            number = batch.column(names.index("pos")).to_numpy()
            length = batch.column(names.index("length")).to_numpy()
            own = table[np.searchsorted(key, (length << 48) | number, side="right") - 1]
            columns = [c for c, n in zip(batch.columns, names, strict=True) if n != "pos"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own[:, 2] + number - own[:, 1]), pa.array(own[:, 3].copy())], names=[n for n in names if n != "pos"] + ["sequence_id", "offset"])

    order = numbered(cut, ["length"], ["doc_id", "salt", "piece"], "piece-order")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in order.schema if f.name != "pos"]
    return order.mapInArrow(run, ", ".join([*kept, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, vocabulary: int = 50_257, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Sequences hold `capacity` ids at most; documents of no more are never cut. Pieces lie one behind the
    other without gaps. Null doc_ids and repeated rows are documents of their own; sequence_ids run from
    0 without gaps; an empty table gives no rows.
    """

    def made() -> DataFrame:
        return placed(pieces(docs.select("doc_id", "text"), path, capacity, end, vocabulary, with_ids), capacity)

    found = settled(docs.sparkSession, made, "packed")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(found: DataFrame) -> DataFrame:
    """The sequences of pack(..., with_ids=True): sequence_id, length, doc_ids and offsets of its pieces,
    ids (little-endian, as narrow as the vocabulary allows). A group is one sequence, bounded by the capacity."""
    row = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return found.groupBy("sequence_id").agg(row.alias("own")).select(
        "sequence_id",
        F.aggregate("own", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"),
        F.col("own.doc_id").alias("doc_ids"),
        F.col("own.offset").alias("offsets"),
        F.unhex(F.array_join(F.transform("own", lambda x: F.hex(x["ids"])), "")).alias("ids"),
    )
