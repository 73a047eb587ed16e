"""Alignment of two tokenizers over the same bytes, by merge path.

Of each text, the byte offsets where tokens of A and of B end are two ascending lists; the texts of a
slice lie one behind the other, so a slice has two lists. Binary searches on the diagonals of their
merge divide it into pieces of equal work, whatever the lengths of the texts are. A piece emits the
overlaps that end in it and the ends that both lists share; groups that cross a border are stitched.

How many documents link an id pair is counted for the whole corpus: slices send their distinct pairs
once with the number of their documents, and get the sums back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm import pieces
from cliploom.llm.common import settled, stored, utf8
from cliploom.llm.words import ByteEncoder, encoder, flat_bytes, slices

#: Merge steps to a piece, and bytes of text to a slice (more only where one text is longer).
STEPS = 1 << 16
SLICE = 1 << 22
#: Distinct units of B that a worker remembers.
KEPT = 600_000


class Bytes:
    """What each id of a vocabulary stands for: `flat` bytes, `start` and `size` by id."""

    def __init__(self, of: list[bytes]):
        self.flat = np.frombuffer(b"".join(of), np.uint8)
        self.size = np.array([len(x) for x in of], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[ids] - (ends - size), size)]


def byte_level(path: str) -> Bytes:
    """The bytes of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the other
    bytes, in order, for the characters from 256 on."""
    from tokenizers import Tokenizer

    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    known = Tokenizer.from_file(path)
    names = [known.id_to_token(i) or "" for i in range(known.get_vocab_size())]
    return Bytes([bytes(of[c] for c in n) if all(c in of for c in n) else n.encode() for n in names])


def piece_bytes(vocabulary: pieces.Vocabulary) -> Bytes:
    ends = np.append(vocabulary.raw_start, len(vocabulary.raw))
    whole = vocabulary.raw.tobytes()
    return Bytes([whole[a:b] for a, b in zip(ends, ends[1:], strict=False)])


def borders(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ascending lists (a first among equals) is cut every `steps` elements: how many
    of a and of b come before each cut, both ends included. All diagonals are searched at once. Equal
    elements of a and b stay in one piece."""
    diagonal = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # of a diagonal, a[middle] comes before b[diagonal - 1 - middle]: the cut lies behind it
        before = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(diagonal - 1 - middle, 0, len(b) - 1)])
        low = np.where(before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    i, j = low, diagonal - low
    split = (i > 0) & (j < len(b))
    split[split] = a[i[split] - 1] == b[j[split]]
    return i, j + split


def piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One piece of the merge: its distinct ends, and how many of a and of b lie before each."""
    ends = np.sort(np.concatenate([a, b]), kind="stable")
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])] if len(ends) else ends
    return ends, np.searchsorted(a, ends), np.searchsorted(b, ends)


def overlaps(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, number of a's token, number of b's token, shared) of all overlaps, in order.

    a and b: ascending ends of tokens that cover the same bytes. Between two neighbouring ends of either
    list lies the overlap of one token of each. shared says which ends close a group.
    """
    i, j = borders(a, b, steps)
    found = []
    for i0, i1, j0, j1 in zip(i, i[1:], j, j[1:], strict=False):
        own_a, own_b = a[i0:i1], b[j0:j1]
        ends, at_a, at_b = piece(own_a, own_b)
        # an end that is no end of a lies in the token of a that ends next, in this piece or a later one
        there_a = np.append(own_a, -1)[at_a] == ends
        there_b = np.append(own_b, -1)[at_b] == ends
        found.append((ends, i0 + at_a, j0 + at_b, there_a & there_b))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Aligner:
    """Both encoders and what their ids stand for; one for each worker process."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoder(path_a, True, ByteEncoder), pieces.Encoder(path_b, KEPT)
        self.bytes_a, self.bytes_b = byte_level(path_a), piece_bytes(self.b.vocabulary)
        number_a, number_b = (np.arange(len(x.size)) for x in (self.bytes_a, self.bytes_b))
        # decimals with what stands behind them: `,` inside a group, `|` behind its last of A, `;` behind its last of B
        self.words = pa.array([f"{n}{x}".encode() for own, ends in ((number_a, ",|"), (number_b, ",;")) for n in own.tolist() for x in ends], pa.large_binary())
        self.b_from = 2 * len(number_a)

    def encode(self, texts: pa.Array):
        """(ids A, ids B, sizes A, sizes B, bytes of each) by text: a blank and the text. Texts that are empty
        or that the joined tokens of A or B don't give back have none."""
        spaced = pc.binary_join_element_wise(pa.scalar(b" ", pa.binary()), texts, pa.scalar(b"", pa.binary()))
        data, offsets = flat_bytes(spaced)
        width = np.diff(offsets).astype(np.int64)
        ids_a, n_a = self.a.encode(spaced)
        found = self.b.encode([t.decode("utf-8", "replace") for t in texts.to_pylist()])
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        ids_b = np.concatenate([np.zeros(0, np.uint32), *found])
        good = width > 1
        for ids, n, of in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)):
            total = np.concatenate([[0], np.cumsum(of.size[ids])])
            good &= np.diff(total[np.concatenate([[0], np.cumsum(n)])]) == width
        for ids, n, of in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)):
            # of the texts whose lengths agree, those with another byte
            wrong = of.joined(ids[np.repeat(good, n)]) != data[np.repeat(good, width)]
            if wrong.any():
                own = np.repeat(np.flatnonzero(good), width[good])
                good[own[wrong]] = False
        return ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)], n_a * good, n_b * good, width * good

    def align(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        """By text: n_a, n_b, n_groups, n_links, groups (memory of `a1,a2|b1;...`); by link: doc, a, b, key."""
        ids_a, ids_b, n_a, n_b, width = self.encode(texts)
        ends_a, ends_b = np.cumsum(self.bytes_a.size[ids_a]), np.cumsum(self.bytes_b.size[ids_b])
        ends, link_a, link_b, shared = overlaps(ends_a, ends_b)
        doc = np.searchsorted(np.cumsum(width), ends)  # texts without tokens have no bytes, so no end falls to them
        n = len(n_a)
        key = (ids_a[link_a].astype(np.int64) << 32) | ids_b[link_b]
        close_a, close_b = link_a[shared], link_b[shared]
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(doc[shared], minlength=n),
            "n_links": np.bincount(doc, minlength=n),
            "groups": self._groups(ids_a, ids_b, n_a, n_b, close_a, close_b),
            "doc": doc,
            "a": link_a - (np.cumsum(n_a) - n_a)[doc],
            "b": link_b - (np.cumsum(n_b) - n_b)[doc],
            "key": key,
        }

    def _groups(self, ids_a, ids_b, n_a, n_b, close_a, close_b) -> list[memoryview]:
        """close: each group's last token of A and of B. A group begins behind the one before it, in whichever
        piece of the merge that was."""
        size_a, size_b = np.diff(close_a, prepend=-1), np.diff(close_b, prepend=-1)
        before_b = np.repeat(close_b + 1 - size_b, size_a)  # tokens of B before each token of A
        upto_a = np.repeat(close_a + 1, size_b)  # tokens of A before each token of B
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[close_a] = last_b[close_b] = True
        code[np.arange(len(ids_a)) + before_b] = 2 * ids_a.astype(np.int64) + last_a
        code[np.arange(len(ids_b)) + upto_a] = self.b_from + 2 * ids_b.astype(np.int64) + last_b
        text = self.words.take(pa.array(code))
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        at = offsets[np.concatenate([[0], np.cumsum(n_a + n_b)])] if len(code) else np.zeros(len(n_a) + 1, np.int64)
        raw = memoryview(text.buffers()[2] or b"")
        return [raw[x : y - 1] if y > x else raw[:0] for x, y in zip(at.tolist(), at[1:].tolist(), strict=False)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    key = (path_a, path_b)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


_COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """Rows of two sorts, told apart by `pairs`. Without it: a document, with its distinct pairs as numbers in
    its slice's list and how often it has each. With it: a slice's list, and by pair its documents."""
    names = ["slice", *[c.split()[0] for c in _COUNTS.split(", ")], "own", "times", "pairs", "docs", *["groups"] * with_groups]
    schema = f"slice long, {_COUNTS}, own binary, times binary, pairs array<long>, docs array<long>" + ", groups string" * with_groups

    def run(batches):
        code = aligner(path_a, path_b)
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), SLICE):
                doc_ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                yield from rows(code, doc_ids, texts, (part << 32) + number)
                number += 1

    def rows(code, doc_ids, texts, place):
        found = code.align(texts)
        n = len(texts)
        pairs, own = np.unique(found["key"], return_inverse=True)
        each, times = np.unique(found["doc"] * max(1, len(pairs)) + own, return_counts=True)
        doc, own = np.divmod(each, max(1, len(pairs)))
        docs_of = np.bincount(own, minlength=len(pairs))
        many = np.bincount(doc, minlength=n)
        sha = [hashlib.sha256(g).hexdigest() if len(g) else "" for g in found["groups"]]
        columns = [pa.array(np.full(n, place)), doc_ids, *[pa.array(found[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(sha, pa.string())]
        columns += [_binary(own, many), _binary(times, many), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
        if with_groups:
            columns.append(pa.array([str(g, "ascii") for g in found["groups"]], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=names)
        one = {"slice": pa.array([place]), "pairs": _list(pairs), "docs": _list(docs_of)}
        yield pa.RecordBatch.from_arrays([one.get(c, pa.nulls(1, columns[i].type)) for i, c in enumerate(names)], names=names)

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t")).mapInArrow(run, schema), "aligned", compression="zstd")


def _binary(values: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(4 * size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(values.astype("<u4"))])


def _list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int64)))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best) of the corpus: in how many documents A's id (upper half) and B's are linked, and whether
    no other pair of A's id is in more."""
    total = _listed(found).groupBy("pair").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("id_a")  # at most as many rows as B has ids
    return total.withColumn("id_a", F.shiftright("pair", 32)).withColumn("best", F.col("n") == F.max("n").over(own)).drop("id_a")


def _listed(found: DataFrame) -> DataFrame:
    each = found.filter("pairs IS NOT NULL").select("slice", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "x"))
    return each.select("slice", "at", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("n"))


def cross_alignment(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups].

    A (byte-level) reads a blank and the text, B (pieces) the text, before which it puts the blank itself;
    special tokens' strings are plain text. Null and empty texts, and texts that the tokens don't give
    back (such as those with the mark of B), have no tokens: zeros and no digest. Null doc_ids and
    repeated rows are documents of their own; an empty table gives no rows.
    """
    kept = [c.split()[0] for c in _COUNTS.split(", ")] + ["groups"] * with_groups
    out = f"{_COUNTS}{', groups string' * with_groups}, n_best long, count_sum long"

    def look_up(known: pa.Table, rows: pa.Table) -> pa.Table:
        n, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        at = known["at"].to_numpy()
        n[at], best[at] = known["n"].to_numpy(), known["best"].to_numpy()
        (own, size), (times, _) = (_flat(rows[c]) for c in ("own", "times"))
        sums = [np.diff(np.concatenate([[0], np.cumsum(v[own] * times)])[np.concatenate([[0], np.cumsum(size)])]) for v in (best, n)]
        return pa.table([rows[c] for c in kept] + [pa.array(x) for x in sums], names=[*kept, "n_best", "count_sum"])

    def made() -> DataFrame:
        found = aligned(docs.select("doc_id", "text"), path_a, path_b, with_groups)
        counts = stored(pair_counts(found), "pair-counts")
        known = _listed(found).drop("n").join(counts, "pair").select(F.col("slice").alias("place"), "at", "n", F.col("best").cast("int").alias("best"))
        rows = found.filter("pairs IS NULL").select("slice", *kept, "own", "times")
        return known.groupBy("place").cogroup(rows.groupBy("slice")).applyInArrow(look_up, out)

    done = settled(docs.sparkSession, made, "alignment")
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column, one row after another, and how many each row has."""
    parts = [flat_bytes(c) for c in column.chunks]
    flat = np.concatenate([np.zeros(0, np.uint8), *[d for d, _ in parts]]).view("<u4").astype(np.int64)
    return flat, np.concatenate([np.zeros(0, np.int64), *[np.diff(o).astype(np.int64) // 4 for _, o in parts]])
