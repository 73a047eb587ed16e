"""SentencePiece encoding by suffix-array matching, and decoding.

For a batch of texts, what may hold a piece (a run of blanks with the characters behind it, up to the
next blank or line break) is gathered once per distinct string and concatenated. A suffix array of the
batch is searched for every piece of the vocabulary; the occurrence ranges become edges (from, to,
rank), sorted by position. The model merges neighbours of best rank first, so relaxing means: of all
edges that span exactly two of a unit's current symbols, the one of best rank (leftmost among equals)
joins them, until none is left. All units of a batch relax at once; very long ones by a heap.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import utf8

MARK = "▁"
_UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
_KEPT = 400_000
_AT_ONCE = 1 << 20
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Units with more characters than this are relaxed one by one.
_LONG = 96


class Vocabulary:
    """Pieces, ranks and byte pieces of a model file; ids of one-character pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.of_byte = {int(self.piece[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.of_byte.items()}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.id = {self.piece[i]: i for i in plain}
        long = sorted((i for i in plain if len(self.piece[i]) > 1), key=lambda i: (-model.get_score(i), i))
        self.longest = max(len(self.piece[i]) for i in plain)
        #: Neighbouring characters inside pieces; no symbol ever crosses any other pair.
        self.pairs = {p[i : i + 2] for p in (self.piece[i] for i in long) for i in range(len(p) - 1)}
        # pieces of two or more characters in order of rank; what has one score shares a rank
        score = [model.get_score(i) for i in long]
        self.rank = np.cumsum([0, *(a != b for a, b in zip(score, score[1:], strict=False))]).astype(np.int64)
        self.long = np.array(long, np.int64)
        self.text = np.array([self.piece[i] for i in long], f"<U{self.longest}")
        self.size = np.array([len(self.piece[i]) for i in long], np.int64)
        # what each id decodes to: bytes of byte pieces, nothing of control pieces, marks as blanks
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first `depth` characters, by prefix doubling."""
    rank = codes.astype(np.int64)
    k = 1
    while True:
        behind = np.concatenate([rank[k:], np.full(min(k, len(rank)), -1)])[: len(rank)]
        order = np.lexsort((behind, rank))
        a, b = rank[order], behind[order]
        fresh = np.zeros(len(order), np.int64)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(fresh)
        k *= 2
        if k >= depth or rank[order[-1]] == len(order) - 1:
            return order


def edges(text: str, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, number of the piece) of all occurrences of pieces of two characters or more, by position."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    order = suffix_array(codes, vocabulary.longest)
    depth = vocabulary.longest
    padded = np.concatenate([codes, np.zeros(depth, np.uint32)])
    # the suffixes' first characters in sorted order, and each piece's range among them
    heads = np.lib.stride_tricks.sliding_window_view(padded, depth)[order]
    heads = np.ascontiguousarray(heads).view(f"<U{depth}").ravel()
    low = np.searchsorted(heads, vocabulary.text, side="left")
    # the last suffix that begins with a piece: before the piece followed by the greatest character
    top = np.array([p + chr(0x10FFFF) * (depth - len(p)) for p in vocabulary.text.tolist()], f"<U{depth}")
    high = np.searchsorted(heads, top, side="right")
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    at = order[np.repeat(low, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
    by = np.lexsort((which, at))
    at, which = at[by], which[by]
    return at, at + vocabulary.size[which], which


def relax(n: int, unit_of: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the n + 1 places between characters still separate symbols when no edge can join two.

    Edges are sorted by position, so those of one unit stand together; unit_of is each edge's unit.
    """
    wall = np.ones(n + 1, bool)
    width = int(n).bit_length()
    live = np.arange(len(start))
    while len(live):
        s, e = start[live], end[live]
        inner = np.concatenate([[0], np.cumsum(wall)])
        inside = inner[e] - inner[s + 1]
        keep = wall[s] & wall[e] & (inside > 0)
        live, s, e, inside = live[keep], s[keep], e[keep], inside[keep]
        two = inside == 1
        if not two.any():
            break
        own = unit_of[live[two]]
        key = (rank[live[two]] << width) | s[two]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        best = np.minimum.reduceat(key, first)
        pick = key == np.repeat(best, np.diff(np.append(first, len(own))))
        # two pieces never share start and rank unless they have one score; the shorter goes first
        ps, pe, po = s[two][pick], e[two][pick], own[pick]
        once = np.concatenate([[True], po[1:] != po[:-1]])
        ps, pe = ps[once], pe[once]
        gone = inner[ps + 1]  # the number of walls up to the left symbol's start: the next one goes
        wall[np.flatnonzero(wall)[gone]] = False
    return wall


def relax_long(n: int, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """relax() for one long unit: a heap of the edges that span two symbols."""
    where = {(a, b): r for a, b, r in zip(start.tolist(), end.tolist(), rank.tolist(), strict=True)}
    nxt, prv = list(range(1, n + 2)), list(range(-1, n))
    heap = [(r, a, a + 1, b) for (a, b), r in where.items() if b == a + 2]
    heapq.heapify(heap)
    wall = np.ones(n + 1, bool)
    while heap:
        _, a, m, b = heapq.heappop(heap)
        if not (wall[a] and nxt[a] == m and m <= n and wall[m] and nxt[m] == b):
            continue
        wall[m] = False
        nxt[a], prv[b] = b, a
        if a > 0 and (prv[a], b) in where:
            heapq.heappush(heap, (where[prv[a], b], prv[a], a, b))
        if b < n and (a, nxt[b]) in where:
            heapq.heappush(heap, (where[a, nxt[b]], a, b, nxt[b]))
    return wall


class Encoder:
    """Ids of whole texts; distinct units are matched once per worker, up to `kept` of them."""

    def __init__(self, path: str, kept: int | None = None):
        self.vocabulary = Vocabulary(path)
        self.kept = kept
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.start = np.zeros(1 << 12, np.int32)
        self.size = np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.used = 0
        self._store(["\n"], np.array([self.vocabulary.of_byte[10]]), np.array([1]))

    def _store(self, units: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.index)
        while n + len(units) > len(self.start):
            self.start, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.size[n : n + len(units)] = size
        self.start[n : n + len(units)] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.index.update(zip(units, range(n, n + len(units)), strict=True))

    def _split(self, unit: str) -> tuple[str, str] | None:
        """A unit that ends in punctuation no piece joins to what stands before it."""
        head = unit.rstrip(_PUNCTUATION)
        if 0 < len(head) < len(unit) and unit[len(head) - 1 : len(head) + 1] not in self.vocabulary.pairs:
            return head, unit[len(head) :]
        return None

    def _learn_all(self, units: set[str]) -> None:
        """Units that end in punctuation are put together from two; the rest are matched."""
        index = self.index
        cut = {u: c for u in units if (c := self._split(u))}
        plain = {u for u in units if u not in cut}
        plain.update(x for c in cut.values() for x in c if x not in index)
        fresh = list(plain)
        for i in range(0, len(fresh), 30_000):
            self._learn(fresh[i : i + 30_000])
        if cut:
            both = np.fromiter((index[x] for c in cut.values() for x in c), np.int64, 2 * len(cut))
            size = self.size[both].astype(np.int64)
            ends = np.cumsum(size)
            ids = self.flat[np.arange(int(ends[-1])) + np.repeat(self.start[both] - (ends - size), size)]
            self._store(list(cut), ids, size.reshape(-1, 2).sum(axis=1))

    def _learn(self, units: list[str]) -> None:
        v = self.vocabulary
        text = "\n".join(units)  # no piece holds a line break
        start, end, which = edges(text, v) if len(text) > 1 else (np.zeros(0, np.int64),) * 3
        rank = v.rank[which]
        size = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(size + 1) - size - 1
        unit_of = np.searchsorted(begin, start, side="right") - 1
        short = size[unit_of] <= _LONG
        wall = relax(len(text), unit_of[short], start[short], end[short], rank[short])
        for u in np.flatnonzero(size > _LONG):
            a, b = np.searchsorted(unit_of, [u, u + 1])
            wall[begin[u] : begin[u] + size[u] + 1] = relax_long(
                int(size[u]), start[a:b] - begin[u], end[a:b] - begin[u], rank[a:b]
            )
        cuts = np.flatnonzero(wall).tolist()
        known: dict[str, list[int]] = {"\n": []}  # the breaks between units
        ids, many, upto = [], [], 0
        ends = (begin + size).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            while upto < len(ends) and a >= ends[upto]:
                many.append(len(ids))
                upto += 1
            piece = text[a:b]
            own = known.get(piece)
            if own is None:
                i = v.id.get(piece)
                own = known[piece] = [i] if i is not None else [v.of_byte[x] for x in piece.encode()]
            ids += own
        many += [len(ids)] * (len(units) - len(many))
        self._store(units, np.array(ids, np.int64), np.diff([0, *many]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: blanks become marks, one mark goes in front of a text that isn't empty."""
        out: list[np.ndarray] = []
        held, n = [], 0
        for t in texts:
            if len(t) > _AT_ONCE:  # cut at units and put together again
                out += self._encode(held)
                held, n = [], 0
                out.append(np.concatenate([self._encode([p], bool(k))[0] for k, p in enumerate(_cut(t))]))
                continue
            held.append(t)
            n += len(t)
            if n >= _AT_ONCE:
                out += self._encode(held)
                held, n = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[str], inside: bool = False) -> list[np.ndarray]:
        """inside: the texts stand inside longer ones, so no mark goes in front of them."""
        split = [_UNIT.findall(("" if inside else MARK) + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.index) > (self.kept or _KEPT):
            self._forget()
        units = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, units, repeat(-1)), np.int32, len(units))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn_all({units[i] for i in new})
            at[new] = [self.index[units[i]] for i in new]
        size = self.size[at]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[at] - (ends - size), size)]
        upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] for a, b in zip(upto, upto[1:], strict=False)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each list of ids: byte pieces joined to characters, marks to blanks, the first mark
        dropped. All lists are looked up at once in the table of what each id stands for."""
        v = self.vocabulary
        flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        size = v.raw_size[flat]
        ends = np.cumsum(size)
        raw = v.raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(v.raw_start[flat] - (ends - size), size)].tobytes()
        upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        out = []
        for own, a, b in zip(ids, upto, upto[1:], strict=False):
            spoken = next((i for i in own.tolist() if i not in v.silent), None) if len(own) and int(own[0]) in v.silent else int(own[0]) if len(own) else None
            marked = spoken is not None and v.piece[spoken].startswith(MARK)
            out.append(raw[a + marked : b].decode("utf-8", "replace"))
        return out


_BORDER = re.compile(f"\n|(?<![ {MARK}]) ")


def _cut(text: str) -> Iterator[str]:
    """A long text in parts of about _AT_ONCE characters, each of whole units: cut before a line break, or
    before a blank that follows neither blank nor mark; where there is none, not at all."""
    at = 0
    while len(text) - at > _AT_ONCE and (border := _BORDER.search(text, at + _AT_ONCE)):
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip[, ids][, decoded].

    ids are those of the model for the whole text; round_trip says whether decoding them gives the
    text back (it doesn't for texts that hold the mark itself, which becomes a blank). Null texts
    count as empty: no ids, crc32 of nothing, the empty text. Null doc_ids and repeated rows are
    documents like others; an empty table gives no rows.
    """
    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches):
        import hashlib
        import zlib

        code = encoder(path)
        for batch in batches:
            own, texts = batch.column(0), [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            for i in range(0, len(texts), 512):
                some = texts[i : i + 512]
                ids = code.encode(some)
                back = code.decode(ids)
                columns = [
                    own.slice(i, len(some)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                    pa.array([a == b for a, b in zip(some, back, strict=True)]),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                if with_text:
                    columns.append(pa.array(back, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t")).mapInArrow(run, schema)
