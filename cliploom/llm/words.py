"""Encoding with the tokenizers library, word by word and remembered."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_KEPT = 1_000_000
#: Bytes of text worked through at a time, more only where one text is longer.
_AT_ONCE = 1 << 23
_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Ids of whole texts by a tokenizer whose tokens never cross ASCII white space.

    The library's pre-tokenizer drops white space and every step before it works within words, so the
    ids of a text are those of its words, one after another. Arrow splits texts and numbers the
    distinct words of a slice, so Python sees each of them once a slice; a distinct word goes through
    the library once per worker, and what is remembered is bounded.
    """

    #: A special token of the vocabulary, to keep words apart.
    marker = b"<|startoftext|>"

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        # a task has one core: threads inside the library only cost
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.cutting = Tokenizer.from_file(path)
        self.mark = self.cutting.token_to_id(self.marker.decode())
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.start = np.zeros(1 << 12, np.int32)
        self.size = np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _split(self, word: bytes) -> tuple[bytes, bytes] | None:
        """A word that ends in punctuation behind a letter (ASCII or Latin-1): the library cuts it there too.

        Apostrophes begin contractions and special tokens hold punctuation, so such words stay whole.
        """
        head = word.rstrip(_PUNCTUATION)
        if len(head) == len(word) or not head or b"<|" in word:
            return None
        last = head[-1]
        if last in _LETTERS or len(head) > 1 and head[-2] == 0xC3 and 0x80 <= last <= 0xBF and last not in (0x97, 0xB7):
            return head, word[len(head) :]
        return None

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words, in one flat store; words with a comma or stop are put together from two."""
        index = self.index
        cut = {w: c for w in words if (c := self._split(w))}
        plain = {w for w in words if w not in cut}
        plain.update(x for c in cut.values() for x in c if x not in index)
        self._encode_words(list(plain))
        if cut:
            a = np.fromiter((index[c[0]] for c in cut.values()), np.int64, len(cut))
            b = np.fromiter((index[c[1]] for c in cut.values()), np.int64, len(cut))
            both = np.stack([a, b], axis=1).ravel()
            size = self.size[both]
            ends = np.cumsum(size)
            ids = self.flat[np.arange(int(ends[-1])) + np.repeat(self.start[both] - (ends - size), size)]
            self._store(list(cut), ids, size.reshape(-1, 2).sum(axis=1))

    def _encode_words(self, words: list[bytes]) -> None:
        """Words go to the library in rows of 200, a special token between them that cuts before all else;
        words that may hold one themselves go alone."""
        alone = [w for w in words if b"<|" in w]
        if alone:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in alone], add_special_tokens=False)]
            self._store(alone, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64))
            words = [w for w in words if b"<|" not in w]
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            rows = [self.marker.join([*some[j : j + 200], b""]).decode("utf-8", "replace") for j in range(0, len(some), 200)]
            found = self.cutting.encode_batch_fast(rows, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            self._store(some, np.delete(ids, ends), np.diff(ends, prepend=-1) - 1)

    def _store(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        n, m = len(self.index), len(ids)
        while n + len(words) > len(self.start):
            self.start, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size))
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.size[n : n + len(words)] = size
        self.start[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + m] = ids
        self.used += m
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary())
        found = [self._encode(part) for part in slices(texts)]
        if not found:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text = texts.view(pa.string())
        # the library lower-cases anyway; only its special tokens are told apart by case
        special = pc.match_substring(text, "<|")
        low = pc.ascii_lower(text)
        if pc.any(special).as_py():
            low = pc.if_else(special, text, low)
        split = pc.ascii_split_whitespace(low)
        ids, size = self._look_up(split.flatten())
        n = pc.list_value_length(split).to_numpy()
        upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
        return ids, np.diff(upto)

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word)."""
        coded = words.dictionary_encode()
        words = coded.dictionary.view(pa.binary()).to_pylist()
        if len(self.index) > _KEPT:
            self._forget()
        place = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0).tolist()
        if new:
            self._learn([words[i] for i in new])
            place[new] = [self.index[words[i]] for i in new]
        at = place[coded.indices.to_numpy()]
        size = self.size[at].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[at] - (ends - size), size)], size


class ByteEncoder(WordEncoder):
    """Ids of whole texts by a byte-level tokenizer, which keeps white space.

    Texts are cut where no token can cross, so a unit is a word with the blank before it or its
    punctuation, or more where white space comes in runs. Units are remembered like words.
    """

    marker = b"<|endoftext|>"

    def _split(self, word: bytes) -> None:
        """Punctuation is cut off already."""

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = flat_bytes(texts)
        cuts = _cuts(data, offsets[:-1])
        ends = np.append(cuts, offsets[-1]).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        ids, size = self._look_up(units)
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[np.searchsorted(cuts, offsets)])


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, one value after another, and the places between values."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int32)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


#: By byte: 1 for a letter of ASCII, 2 for punctuation that neither begins a contraction nor ends a special token.
_KIND = np.zeros(256, np.uint8)
_KIND[list(_LETTERS)] = 1
_KIND[list(set(_PUNCTUATION) - set(b"'|"))] = 2


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts, and the places where no token can cross: before a blank or line break that stands alone,
    both neighbours being surely no white space; behind such a line break; between a letter and
    punctuation.

    White space beyond ASCII begins with the bytes C2, E1, E2 or E3; what begins so counts as white space.
    """
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        kind = _KIND[data]
        letter = kind[:-1] == 1
        letter[1:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        cut[1:] = letter & (kind[1:] == 2)
        at = np.flatnonzero((data[1:-1] == 32) | (data[1:-1] == 10)) + 1
        before, behind = data[at - 1], data[at + 1]
        alone = (before > 32) & (behind > 32) & ~((behind == 0xC2) | (behind >= 0xE1) & (behind <= 0xE3))
        two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        alone &= (before < 0x80) | ~((two == 0xC2) | (three >= 0xE1) & (three <= 0xE3))
        at = at[alone]
        cut[at] = True
        cut[at[data[at] == 10] + 1] = True
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


def slices(texts: pa.Array, most: int = _AT_ONCE) -> Iterator[pa.Array]:
    """A column of texts in slices of about `most` bytes, each of whole texts."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


def packed(ids: np.ndarray, size: np.ndarray) -> pa.Array:
    """Each text's ids as the bytes of one binary value."""
    offsets = np.concatenate([[0], np.cumsum(size * ids.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def id_kind(vocabulary: int) -> str:
    """The narrowest little-endian type that holds every id of a vocabulary."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


_ENCODERS: dict[tuple[str, bool, type], WordEncoder] = {}


def encoder(path: str, plain_specials: bool = False, kind: type[WordEncoder] = WordEncoder) -> WordEncoder:
    """One encoder for each worker process, file and kind."""
    key = (path, plain_specials, kind)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(path, plain_specials)
    return _ENCODERS[key]


def ended(ids: np.ndarray, size: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end` after each document, and the documents' sizes with it."""
    full = size + 1
    out = np.full(int(full.sum()), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(full) - 1] = False
    out[keep] = ids
    return out, full
