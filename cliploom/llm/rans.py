"""Static range asymmetric numeral system over many interleaved lanes, in numpy.

Ids are cut into segments of LANES * STEPS; every segment is coded on its own by LANES interleaved
states with one shared frequency table. A segment's first states and its offset among the words are
its checkpoint: any segment can be decoded without the others, and all of them at once as one matrix.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS = 256, 256
SEGMENT = LANES * STEPS
BITS = 20
_LOW = np.uint64(1 << 31)
_MAGIC = b"RANS1\0\0\0"


def frequencies(count: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**BITS; every id that occurs keeps at least one slot."""
    count = np.asarray(count, np.float64)
    total, room = count.sum(), 1 << BITS
    if not total:
        return np.zeros(len(count), np.uint32)
    freq = np.where(count > 0, np.maximum(1, np.floor(count / total * room)), 0).astype(np.int64)
    off = room - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    while off:
        some = order[: max(1, min(int((freq > 1).sum()), abs(off)))]
        if off > 0:
            freq[some[:off]] += 1
        else:
            freq[some] -= freq[some] > 1
        off = room - int(freq.sum())
    return freq.astype(np.uint32)


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.first = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        """A block: header, checkpoints (offset, checksum and states of each segment), words, checksum."""
        n = len(ids)
        segments = -(-n // SEGMENT)
        full = np.zeros(segments * SEGMENT, np.int64)
        full[:n] = ids
        used = (np.arange(segments * SEGMENT) < n).reshape(segments, STEPS, LANES)
        grid = full.reshape(segments, STEPS, LANES)
        x = np.full((segments, LANES), _LOW, np.uint64)
        words, owner = [], []
        for t in range(STEPS - 1, -1, -1):
            on = used[:, t]
            f, c = self.freq[grid[:, t]], self.first[grid[:, t]]
            f = np.where(on, f, np.uint64(1))
            out = on & (x >= f << np.uint64(63 - BITS))
            words.append((x[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            owner.append(np.nonzero(out)[0])
            x = np.where(out, x >> np.uint64(32), x)
            x = np.where(on, ((x // f) << np.uint64(BITS)) + x % f + c, x)
        who = np.concatenate(owner[::-1]) if owner else np.zeros(0, int)
        flat = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        flat = flat[np.argsort(who, kind="stable")]
        many = np.bincount(who, minlength=segments)
        check = [zlib.crc32(ids[i * SEGMENT : (i + 1) * SEGMENT].astype("<u4").tobytes()) for i in range(segments)]
        body = b"".join(
            [
                _MAGIC,
                struct.pack("<QII", n, segments, len(flat)),
                many.astype("<u4").tobytes(),
                np.array(check, "<u4").tobytes(),
                x.astype("<u8").tobytes(),
                flat.astype("<u4").tobytes(),
            ]
        )
        return body + struct.pack("<I", zlib.crc32(body))

    def decode(self, block: bytes, only: slice = slice(None)) -> np.ndarray:
        """The ids of a block, or of some of its segments; ValueError where a checksum is wrong."""
        if block[:8] != _MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("block is damaged")
        n, segments, size = struct.unpack_from("<QII", block, 8)
        at = 24
        many = np.frombuffer(block, "<u4", segments, at).astype(np.int64)
        check = np.frombuffer(block, "<u4", segments, at + 4 * segments)[only]
        x = np.frombuffer(block, "<u8", segments * LANES, at + 8 * segments).reshape(segments, LANES)[only].copy()
        words = np.frombuffer(block, "<u4", size, at + 8 * segments + 8 * segments * LANES).astype(np.uint64)
        words = np.append(words, np.uint64(0))
        ptr = (np.cumsum(many) - many)[only]
        length = np.minimum(n - np.arange(segments) * SEGMENT, SEGMENT)[only]
        out = np.zeros((len(x), STEPS, LANES), np.uint32)
        steps = -(-int(length.max()) // LANES) if len(x) else 0
        mask = np.uint64((1 << BITS) - 1)
        lane = np.arange(LANES)
        for t in range(steps):
            on = t * LANES + lane < length[:, None]
            slot = x & mask
            s = self.symbol[slot]
            y = self.freq[s] * (x >> np.uint64(BITS)) + slot - self.first[s]
            x = np.where(on, y, x)
            need = on & (x < _LOW)
            place = ptr[:, None] + np.cumsum(need, axis=1) - 1
            x = np.where(need, (x << np.uint64(32)) | words[np.where(need, place, len(words) - 1)], x)
            ptr = ptr + need.sum(axis=1)
            out[:, t] = s
        rows = [r.ravel()[:k] for r, k in zip(out, length, strict=True)]
        for row, crc in zip(rows, check, strict=True):
            if zlib.crc32(row.astype("<u4").tobytes()) != crc:
                raise ValueError("segment is damaged")
        return np.concatenate(rows) if rows else np.zeros(0, np.uint32)
