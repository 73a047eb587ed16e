"""Word shingles of a text, their SimHash fingerprint, and reference fingerprints."""

from __future__ import annotations

import numpy as np

SEED = 42


def shingles(text: bytes, width: int) -> np.ndarray:
    """The 64-bit hashes of a text's shingles, in order: lower-cased A-Z, `width` words each.

    Texts of fewer words are one shingle; texts without words have none.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - width + 1)
    last = ends[-1:] if len(words) < width else ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    return np.fromiter(
        (digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n
    )


def of_hashes(h: np.ndarray) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the hashes; zero of none."""
    n = len(h)
    if not n:
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        count += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def pivots(n: int) -> np.ndarray:
    """Reference fingerprints: rows of a Hadamard matrix, any two of which differ in half their bits."""
    rows = np.array([[bin(i & j).count("1") & 1 for j in range(64)] for i in range(n)], np.uint8)
    return np.packbits(rows, axis=1).view(np.uint64).ravel()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
