"""Texts of an Arrow batch as arrays of bytes and of characters."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from cliploom.functions.text import char_width


def bytes_of(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one behind another, and where each begins (and the last ends)."""
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and where each begins."""
    at = np.flatnonzero(data & 0xC0 != 0x80)
    head = data[at].astype(np.uint32)
    out = head.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        long = np.flatnonzero(head >= low)  # each pass overwrites what a longer one begins with
        point = head[long] & mask
        for i in range(1, size):
            point = point << 6 | data[np.minimum(at[long] + i, len(data) - 1)] & 0x3F
        out[long] = point
    return out, at


@cache
def _widths() -> np.ndarray:
    return np.fromiter((char_width(chr(p)) for p in range(0x110000)), np.int8, 0x110000)


def widths(points: np.ndarray) -> np.ndarray:
    """char_width() of each code point; the first wide one is U+1100."""
    return np.ones(len(points), np.int8) if points.max(initial=0) < 0x1100 else _widths()[points]


#: Whether a code point is white space to str.strip(); none above U+3000 is.
_SPACE = np.array([chr(p).isspace() for p in range(0x3002)])


def spaces(points: np.ndarray) -> np.ndarray:
    return _SPACE[np.minimum(points, 0x3001)]
