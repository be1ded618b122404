"""Texts as arrays of code points: what the text operators of this subpackage share."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

N = sys.maxunicode + 1


#: Bytes of text that are worked on at once; arrays over code points take a hundred times as much.
BYTES_AT_ONCE = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of at most BYTES_AT_ONCE bytes of text, so that memory does not follow the length of documents.

    A longer text comes alone.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).cumsum()
        a, done = 0, 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(size, done + BYTES_AT_ONCE, side="right")))
            yield batch.slice(a, z - a)
            a, done = z, int(size[z - 1])


def explode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, one after the other, and the n + 1 offsets of the texts."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.append(0, np.cumsum(length))


def rebuild(points: np.ndarray, offsets: np.ndarray) -> list[str]:
    whole = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def keep(points: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points under the mask, and the texts' offsets among them."""
    return points[mask], np.append(0, np.cumsum(mask))[offsets]


@cache
def categories() -> np.ndarray:
    """First letter of each code point's general category, as a byte."""
    return np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(N)).encode(), np.uint8)


@cache
def is_letter() -> np.ndarray:
    return categories() == ord("L")


@cache
def blocks() -> np.ndarray:
    """Coarse script of each letter: 1 Hangul, 2 Han, 3 kana, 4 Latin, 5 any other letter; 0 otherwise."""
    out = np.zeros(N, np.uint8)
    out[is_letter()] = 5
    for first, last, code in (
        (0x1100, 0x11FF, 1), (0x3130, 0x318F, 1), (0xA960, 0xA97F, 1), (0xAC00, 0xD7FF, 1), (0xFFA0, 0xFFDC, 1),
        (0x2E80, 0x2FDF, 2), (0x3005, 0x3007, 2), (0x3400, 0x4DBF, 2), (0x4E00, 0x9FFF, 2), (0xF900, 0xFAFF, 2), (0x20000, 0x3FFFF, 2),
        (0x3041, 0x30FF, 3), (0x31F0, 0x31FF, 3), (0xFF66, 0xFF9F, 3), (0x0041, 0x024F, 4), (0x1E00, 0x1EFF, 4), (0xFF21, 0xFF5A, 4),
    ):
        span = out[first : last + 1]
        span[span > 0] = code
    return out
