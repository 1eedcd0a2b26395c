"""Hashed byte n-gram counts of Arrow string columns, in numpy, for the vector classifiers.

Counts cover whole texts; memory is bounded by BLOCK bytes of text at a time, whatever a text's length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .words import BLOCK

BUCKETS = 4096


def as_is() -> np.ndarray:
    return np.arange(256, dtype=np.uint8)


def letters() -> np.ndarray:
    """Byte table: ASCII letters in lower case, bytes of longer UTF-8 characters as they are, the rest a space."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def _buckets(codes: np.ndarray) -> np.ndarray:
    """Multiplicative hashing of 24-bit codes to BUCKETS."""
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _codes(data: np.ndarray, n: int) -> np.ndarray:
    wide = data.astype(np.uint32)
    code = wide[: len(wide) - n + 1].copy()
    for k in range(1, n):
        code = (code << np.uint32(8)) | wide[k : len(wide) - n + 1 + k]
    return code


def counts_of(data: np.ndarray, offsets: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """float32 n-gram counts by row and bucket of one block of texts; no n-gram crosses a row's end."""
    rows = len(offsets) - 1
    if rows == 1:
        counts = np.zeros(BUCKETS, np.int64)
        for start in range(0, len(data) - n + 1, BLOCK):
            counts += np.bincount(_buckets(_codes(table[data[start : start + BLOCK + n - 1]], n)), minlength=BUCKETS)
        return counts.astype(np.float32)[None]
    if len(data) < n:
        return np.zeros((rows, BUCKETS), np.float32)
    which = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    first = which[: len(data) - n + 1]
    at = (first.astype(np.int64) * BUCKETS + _buckets(_codes(table[data], n)))[first == which[n - 1 :]]
    return np.bincount(at, minlength=rows * BUCKETS).reshape(rows, BUCKETS).astype(np.float32)


#: Vectors of length 1 are kept as whole numbers of this unit, in doubles: their products and sums of products are then exact, so a row's
#: result does not depend on which other rows are worked on with it.
ONE = float(1 << 20)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length ONE and rounded to whole numbers, as doubles; zero rows stay. Components are rounded to 2**-12 first, so that
    lengths are sums of whole numbers."""
    y = np.array(x, np.float64)
    y *= 4096.0
    np.rint(y, out=y)
    length = np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]
    y *= ONE
    y /= np.where(length > 0, length, 1)
    return np.rint(y, out=y)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of the rows of two matrices of unit rows: exact before the one division."""
    return (x @ y.T) / (ONE * ONE)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts)
    x *= idf
    return unit(x)


def idf_of(counts: np.ndarray) -> np.ndarray:
    return (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)


def packed(blocks: Iterator[np.ndarray]) -> pa.Array:
    """Rows of counts as compressed little-endian float32, for a bounded training sample; most counts are 0."""
    return pa.array([zlib.compress(x.astype("<f4").tobytes(), 1) for block in blocks for x in block], pa.binary())


def unpacked(rows: Iterable[bytes], n: int, width: int = BUCKETS) -> np.ndarray:
    out = np.zeros((n, width), np.float32)
    for k, x in enumerate(rows):
        out[k] = np.frombuffer(zlib.decompress(x), "<f4")
    return out
