"""Sets of word shingles as sorted 64-bit hashes, and their min-hash signatures, block by block in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import WordHasher, mixed, text_blocks

WIDTH = 5
#: Symbols of a signature and bits of a symbol.
SYMBOLS, BITS = 40, 16


def multipliers(n: int = SYMBOLS, seed: int = 99) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, offsets): each row's distinct shingles, sorted, one row after the other.

    A text with fewer than ``width`` words has its whole word sequence as its one shingle; one without words has none.
    """
    hasher = WordHasher(lower=True)
    place = multipliers(width, seed=5)
    for row, end, data, offsets in text_blocks(column):
        words, bounds = hasher.block(data, offsets)
        counts = np.diff(bounds)
        total = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            total += words[k : k + len(total)] * place[k]
        total = mixed(total)
        sets = []
        for r in range(end - row):
            a, n = int(bounds[r]), int(counts[r])
            if n >= width:
                x = np.sort(total[a : a + n - width + 1])
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                sets.append(x[keep])
            elif n:
                short = np.uint64(n)
                for w in words[a : a + n]:
                    short = mixed(np.array([short]) + w)[0]
                sets.append(np.array([short], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
        sizes = np.array([len(s) for s in sets], np.int64)
        yield row, end, np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])


def signatures(hashes: np.ndarray, offsets: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Rows of SYMBOLS symbols: the low BITS bits of the least product of a row's hashes with each factor.
    Empty rows have zeros."""
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), len(factors)), np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        for k, f in enumerate(factors):
            out[full, k] = (np.minimum.reduceat(hashes * f, offsets[:-1][full]) & np.uint64((1 << BITS) - 1)).astype(np.uint16)
    return out


def prints(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's set: equal for equal sets, and for others by chance of 2**-128."""
    sums = np.zeros((2, len(hashes) + 1), np.uint64)
    np.cumsum(mixed(hashes), out=sums[0, 1:])
    np.cumsum(mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1, 1:])
    return tuple((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums)
