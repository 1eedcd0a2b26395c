"""Blocks of texts as numpy bytes, and 64-bit hashes of their words, computed without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; only a longer word makes more.
BLOCK = 1 << 20
MOST_ROWS = 512

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_SEED = 20240607


def text_blocks(column: pa.Array, size: int = BLOCK, rows: int = MOST_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of a string column; null counts as empty.

    A block has up to ``size`` bytes and ``rows`` rows, or one longer row.
    """
    if not len(column):
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, row + rows, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[9:14] = True
    table[32] = True
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes words (runs of anything but ASCII white space) of byte blocks; A-Z count as a-z if ``lower``."""

    def __init__(self, lower: bool = True):
        values = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.values = values[lower_table()] if lower else values
        self.space = space_table()
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, BLOCK + 1)
            for name, factor in (("up", _FACTOR), ("down", _INVERSE)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def _hashes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words of ``data``; no word crosses one of the sorted ``bounds``."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        blank = self.space[data]
        first, last = ~blank, ~blank
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        inside = bounds[(bounds > 0) & (bounds < len(data))]
        first[inside] = ~blank[inside]
        last[inside - 1] = ~blank[inside - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)), starts

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of a block, row after row, and the rows' word offsets in them."""
        if len(data) <= 2 * BLOCK:
            hashes, starts = self._hashes(data, offsets)
            return hashes, np.searchsorted(starts, offsets).astype(np.int64)
        pieces, at = [], 0  # one long row: cut at white space
        while at < len(data):
            end = min(at + BLOCK, len(data))
            while end < len(data) and not self.space[data[end]]:
                more = np.flatnonzero(self.space[data[end : end + BLOCK]])
                end = end + int(more[0]) if len(more) else min(end + BLOCK, len(data))
            pieces.append(self._hashes(data[at:end], np.zeros(0, np.int64))[0])
            at = end
        hashes = np.concatenate(pieces)
        return hashes, np.array([0, len(hashes)], np.int64)
