"""Vectorised work on the bytes of text columns, used inside Arrow batches.

Texts stay UTF-8 bytes in one buffer; all that is asked of them here (splitting at ASCII
white space, lower-casing A-Z, hashing runs of bytes) works on bytes as on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

#: Bytes of text that are worked on at once; a longer single text is taken alone.
SLICE_BYTES = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a text column, about SLICE_BYTES each; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word `[^\\x20\\x09-\\x0D]+`, and for each text the index of its first word."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(_WHITE[data], out=inside[1:-1])
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[1:-1][edges]
    last[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def packed(column: pa.Array) -> pa.Array:
    """The texts of a column, each compressed, for a shuffle; null stays null."""
    deflate = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
    column = column.cast(pa.large_binary())
    return pa.array((deflate(x.as_buffer()) if x.is_valid else None for x in column), pa.binary(), size=len(column))


def unpacked(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    inflate = zstandard.ZstdDecompressor().decompress
    texts = [inflate(x.as_buffer()) if x.is_valid else None for x in column]
    return pa.array(texts, pa.large_binary()).cast(pa.large_string())


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of the result depend on all of `x`."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RunHash:
    """64-bit polynomial hashes of any runs of a sequence from its prefix sums.

    Each symbol is first replaced by 64 random bits. `seed` gives independent functions.
    """

    def __init__(self, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.symbols = random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(seed & 1)
        self.base = np.uint64(int(random.integers(1 << 61, 1 << 62)) * 2 + 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) <= n:
            size = max(n + 1, 1 << 16)
            for name, base in (("_up", self.base), ("_down", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self._up, self._down

    def prefix(self, values: np.ndarray) -> np.ndarray:
        up, _ = self._powers(len(values))
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return sums

    def of_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each data[start:end]."""
        return self.of_runs(self.symbols[data], starts, ends)

    def of_runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = self.prefix(values)
        _, down = self._powers(len(values))
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@lru_cache(maxsize=8)
def run_hash(seed: int) -> RunHash:
    return RunHash(seed)
