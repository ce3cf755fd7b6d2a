"""Vectorised looks at the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: An odd multiplier: powers of it have inverses modulo 2**64, so a hash may start anywhere.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: The bytes that part words, and ASCII letters' lower case.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, text: int, most_bytes: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their texts' bytes, where each text ends), a bounded amount of text at a time."""
    column = batch.column(text).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], "i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "i8")
    data = column.buffers()[2]
    data = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1)
        yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start + 1 : stop + 1] - offsets[start]
        start = stop


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, "u8"), np.full(n, INVERSE, "u8")
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 20
    while size < n:
        size *= 2
    up, down = _powers(size)
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of byte times power: the hash of any stretch is a difference of two of them."""
    up, _ = powers(max(1, len(data)))
    out = np.zeros(len(data) + 1, "u8")
    np.cumsum((data.astype("u8") + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, stop), equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype("u8"))


def words(data: np.ndarray, ends: np.ndarray, parts: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words: stretches of other bytes than those that part them (blank and
    the controls 9 to 13), none of which spans two texts."""
    solid = ~parts[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    before[heads] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[heads[heads > 0] - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
