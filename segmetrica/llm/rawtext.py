"""Helpers inside tasks: Arrow string columns as byte arrays, bounded slices, and vectorised span hashes.

The 64-bit span hash is a polynomial over random byte values modulo 2**64 with a mixing step at the end; it is the
same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 * 4 + 1 & 0xFFFFFFFFFFFFFFFF | 5)
_MULT_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_VALUES = stream(256, 71)


def text_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as plain UTF-8 strings, null as empty."""
    return batch.column(column).cast(pa.string()).fill_null("")


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings and the offset of each (one more than strings)."""
    n = len(strings)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + n + 1].astype(np.int64)
    body = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return body, at - at[0]


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts batches between rows so that each part holds about ``limit`` bytes of text; a longer text is a part alone."""
    for batch in batches:
        strings = text_of(batch, column)
        _, at = raw(strings)
        start, n = 0, len(strings)
        while start < n:
            stop = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
            stop = min(n, max(start + 1, stop))
            yield batch.slice(start, stop - start), strings.slice(start, stop - start)
            start = stop


class SpanHasher:
    """Hashes of many byte spans of one buffer at once."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, SLICE_BYTES + SLICE_BYTES // 2)
            self.powers, self.inverse = (
                np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, m, np.uint64))])
                for m in (_MULT, _MULT_INV)
            )

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[data] * self.powers[: len(data)], out=total[1:])
            value = (total[ends] - total[starts]) * self.inverse[starts]
            return mix(value + (ends - starts).astype(np.uint64))


_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes, start and end of every word between ASCII white space, and the first word of each text."""
    low = _UPPER[data]
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | first))
    # a word ends at a gap, or where the next text begins
    stop = gap | first
    after = np.flatnonzero(stop)
    ends = after[np.searchsorted(after, starts, side="right")] if len(starts) else starts
    return low, starts, ends, np.searchsorted(starts, at)
