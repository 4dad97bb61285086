"""Word hashes of whole batches at once, straight from Arrow's text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix

_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_FOLDED = _BYTES.copy()
_FOLDED[0x41:0x5B] = _BYTES[0x61:0x7B]
#: Bytes to their sign in a word's shape: A, a (bytes of other letters too), 0, or the byte itself.
_SHAPE = np.array([0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256)], np.uint8)
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


class _Powers:
    """Powers of an odd number modulo 2**64, made as far as they are needed."""

    def __init__(self, base: int):
        self.base, self.have = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.have) < n:
            self.have = np.concatenate([self.have, self.have * np.uint64(pow(self.base, len(self.have), 2**64))])
        return self.have[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def slices(batch: pa.RecordBatch, text: str = "text", most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most_bytes` of text, or single longer rows."""
    sizes = np.cumsum(np.diff(_offsets(batch.column(text))))
    at = 0
    while at < batch.num_rows:
        used = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, used + most_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _offsets(column: pa.Array) -> np.ndarray:
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)


def word_hashes(column: pa.Array, lower: bool = True, shapes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all rows, where each row's words begin and end in them).

    Words lie between ASCII blanks, A-Z lower-cased if asked; null rows have none. With `shapes`, hashes are of the words'
    shapes: upper-case, lower-case and digit bytes count as one sign each, other marks as themselves, and runs of a sign as
    one, so of%%% and that*** are a% and a*. The hash is a polynomial in the word's bytes (by table, modulo 2**64) from
    differences of one running sum, then mixed.
    """
    column = column.fill_null("") if column.null_count else column
    offsets = _offsets(column)
    rows = offsets - offsets[0]
    if not rows[-1]:
        return np.empty(0, np.uint64), np.zeros(len(rows), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    n = len(data)
    solid = _SOLID[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = rows[(rows > 0) & (rows < n)]
    starts[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    at = np.searchsorted(first, rows)
    if shapes:
        data = _SHAPE[data]
        told = solid.copy()
        told[1:] &= starts[1:] | (data[1:] != data[:-1])
        before = np.concatenate([[0], np.cumsum(told)])
        data, first, last = data[told], before[first], before[last]
        n = len(data)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((_FOLDED if lower else _BYTES)[data] * _UP.upto(n))])
    h = (sums[last] - sums[first]) * _DOWN.upto(max(n, 1))[first]
    return mix(h + (last - first).astype(np.uint64)), at
