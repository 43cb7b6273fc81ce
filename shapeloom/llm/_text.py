"""Vectorised word access over Arrow string batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Every word is
hashed from its bytes with one prefix sum over the batch, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = int(_RNG.integers(2**62, 2**63, dtype=np.uint64)) | 1
_CHUNK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        step = step * step % 2**64
        done += take
    return out


_POW = _powers(_ODD, _CHUNK + 1)
_INV = _powers(pow(_ODD, -1, 2**64), _CHUNK + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` bytes of `column` (one row at least)."""
    for rb in batches:
        if not rb.num_rows:
            continue
        _, offs = buffers(rb.column(column))
        at = 0
        while at < rb.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield rb.slice(at, to - at)
            at = to


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n+1 offsets into them."""
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, o, d = col.buffers()
    offs = np.frombuffer(o, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n+1 offsets of each row's words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a row ends before this byte
    edge[offs] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = int(np.searchsorted(ends, base + _CHUNK, "right"))
        if to <= at:  # one word longer than a chunk, summed piece by piece
            total, scale = 0, 1
            for p in range(base, ends[at], _CHUNK):
                piece = _BYTE[data[p : min(p + _CHUNK, ends[at])]]
                total += int(np.add.reduce(piece * _POW[: len(piece)], dtype=np.uint64)) * scale
                scale = scale * int(_POW[_CHUNK]) % 2**64
            out[at] = total % 2**64
            at += 1
            continue
        part = _BYTE[data[base : ends[to - 1]]]
        part *= _POW[: len(part)]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        s = starts[at:to] - base
        out[at:to] = (sums[ends[at:to] - base] - sums[s]) * _INV[s]
        at = to
    return mix(out)


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a column, row offsets into them, their byte starts and ends, and the bytes."""
    data, offs = buffers(col)
    starts, ends, rows = spans(data, offs)
    return _span_hashes(data, starts, ends), rows, starts, ends, data


def counts(col: pa.Array) -> np.ndarray:
    """The number of words of each row."""
    data, offs = buffers(col)
    return np.diff(spans(data, offs)[2])


def rows_of(offs: np.ndarray) -> np.ndarray:
    """The row of each element, from n+1 offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))
