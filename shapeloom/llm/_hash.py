"""Vectorised hash tables over 64-bit keys, built by tasks from tables in the shared folder."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _store, _text


class HashTable:
    """Open addressing with linear probing; `values` are arrays in the order of the slots."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray, room: float = 2.0):
        size = 2
        while size < room * len(keys):
            size *= 2
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, np.uint64)
        self.full = np.zeros(size, bool)
        self.values = [np.zeros(size, v.dtype) for v in values]
        left, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            free = np.flatnonzero(~self.full[at])
            slot, pick = np.unique(at[free], return_index=True)
            won = free[pick]
            self.full[slot], self.keys[slot] = True, keys[left[won]]
            for have, v in zip(self.values, values, strict=True):
                have[slot] = v[left[won]]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], at[stay]
            at = (at + 1) & int(self.mask)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 where there is none."""
        at = (keys & self.mask).astype(np.int64)
        out = np.where(self.full[at] & (self.keys[at] == keys), at, -1)
        left = np.flatnonzero((out < 0) & self.full[at])
        at = at[left]
        while len(left):
            at = (at + 1) & int(self.mask)
            hit = self.full[at] & (self.keys[at] == keys[left])
            out[left[hit]] = at[hit]
            go = self.full[at] & ~hit
            left, at = left[go], at[go]
        return out


_held: dict[str, object] = {}
_owner = ""


def only(owner: str) -> None:
    """Lets go of what this worker process keeps for other owners."""
    global _owner
    if owner != _owner:
        _held.clear()
        _owner = owner
        pa.default_memory_pool().release_unused()


def resident(owner: str, key: str, make):
    """make(), kept by this worker process until another owner needs its memory."""
    only(owner)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def load(owner: str, uri: str, key: str, *values: str) -> HashTable:
    """A hash table of a Parquet folder in the shared folder, resident for its owner."""

    def make() -> HashTable:
        import pyarrow.parquet as pq

        fs, path = _store.files(uri)
        t = pq.read_table(path, columns=[key, *values], filesystem=fs)
        return HashTable(t[key].to_numpy().view(np.uint64), *(t[v].to_numpy() for v in values), room=1.5)

    return resident(owner, uri, make)


class Bloom:
    """A filter of 64-bit keys: 32 bits a key, but 2**25 bits at least and 2**28 at most, three probes.

    Its size is bounded whatever the number of keys, so that tasks may hold it; with very many keys more
    false ones pass, which cost work and change no result. It is put together on executors in blocks of
    PAGE bytes, and 2**28 / 8 / PAGE blocks at most reach the driver.
    """

    PAGE = 1 << 15

    def __init__(self, keys: DataFrame, column: str):
        n = keys.select(column).distinct().count()
        self.bits = bits = min(28, max(25, math.ceil(math.log2(max(1, n) * 32))))
        self.field = np.zeros(2**bits // 8, np.uint8)
        page = self.PAGE

        def run(batches):
            for rb in batches:
                k = rb.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.unique(np.concatenate([probe(k, shift, bits) for shift in SHIFTS]))
                yield pa.RecordBatch.from_arrays([pa.array(at // (8 * page)), pa.array(at % (8 * page))], names=["page", "bit"])

        def block(table: pa.Table) -> pa.Table:
            flags = np.zeros(8 * page, np.uint8)
            flags[table["bit"].to_numpy()] = 1
            return pa.table({"page": table["page"].slice(0, 1), "bytes": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

        marked = keys.select(column).mapInArrow(run, "page long, bit long").distinct()
        for r in marked.groupBy("page").applyInArrow(block, "page long, bytes binary").collect():
            at = r["page"] * page
            self.field[at : at + page] = np.frombuffer(r["bytes"], np.uint8)

    def has(self, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k), bool)
        out[self.find(k)] = True
        return out

    def find(self, k: np.ndarray) -> np.ndarray:
        """Places of the keys that are in the filter; a probe looks only at those that passed the ones before."""
        at = None
        for shift in SHIFTS:
            p = probe(k if at is None else k[at], shift, self.bits)
            hit = np.flatnonzero(self.field.take(p >> 3) >> (p & 7).astype(np.uint8) & np.uint8(1))
            at = hit if at is None else at[hit]
        return at


SHIFTS = (7, 19, 31)


def probe(k: np.ndarray, shift: int, bits: int) -> np.ndarray:
    """The bit of each key that a probe looks at."""
    return ((k * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(shift)) & np.uint64(2**bits - 1)).astype(np.int64)
