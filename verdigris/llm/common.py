"""Shared plumbing of the training-data operators: tables cut from their lineage, Arrow helpers, and word hashing over whole Arrow batches."""

from __future__ import annotations

import ctypes
import sys
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from verdigris.sources.scratch import Scratch, shared_dir  # noqa: F401

# Executors need no installed copy of this subpackage: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules["verdigris.llm"])

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z lower-cased, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The word hash is two polynomials modulo this prime (a power of two as modulus would let structured words collide), and their bases.
PRIME, BASES = (1 << 31) - 1, (1_389_171_503, 870_331_691)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy of each text; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, most: int = 1 << 18):
    """Row ranges of about `most` bytes each, one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def give_back() -> None:
    """Hand memory that was freed back to the machine, as a worker lives on for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a run of texts: `hash` (uint64), `row` (index of the text), `start` and `end` (bytes in the run)."""

    powers: tuple[np.ndarray, ...] = ()

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, ...]:
        """Powers of each base and of its inverse."""
        if not cls.powers or len(cls.powers[0]) < n:
            made = []
            for base in (*BASES, *(pow(b, -1, PRIME) for b in BASES)):
                out = np.ones(1, np.uint64)
                while len(out) < max(n, 1 << 18):
                    out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
                made.append(out.astype(np.uint32))
            cls.powers = tuple(made)
        return cls.powers

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = True):
        base = int(off[0])
        data = raw[base : int(off[-1])]
        off = off - base
        n = len(data)
        self.off, self.n_rows, self.data = off, len(off) - 1, data
        space = SPACE[data]
        edge = np.zeros(n + 1, bool)  # a word may begin here: after white space, or with its text
        edge[off] = True
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        first = ~space & (before | edge[:n])
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        last = ~space & (after | edge[1:])
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.space = space
        powers = self._powers(n + 1)
        low = (LOWER[data] if lower else data).astype(np.uint64)
        low += np.uint64(1)
        self._totals, self._inverses = [], powers[2:]
        for power in powers[:2]:
            x = low * power[:n]
            x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(x, out=total[1:])
            self._totals.append(total)

    @cached_property
    def hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    @cached_property
    def row(self) -> np.ndarray:
        return np.searchsorted(self.off, self.start, "right") - 1

    @cached_property
    def first(self) -> np.ndarray:
        """Word positions at which each text's words begin."""
        return np.searchsorted(self.start, self.off)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span, wherever it stands."""
        p, out = np.uint64(PRIME), (end - start).astype(np.uint64)
        with np.errstate(over="ignore"):
            out = mix(out)
            for total, inverse in zip(self._totals, self._inverses):
                out = mix(out + (total[end] - total[start]) % p * inverse[start] % p)
        return out

    def per_row(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=total[1:])
        return np.diff(total[self.off])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of k words inside one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            h = self.hash[: n - k + 1].copy()
            for i in range(1, k):
                h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[i : n - k + 1 + i]
            at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
            return mix(h[at]), at


def distinct(keys: np.ndarray, at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, an index of each, how often each occurs, and the place of every key among them.

    Hashes are sorted range by range, about `at_once` of them at a time, which takes little more room than the results.
    """
    top = int(keys.max()).bit_length() if len(keys) else 0
    parts = min(max(len(keys) // at_once, 1).bit_length() - 1, 6, top)
    part_of = (keys >> np.uint64(top - parts)).astype(np.uint8)
    place, found, base = np.empty(len(keys), np.int32), [], 0
    for part in range(1 << parts):
        mine = np.flatnonzero(part_of == part).astype(np.int32)
        order = mine[np.argsort(keys[mine])]
        ranked = keys[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        at = np.flatnonzero(new)
        place[order] = np.cumsum(new, dtype=np.int32) + (base - 1)
        found.append((ranked[at], order[at], np.diff(at, append=len(order)).astype(np.int32)))
        base += len(at)
    return (*(np.concatenate(x) for x in zip(*found)), place)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def list_array(values: np.ndarray, counts) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
