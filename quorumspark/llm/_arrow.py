"""Whole Arrow string columns as numpy arrays: bytes, words and windows of many texts at once.

Everything here works on one slice of a batch (about SLICE bytes; a longer text stands alone), so
a task's memory follows the longest text and not the batch or the partition.
"""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20
#: The white space that ends a word (bytes 09-0D and 20).
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {}


def mix(x, salt=0):
    """A 64-bit finaliser: well spread values from any 64-bit ones."""
    x = (x + np.uint64(salt & (2**64 - 1))).astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n, base=_BASE):
    """base**i and its inverse modulo 2**64 for i < n (kept for the next call)."""
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n + n // 8 + 16, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = both
    return _powers[base]


def give_back() -> None:
    """Hand freed memory back to the system: workers that wait for their next task share an executor's memory with those at work."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """`run`, a function for mapInArrow, with give_back() at the end of each task."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(run):
    """`run`, a function for applyInArrow, with give_back() after each group."""

    def tidied(key, table):
        try:
            return run(key, table)
        finally:
            give_back()

    return tidied


def raw(column):
    """The bytes of a string or binary column and int64 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column, limit=SLICE):
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows with about `limit` bytes."""
    data, offsets = raw(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix(data):
    """Running sums of value[i] * base**i, from which the hash of any substring follows."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * p[: len(data)], out=out[1:])
    return out


def between(sums, start, stop, base=_BASE):
    """Hashes of the ranges [start, stop) of what `sums` runs over."""
    return (sums[stop] - sums[start]) * powers(len(sums), base)[1][start]


class Words:
    """Words of a slice: byte starts and ends, `first` (index of each text's first word, one more at the end), 64-bit hashes."""

    def __init__(self, data, offsets, sums=None):
        solid = np.zeros(len(data) + 1, bool)
        np.logical_not(SPACE[data], out=solid[:-1])
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | edge[1:]
        stop = np.zeros(len(data) + 1, bool)
        stop[1:] = solid[:-1] & (~solid[1:] | edge[1:])
        self.start, self.stop = np.flatnonzero(start), np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, offsets)
        self.sums = prefix(data) if sums is None else sums
        self.hash = mix(between(self.sums, self.start, self.stop), 1) + (self.stop - self.start).astype(np.uint64)
        self._run = None

    @property
    def counts(self):
        return np.diff(self.first)

    def run(self, base=0xD6E8FEB86659FD93):
        p, _ = powers(len(self.hash) + 1, base)
        out = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * p[: len(self.hash)], out=out[1:])
        return out

    def windows(self, k, base=0xD6E8FEB86659FD93):
        """Hashes of all runs of k words inside a text (a shorter text with words is one run), their first word and their number per text."""
        n = self.counts
        each = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
        begin = np.repeat(self.first[:-1] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
        end = np.minimum(begin + k, np.repeat(self.first[1:], each))
        return mix(between(self.run(base), begin, end, base), k) + (end - begin).astype(np.uint64), begin, each

    def keys(self):
        """Two 64-bit hashes of each text's whole sequence of words."""
        return [mix(between(self.run(b), self.first[:-1], self.first[1:], b), 7) ^ self.counts.astype(np.uint64) for b in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def blobs(values, stops):
    """A binary column from a flat array cut at `stops` (in elements, without the leading 0)."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * int(np.prod(values.shape[1:], initial=1))
    offsets = np.concatenate(([0], np.asarray(stops, np.int64))) * width
    kind, off = (pa.large_binary(), np.int64) if offsets[-1] >= 2**31 else (pa.binary(), np.int32)
    out = pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(off).tobytes()), pa.py_buffer(values.tobytes())])
    return out.cast(pa.binary()) if kind != pa.binary() else out


def joined(column, dtype):
    """All values of a binary column, end to end."""
    data, offsets = raw(column)
    return data[offsets[0] : offsets[-1]].view(dtype) if offsets[-1] > offsets[0] else np.zeros(0, dtype)


def runs(sorted_values):
    """Starts of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1))


def signed(x):
    return pa.array(np.ascontiguousarray(x).view(np.int64))
