"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes. Up to 24 bytes fit into three integers, which are compared and hashed for all
words of a batch together; longer words are rare and go through Python objects.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WIDE = 24
#: Bytes of the texts that are worked on at once; a longer text is worked on alone.
SLAB = 1_500_000
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def byte_table(spaces: bytes, lower: bool = False) -> bytes:
    """For ``bytes.translate``: ``spaces`` become U+0020; with ``lower``, A-Z become a-z."""
    return bytes(32 if b in spaces else b + 32 if lower and 65 <= b <= 90 else b for b in range(256))


def slabs(column: pa.Array):
    """(first row, bytes, bounds) of the texts of a column, null as empty, in parts of about SLAB bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = memoryview(data) if data is not None else memoryview(b"")
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLAB, "right")) - 1)
        last = min(last, n)
        yield first, bytes(data[bounds[first] : bounds[last]]), bounds[first : last + 1] - bounds[first]
        first = last


def padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(WIDE), np.uint8)


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes inside each text, and the first run of each text (one more at the end)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    starts, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    starts[0], ends[n] = inside[0], inside[-1]
    np.greater(inside[1:], inside[:-1], out=starts[1:n])
    np.greater(inside[:-1], inside[1:], out=ends[1:n])
    inner = bounds[(bounds > 0) & (bounds < n)]
    starts[inner], ends[inner] = inside[inner], inside[inner - 1]
    a = np.flatnonzero(starts)
    return a, np.flatnonzero(ends), np.searchsorted(a, bounds)


class Keys:
    """The words data[starts:ends] as integers: ``a, b, c`` (up to 24 bytes), ``size`` and a 64-bit ``hash``.

    Words of up to 24 bytes are equal when these integers are; of longer ones, ``a`` is a second hash.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        self.size = size = (ends - starts).astype(np.uint64)
        short = np.minimum(ends - starts, WIDE)
        self.a = eight[starts] & _MASK[np.minimum(short, 8)]
        self.b, self.c = np.zeros_like(self.a), np.zeros_like(self.a)
        more = np.flatnonzero(short > 8)
        self.b[more] = eight[starts[more] + 8] & _MASK[np.minimum(short[more] - 8, 8)]
        more = more[short[more] > 16]
        self.c[more] = eight[starts[more] + 16] & _MASK[short[more] - 16]
        h = self.a ^ size * _K[0]
        h *= _K[1]
        h ^= h >> np.uint64(32)
        h ^= self.b
        h *= _K[2]
        h ^= h >> np.uint64(29)
        h ^= self.c
        h *= _K[3]
        h ^= h >> np.uint64(32)
        self.hash = h
        self.long = np.flatnonzero(ends - starts > WIDE)
        for i in self.long.tolist():
            word = data[starts[i] : ends[i]].tobytes()
            h[i], self.a[i] = xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(word, seed=1)

    def rows(self) -> np.ndarray:
        return np.stack([self.a, self.b, self.c, self.size], axis=1)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the first four columns differ."""
    d = x[:, 0] ^ y[:, 0]
    for k in range(1, 4):
        d |= x[:, k] ^ y[:, k]
    return d != 0


class Table:
    """Numbers of words, from 0 in the order in which they are first seen; a hash table in one numpy array.

    ``learn(data, starts, ends)`` is called with new words, in order, before their numbers are returned.
    With ``limit``, ``full`` says that there are more words than that; ``keep`` forgets all but some.
    """

    def __init__(self, learn: Callable | None, limit: int = 1 << 62) -> None:
        self.learn, self.limit, self.count = learn, limit, 0
        self.slots = np.zeros((1 << 12, 5), np.uint64)  # a, b, c, size, number + 1 (0: empty)

    @property
    def full(self) -> bool:
        return self.count > self.limit

    def _find(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if there is none."""
        mask = np.int64(len(self.slots) - 1)
        at = (hashes & np.uint64(mask)).astype(np.int64)
        found = self.slots.take(at, axis=0)
        out = found[:, 4].astype(np.int64) - 1
        left = np.flatnonzero(_differ(found, rows) & (out >= 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            found = self.slots.take(at[left], axis=0)
            out[left] = found[:, 4].astype(np.int64) - 1
            left = left[_differ(found, rows[left]) & (out[left] >= 0)]
        return out

    def _put(self, rows: np.ndarray, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Adds words that aren't there and differ from each other."""
        mask = np.int64(len(self.slots) - 1)
        at, left = (hashes & np.uint64(mask)).astype(np.int64), np.arange(len(rows))
        while len(left):
            free = left[self.slots[at[left], 4] == 0]
            _, one = np.unique(at[free], return_index=True)
            now = free[one]
            self.slots[at[now], :4], self.slots[at[now], 4] = rows[now], numbers[now].astype(np.uint64) + np.uint64(1)
            done = np.zeros(len(rows), bool)
            done[now] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & mask

    def _grow(self, count: int) -> None:
        if 2 * count <= len(self.slots):
            return
        old = self.slots[self.slots[:, 4] > 0]
        self.slots = np.zeros((1 << (2 * count).bit_length(), 5), np.uint64)
        self._put(old[:, :4], self._hash(old), old[:, 4].astype(np.int64) - 1)

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = rows[:, 0] ^ rows[:, 3] * _K[0]
        h = h * _K[1]
        h ^= h >> np.uint64(32)
        h = (h ^ rows[:, 1]) * _K[2]
        h ^= h >> np.uint64(29)
        h = (h ^ rows[:, 2]) * _K[3]
        return h ^ (h >> np.uint64(32))

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, add: bool = True) -> np.ndarray:
        """Number of each word; without ``add``, -1 for words that aren't known."""
        keys = Keys(data, starts, ends)
        rows = keys.rows()
        if len(keys.long):  # their place in the table comes from their integers, as for the others
            keys.hash[keys.long] = self._hash(rows[keys.long])
        out = self._find(rows, keys.hash)
        new = np.flatnonzero(out < 0)
        if not add or not len(new):
            return out
        order = new[np.argsort(keys.hash[new], kind="stable")]
        group, h = rows[order], keys.hash[order]
        other = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1])]))
        if _differ(group[1:], group[:-1]).sum() != len(other) - 1:  # words of one hash that differ
            order = new[np.lexsort((new, *rows[new].T, keys.hash[new]))]
            group = rows[order]
            other = np.flatnonzero(np.concatenate([[True], _differ(group[1:], group[:-1])]))
        first = order[other]  # of each new word: the first place, as places of a word are in order
        rank = np.empty(len(first), np.int64)
        by_place = np.argsort(first)
        rank[by_place] = np.arange(len(first))
        out[order] = self.count + np.repeat(rank, np.diff(np.append(other, len(order))))
        first = first[by_place]
        if self.learn is not None:
            self.learn(data, starts[first], ends[first])
        self._grow(self.count + len(first))
        self._put(rows[first], keys.hash[first], self.count + np.arange(len(first)))
        self.count += len(first)
        return out

    def keep(self, numbers: np.ndarray) -> None:
        """Forgets all words but these (sorted numbers), which are numbered anew in this order."""
        new = np.full(self.count, -1, np.int64)
        new[numbers] = np.arange(len(numbers))
        old = self.slots[self.slots[:, 4] > 0]
        number = new[old[:, 4].astype(np.int64) - 1]
        old, number = old[number >= 0], number[number >= 0]
        self.count = len(numbers)
        self.slots = np.zeros((max(1 << 12, 1 << (2 * self.count).bit_length()), 5), np.uint64)
        self._put(old[:, :4], self._hash(old), number)
