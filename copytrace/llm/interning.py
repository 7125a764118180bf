"""Word n-grams of texts, interned in an open-addressed NumPy table.

All texts of a block lie in one buffer of bytes in which words are joined by
one space, so every n-gram is a slice of it. A slice's key is its XXH64, worked
out for all slices of one length at once. A key's slot is found by linear
probing: slices that meet a free slot claim it, slices that meet their own key
there are compared byte by byte with the slice that claimed it, and all others
go one slot on. An n-gram's bucket (its CRC-32 modulo their number) and its count
are then worked out once a slot, and every occurrence gathers what its slot's
bucket is worth through the slot's number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

# Words interned together; bounds the memory of a table.
BLOCK = 1 << 17
# Longer slices, and groups of fewer, are hashed and compared one by one.
LANE_BYTES, FEW = 256, 32

# Fixed values of the public XXH64 algorithm.
P1, P2, P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
P4, P5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5

# The polynomial of CRC-32.
CRC = 0xEDB88320

# What becomes of each byte: a-z, 0-9 and all bytes beyond ASCII belong to words, A-Z are lower-cased, 0 is no word.
_LETTERS = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _LETTERS[_b] = _b
for _b in range(0x41, 0x5B):
    _LETTERS[_b] = _b + 0x20


@dataclass
class Words:
    """Words of several texts: word i is ``data[begin[i]:begin[i] + size[i]]`` and belongs to ``text[i]``."""

    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    text: np.ndarray


def words(texts: pa.Array) -> Words:
    """Words of all texts (no nulls); ``data`` has a space after each word."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    lower = _LETTERS[raw]
    inside = lower != 0
    # A word begins after a byte of no word, or where a text begins; it ends likewise.
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    at, size = np.flatnonzero(first), np.flatnonzero(last) + 1
    size -= at
    begin = np.cumsum(size + 1) - size - 1
    data = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    letters = lower[inside]
    data[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    return Words(data, begin, size, np.searchsorted(offsets, at, side="right") - 1)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(x: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(x + lane * np.uint64(P2), 31) * np.uint64(P1)


def xxh64(lanes: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """XXH64 (seed 0) of the slices of one length; ``lanes`` has the eight bytes from every place as a number."""
    at, end = begin, begin + length
    if length >= 32:
        state = [np.full(len(begin), s & (1 << 64) - 1, np.uint64) for s in (P1 + P2, P2, 0, -P1)]
        while len(at) and at[0] + 32 <= end[0]:
            state = [_round(s, lanes[at + 8 * i]) for i, s in enumerate(state)]
            at = at + 32
        h = sum((_rotate(s, by) for s, by in zip(state, (1, 7, 12, 18))), np.zeros(len(begin), np.uint64))
        for s in state:
            h = (h ^ _round(np.zeros_like(s), s)) * np.uint64(P1) + np.uint64(P4)
    else:
        h = np.full(len(begin), P5, np.uint64)
    h = h + np.uint64(length)
    left = length % 32
    for _ in range(left // 8):
        h = _rotate(h ^ _round(np.zeros_like(h), lanes[at]), 27) * np.uint64(P1) + np.uint64(P4)
        at = at + 8
    if left & 4:
        h = _rotate(h ^ ((lanes[at] & np.uint64(0xFFFFFFFF)) * np.uint64(P1)), 23) * np.uint64(P2) + np.uint64(P3)
        at = at + 4
    for _ in range(left & 3):
        h = _rotate(h ^ ((lanes[at] & np.uint64(0xFF)) * np.uint64(P5)), 11) * np.uint64(P1)
        at = at + 1
    h = (h ^ (h >> np.uint64(33))) * np.uint64(P2)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(P3)
    return h ^ (h >> np.uint64(32))


def _crc_tables() -> np.ndarray:
    """Remainders of a byte that 0 to 7 more bytes follow."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(CRC), table >> 1).astype(np.uint32)
    tables = [table]
    for _ in range(7):
        tables.append(table[tables[-1] & 0xFF] ^ tables[-1] >> 8)
    return np.array(tables, np.uint64)


_CRC_TABLES = _crc_tables()


def crc32(lanes: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """CRC-32 of the slices of one length, eight bytes at a time."""
    crc, low = np.full(len(begin), 0xFFFFFFFF, np.uint64), np.uint64(0xFF)
    for i in range(0, length - 7, 8):
        x = lanes[begin + i] ^ crc
        crc = _CRC_TABLES[7][x & low]
        for k in range(1, 8):
            crc ^= _CRC_TABLES[7 - k][x >> np.uint64(8 * k) & low]
    for i in range(length & ~7, length):
        crc = _CRC_TABLES[0][(lanes[begin + i] ^ crc) & low] ^ crc >> np.uint64(8)
    return crc ^ np.uint64(0xFFFFFFFF)


class Table:
    """The table of one block: per slot its key, the slice that claimed it, its bucket and its count."""

    def __init__(self, data: np.ndarray, occurrences: int):
        self.data = np.concatenate((data, np.zeros(8, np.uint8)))
        places = len(data) + 1
        self.lanes = np.empty(places, "<u8")
        for i in range(min(8, places)):
            part = np.frombuffer(self.data[i:].tobytes()[: (len(self.data) - i) // 8 * 8], "<u8")
            self.lanes[i::8] = part[: len(self.lanes[i::8])]
        self.slots = 1 << max(4, (2 * occurrences - 1).bit_length())
        self.key = np.zeros(self.slots, np.uint64)
        self.begin = np.zeros(self.slots, np.int64)
        self.length = np.zeros(self.slots, np.int64)  # 0: free
        self.claim = np.zeros(self.slots, np.int64)

    def _keys(self, begin: np.ndarray, length: int) -> np.ndarray:
        if length < LANE_BYTES and len(begin) >= FEW:
            return xxh64(self.lanes, begin, length)
        return np.array([xxhash.xxh64_intdigest(self.data[b : b + length]) for b in begin.tolist()], np.uint64)

    def _equal(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the slices of ``length`` bytes from ``a`` and from ``b`` are equal."""
        if length >= LANE_BYTES:
            data = self.data
            return np.array([bool((data[x : x + length] == data[y : y + length]).all()) for x, y in zip(a.tolist(), b.tolist())], bool)
        if length < 8:
            return ((self.lanes[a] ^ self.lanes[b]) & np.uint64((1 << 8 * length) - 1)) == 0
        same = self.lanes[a + length - 8] == self.lanes[b + length - 8]
        for i in range(0, length - 8, 8):
            same &= self.lanes[a + i] == self.lanes[b + i]
        return same

    def intern(self, begin: np.ndarray, length: int) -> np.ndarray:
        """Slots of the slices of ``length`` bytes at ``begin``."""
        keys = self._keys(begin, length)
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        todo = np.arange(len(begin))
        while len(todo):
            at = slot[todo]
            free = self.length[at] == 0
            wanted = at[free]
            self.claim[wanted] = todo[free]
            winner = self.claim[wanted]  # one of those that meet in a slot
            self.key[wanted], self.begin[wanted], self.length[wanted] = keys[winner], begin[winner], length
            mine = (self.key[at] == keys[todo]) & (self.length[at] == length)
            mine[mine] = self._equal(begin[todo[mine]], self.begin[at[mine]], length)
            todo = todo[~mine]
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)
        return slot

    def settle(self, slot: np.ndarray, buckets: int) -> None:
        """Bucket and count of every slot, given the slots of all occurrences."""
        self.count = np.bincount(slot, minlength=self.slots)
        self.bucket = np.zeros(self.slots, np.int64)
        used = np.flatnonzero(self.length)
        for length, group in same_length(self.length[used]):
            at = used[group]
            if length < LANE_BYTES and len(at) >= FEW:
                found = crc32(self.lanes, self.begin[at], length)
            else:
                found = np.array([zlib.crc32(self.data[b : b + length]) for b in self.begin[at].tolist()], np.uint64)
            self.bucket[at] = found % np.uint64(buckets)


def same_length(length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each length and the places that have it."""
    # Sixteen bits are sorted by radix.
    short = len(length) and length.max() < 1 << 16
    order = np.argsort(length.astype(np.uint16) if short else length, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        if len(group):
            yield int(length[group[0]]), group


def ngrams(found: Words, longest: int, buckets: int) -> Iterator[tuple[Table, np.ndarray, np.ndarray]]:
    """Per block its table, and the slot and the text of every run of 1 to ``longest`` words that begins in it."""
    for low in range(0, len(found.begin), BLOCK):
        high = min(low + BLOCK, len(found.begin))
        reach = slice(low, min(high + longest - 1, len(found.begin)))
        begin, size, text = found.begin[reach], found.size[reach], found.text[reach]
        base, ends = begin[0], begin + size
        starts, lengths, owners = [], [], []
        for n in range(1, longest + 1):
            many = min(high - low, len(begin) - n + 1)
            whole = text[:many] == text[n - 1 : n - 1 + many] if many > 0 else np.zeros(0, bool)
            starts.append(begin[: len(whole)][whole])
            lengths.append(ends[n - 1 : n - 1 + len(whole)][whole] - starts[-1])
            owners.append(text[: len(whole)][whole])
        start, length, owner = map(np.concatenate, (starts, lengths, owners))
        table = Table(found.data[base : ends[-1]], len(start))
        slot = np.empty(len(start), np.int64)
        for size_of, group in same_length(length):
            slot[group] = table.intern(start[group] - base, size_of)
        table.settle(slot, buckets)
        yield table, slot, owner
