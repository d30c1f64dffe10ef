"""Pieces of many texts at once: where they begin and end, their 64-bit hashes, and ids kept by hash.

A piece's hash is a polynomial of random 64-bit values of its letters, taken as the difference of two running sums, so
no piece becomes a Python string unless it is met for the first time. Two different pieces of at most LONG letters have
one hash with a probability near 2^-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code that stands between texts, beyond all letters.
BORDER = 0x110000
#: Longest piece whose ids are kept.
LONG = 64
_BASE = 0x9E3779B97F4A7C13
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def letter_values() -> np.ndarray:
    """A random 64-bit value of every code."""
    x = np.arange(BORDER + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0 .. n - 1."""
    if len(_powers[0]) < n:
        size = max(n, min(2 * len(_powers[0]), 1 << 20))
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts, a border after each, as one string and as codes; and where each text begins."""
    whole = "\x00".join([*texts, ""])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    codes[begins[1:] - 1] = BORDER
    return whole, codes, begins


def hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the pieces [begin, end) of letters with these values. Also right for pieces of one position in
    arrays of any length, but two powers a position are kept: callers pass a few million letters at most."""
    up, down = powers(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[end] - sums[begin]) * down[begin]


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the stretches that begin there and have these sizes, one after the other."""
    out = np.repeat(begin - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


class Kept:
    """Lists of 16-bit ids by 64-bit key, in flat arrays: an open-addressed table, and the lists one after the other.
    When more than `most` are held, those not used twice since the last time go."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.bits, self.count, self.size = 12, 0, 0
        self.keys, self.rows = np.zeros(1 << 12, np.uint64), np.full(1 << 12, -1, np.int32)
        self.key, self.begin, self.length, self.used = (np.zeros(1 << 11, t) for t in (np.uint64, np.int64, np.int32, np.int32))
        self.flat = np.zeros(1 << 13, np.uint16)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not held."""
        slot = self._slot(key)
        out = self.rows[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != key))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.rows[slot[left]]
            left = left[(out[left] >= 0) & (self.keys[slot[left]] != key[left])]
        return out

    def _enter(self, key: np.ndarray, row: np.ndarray) -> None:
        slot = self._slot(key)
        left = np.arange(len(key))
        while len(left):
            free = left[self.rows[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.rows[slot[put]] = key[put], row[put]
            left = left[self.rows[slot[left]] != row[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _rehash(self, bits: int) -> None:
        self.bits = bits
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self._enter(self.key[: self.count], np.arange(self.count, dtype=np.int32))

    def add(self, key: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Keep the lists of these lengths in ids by these keys, which must be different and new."""
        n, size = self.count + len(key), self.size + len(ids)
        while n > len(self.key):
            for name in ("key", "begin", "length", "used"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        if size > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.size], np.zeros(max(size, 2 * self.size) - self.size, np.uint16)])
        at = slice(self.count, n)
        self.key[at], self.length[at], self.used[at] = key, length, 0
        self.begin[at] = self.size + np.cumsum(length) - length
        self.flat[self.size : size] = ids
        self.count, self.size = n, size
        if 2 * n > len(self.rows):
            self._rehash(max(13, (2 * n).bit_length()))
        else:
            self._enter(key, np.arange(n - len(key), n, dtype=np.int32))

    def note(self, rows: np.ndarray) -> None:
        """Count uses of rows."""
        self.used[: self.count] += np.bincount(rows, minlength=self.count).astype(np.int32)

    def prune(self) -> None:
        """Drop what was not used twice, if too much is held; rows get new numbers."""
        if self.count <= self.most:
            return
        keep = np.flatnonzero(self.used[: self.count] > 1)
        if len(keep) > self.most // 2:
            keep = keep[np.argsort(-self.used[keep], kind="stable")[: self.most // 2]]
        key, length, used = self.key[keep], self.length[keep], self.used[keep]
        ids = self.flat[spans(self.begin[keep], length)]
        self.clear()
        self.add(key, ids, length)
        self.used[: self.count] = used // 2


def stretches(texts: list[str], letters: int, breaks) -> Iterator[list[tuple[int, str]]]:
    """Consecutive (number of text, stretch of it), about so many letters at a time. A longer text comes in stretches
    that begin where breaks (a compiled pattern) next matches, so that no piece is cut."""
    some: list[tuple[int, str]] = []
    size = 0
    for k, t in enumerate(texts):
        at = 0
        while True:
            end = len(t)
            if end - at > letters:
                found = breaks.search(t, at + letters)
                end = found.start() if found else end
            part = t[at:end] if at or end < len(t) else t
            some.append((k, part))
            size += len(part)
            at = end
            if size >= letters:
                yield some
                some, size = [], 0
            if at >= len(t):
                break
    if some:
        yield some
