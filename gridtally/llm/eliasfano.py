"""A two-level n-gram trie in Elias-Fano coding, memory-mapped, with vectorised look-ups (Pibiri and Venturini, 2017).

A monotone sequence is split into low bits, stored as they are, and high bits, stored in unary. A directory of set bits per
block answers select; the elements that share a value's high bits are an interval found by two selects on zeros,
and the value is searched among the low bits of that interval.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bits of one block of the select directory.
BLOCK = 64
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_SELECT = np.full((256, 8), 8, dtype=np.uint8)
for _b in range(256):
    for _k, _i in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT[_b, _k] = _i


def _pad(data: bytes, to: int = 8) -> bytes:
    return data + b"\0" * (-len(data) % to)


class EliasFano:
    """A sorted sequence of unsigned integers over a byte buffer."""

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        size = (int(high[-1]) + 1 if n else 0) + 1
        size += -size % BLOCK
        bits = np.zeros(size, dtype=np.uint8)
        bits[high] = 1
        unary = np.packbits(bits, bitorder="little")
        lows = np.zeros((n * low + 63) // 64 + 2, dtype=np.uint64)
        if low and n:
            part = v & np.uint64((1 << low) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(lows, word, part << shift)
            over = shift + np.uint64(low) > np.uint64(64)
            np.bitwise_or.at(lows, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))]).astype(np.uint32)
        head = struct.pack("<5q", n, low, len(unary), len(lows), len(ones))
        return head + _pad(unary.tobytes()) + lows.tobytes() + _pad(ones.tobytes())

    def __init__(self, buffer: np.ndarray, at: int = 0):
        self.n, self.low, u, w, o = struct.unpack("<5q", buffer[at : at + 40].tobytes())
        at += 40
        self.unary = buffer[at : at + u]
        at += u + -u % 8
        self.lows = buffer[at : at + 8 * w].view(np.uint64)
        at += 8 * w
        self.ones = buffer[at : at + 4 * o].view(np.uint32)
        self.zeros = (np.arange(o) * BLOCK - self.ones).astype(np.uint32)
        self.end = at + 4 * o + -(4 * o) % 8

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Positions of the k-th (from 0) set or unset bits."""
        directory = self.ones if ones else self.zeros
        block = np.searchsorted(directory, k.astype(np.uint32), side="right") - 1
        rest = k - directory[block].astype(np.int64)
        out = np.empty(len(k), dtype=np.int64)
        last = len(self.unary) // (BLOCK // 8) - 1
        block = np.minimum(block, last)
        width = BLOCK // 8
        for a in range(0, len(k), 65_536):
            s = slice(a, a + 65_536)
            raw = self.unary[block[s, None] * width + np.arange(width)]
            raw = raw if ones else ~raw
            total = np.cumsum(_ONES[raw], axis=1, dtype=np.int64)
            byte = (total <= rest[s, None]).sum(axis=1)
            i = np.arange(len(byte))
            before = np.where(byte > 0, total[i, byte - 1], 0)
            out[s] = block[s] * BLOCK + byte * 8 + _SELECT[raw[i, byte], rest[s] - before]
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        above = np.where(shift > 0, self.lows[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.lows[word] >> shift) | above) & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at the given places."""
        high = self._select(i, True) - i
        return (high.astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def _search(self, values: np.ndarray, first: np.ndarray | None, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first element not below each value within its range, and whether it equals the value."""
        v = values.astype(np.uint64)
        high = (v >> np.uint64(self.low)).astype(np.int64)
        have = int(self.zeros[-1])
        beyond = high >= have
        high = np.minimum(high, max(have - 1, 0))
        before = self._select(np.maximum(high - 1, 0), False)
        lo = np.where(high > 0, before - high + 1, 0)
        hi = self._select(high, False) - high
        lo, hi = np.where(beyond, self.n, np.minimum(lo, self.n)), np.where(beyond, self.n, np.minimum(hi, self.n))
        if first is not None:
            lo, hi = np.clip(lo, first, last), np.clip(hi, first, last)
        end = hi.copy()
        want = v & np.uint64((1 << self.low) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        equal = np.zeros(len(v), dtype=bool)
        inside = np.flatnonzero(lo < end)
        equal[inside] = self._low(lo[inside]) == want[inside]
        return lo, equal

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Place of the first element not below each value."""
        return self._search(values, None, None)[0]

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, searched within [first, last) where given; -1 where it is not there."""
        place, equal = self._search(values, first, last)
        return np.where(equal, place, -1)


class Trie:
    """Contexts, pointers to their successors, successors, and one byte of quantised log10 value per node.

    Successors are stored as one monotone sequence by adding the context's place times the number of word ids; a search is
    confined to the context's range, given by two neighbouring pointers.
    """

    @staticmethod
    def encode(context: np.ndarray, word: np.ndarray, value: np.ndarray, backoff: np.ndarray, floor: float) -> bytes:
        """From pairs sorted by (context, word), log10 probabilities of the pairs and back-off weights of the distinct contexts."""
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        ids = int(word.max()) + 1 if len(word) else 1
        place = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(context))))
        parts = [
            struct.pack("<qd", ids, floor), EliasFano.encode(context[start]), EliasFano.encode(np.append(start, len(context))),
            EliasFano.encode(place.astype(np.uint64) * np.uint64(ids) + word.astype(np.uint64)),
            _pad(quantise(backoff, floor).tobytes()), _pad(quantise(value, floor).tobytes()),
        ]
        return b"".join(parts)

    def __init__(self, buffer: np.ndarray):
        self.ids, self.floor = struct.unpack("<qd", buffer[:16].tobytes())
        self.contexts = EliasFano(buffer, 16)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.words = EliasFano(buffer, self.pointers.end)
        at = self.words.end
        self.backoff = buffer[at : at + self.contexts.n]
        at += self.contexts.n + -self.contexts.n % 8
        self.value = buffer[at : at + self.words.n]

    def log10(self, context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 probability of each word after its context; ``lower`` is that of the word without context."""
        out = lower.astype("float64").copy()
        if not self.contexts.n or not len(out):
            return out
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        place = np.repeat(self.contexts.find(context[start]), np.diff(np.append(start, len(context))))
        known = np.flatnonzero(place >= 0)
        at = place[known]
        out[known] += dequantise(self.backoff[at], self.floor)
        bounds = self.pointers.get(np.arange(self.pointers.n)).astype(np.int64) if len(at) > self.pointers.n else None
        first, last = (bounds[at], bounds[at + 1]) if bounds is not None else (self.pointers.get(p).astype(np.int64) for p in (at, at + 1))
        want = at.astype(np.uint64) * np.uint64(self.ids) + word[known].astype(np.uint64)
        i = np.where(word[known] < self.ids, self.words.find(want, first, last), -1)
        hit = np.flatnonzero(i >= 0)
        out[known[hit]] = dequantise(self.value[i[hit]], self.floor)
        return out


def quantise(log10: np.ndarray, floor: float) -> np.ndarray:
    """One byte per value, even steps from 0 down to ``floor``."""
    return np.clip(np.rint(log10 / floor * 255), 0, 255).astype(np.uint8)


def dequantise(code: np.ndarray, floor: float) -> np.ndarray:
    return code.astype("float64") * (floor / 255)
