"""Elias-Fano sequences in one memory-mapped file, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

#: The format's mark, and bytes of its header.
MAGIC, HEADER = b"EFSEQ001", 64

#: For all bytes of a word at once: every second bit, pair of bits, half byte; the lowest and the highest bit of each byte.
PAIRS, FOURS, BYTES, EACH, HIGHEST = (np.uint64(0x0101010101010101 * x) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))

#: By a byte and a rank from 0: the place of that one in the byte.
PLACE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.int64).ravel()

#: Values of equal high bits that a search looks at one after another before it goes on by halves.
STEPS = 3


def encode(values: np.ndarray, universe: int) -> bytes:
    """A non-decreasing sequence of integers below ``universe``.

    The low bits of each value stand side by side; the high bits in unary: bit (value >> low) + i is set for
    value i.  A directory holds the zeros before every 64-bit word.
    """
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    low = min(56, max(0, (max(1, universe) // max(1, n)).bit_length() - 1))  # read as 8 bytes from any bit
    high = (v >> np.uint64(low)).astype(np.int64)
    bits = n + (max(universe - 1, 0) >> low) + 1
    marks = np.zeros(((bits + 63) // 64 + 1) * 64, np.uint8)
    marks[high + np.arange(n)] = 1
    words = np.packbits(marks, bitorder="little").view("<u8")
    zeros = np.zeros(len(words) + 1, np.int64)
    np.cumsum(64 - np.bitwise_count(words).astype(np.int64), out=zeros[1:])
    # 64 values take ``low`` words; each place among the 64 is written for all groups at once
    groups = (n + 63) // 64
    part = np.zeros(groups * 64, np.uint64)
    part[:n] = v & np.uint64((1 << low) - 1)
    part = part.reshape(groups, 64)
    packed = np.zeros((groups, low + 1), np.uint64)
    for k in range(64 if low else 0):
        word, shift = divmod(k * low, 64)
        packed[:, word] |= part[:, k] << np.uint64(shift)
        if shift + low > 64:
            packed[:, word + 1] |= part[:, k] >> np.uint64(64 - shift)
    packed = np.concatenate((packed[:, :low].astype("<u8").ravel(), np.zeros(1, "<u8"))).view(np.uint8)
    head = np.array([n, low, universe, len(words), len(packed)], "<u8").tobytes()
    return (MAGIC + head).ljust(HEADER, b"\0") + words.astype("<u8").tobytes() + zeros.astype("<i8").tobytes() + packed.tobytes()


class Sequence:
    def __init__(self, data: np.ndarray, at: int = 0):
        """``data``: bytes of a mapped file, in which the sequence begins at ``at``."""
        if data[at : at + 8].tobytes() != MAGIC:
            raise ValueError("not an Elias-Fano sequence")
        self.n, self.low, self.universe, words, packed = map(int, data[at + 8 : at + 48].view("<u8"))
        at += HEADER
        self.words = data[at : at + 8 * words].view("<u8")
        at += 8 * words
        self.zeros = data[at : at + 8 * words + 8].view("<i8")
        at += 8 * words + 8
        # 8 bytes from any byte on
        self.window = np.ndarray((max(packed - 7, 0),), "<u8", data[at : at + packed], strides=(1,))
        self.end = at + packed
        self.mask = np.uint64((1 << self.low) - 1)

    def lows(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low
        return (self.window[at >> 3] >> (at & 7).astype(np.uint64)) & self.mask

    @staticmethod
    def _in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the one number ``rank`` (from 0) in each word: first its byte, by sums over the bytes up to each, all in one word."""
        s = word - ((word >> np.uint64(1)) & PAIRS)
        s = (s & FOURS) + ((s >> np.uint64(2)) & FOURS)
        s = ((s + (s >> np.uint64(4))) & BYTES) * EACH
        rank = rank.astype(np.uint64)
        at = np.bitwise_count(((rank * EACH | HIGHEST) - s) & HIGHEST).astype(np.uint64) << np.uint64(3)
        rank -= (s << np.uint64(8)) >> at & np.uint64(255)
        return at.astype(np.int64) + PLACE[(word >> at & np.uint64(255)) << np.uint64(3) | rank]

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values number ``i``."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        w = np.searchsorted(ones, i, "right") - 1
        place = w * 64 + self._in_word(self.words[w], i - ones[w])
        return ((place - i).astype(np.uint64) << np.uint64(self.low)) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x among distinct values; -1 if x isn't there."""
        out = np.full(len(x), -1, np.int64)
        x = x.astype(np.uint64)
        which = np.flatnonzero(x < np.uint64(max(self.universe, 0))) if self.n else np.zeros(0, np.int64)
        if not len(which):
            return out
        x = x[which]
        high, low = (x >> np.uint64(self.low)).astype(np.int64), x & self.mask
        # values with smaller high bits stand before the zero number high - 1
        i = np.zeros(len(x), np.int64)
        some = high > 0
        i[some] = self._before(high[some] - 1)
        # the ones from there on are the values with the same high bits; as far as the next 64 bits show
        at = i + high
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        bits = self.words[word] >> shift | (self.words[np.minimum(word + 1, len(self.words) - 1)] << (np.uint64(63) - shift)) << np.uint64(1)
        run = np.bitwise_count(bits & ~(bits + np.uint64(1))).astype(np.int64)
        live, step = np.flatnonzero(run), 0
        while len(live) and step < STEPS:  # mostly few values share their high bits
            own, wanted = self.lows(i[live] + step), low[live]
            hit = live[own == wanted]
            out[which[hit]] = i[hit] + step
            step += 1
            live = live[(own < wanted) & (run[live] > step)]
        if not len(live):
            return out
        # the first of the rest whose low bits aren't less, by halves
        start, end = i[live] + step, np.where(run[live] < 63, i[live] + run[live], self._before(high[live]))
        last = end.copy()
        while (open_ := start < end).any():
            middle = (start + end) >> 1
            less = np.zeros(len(live), bool)
            less[open_] = self.lows(middle[open_]) < low[live][open_]
            start, end = np.where(open_ & less, middle + 1, start), np.where(open_ & ~less, middle, end)
        there = np.flatnonzero(start < last)
        there = there[self.lows(start[there]) == low[live[there]]]
        out[which[live[there]]] = start[there]
        return out

    def _before(self, k: np.ndarray) -> np.ndarray:
        """Number of values before the zero number ``k`` of the unary part."""
        w = np.searchsorted(self.zeros, k, "right") - 1
        return w * 64 + self._in_word(~self.words[w], k - self.zeros[w]) - k


def mapped(path: str) -> np.ndarray:
    return np.memmap(path, np.uint8, "r").view(np.ndarray)
