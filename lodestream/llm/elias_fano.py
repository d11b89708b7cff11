"""Elias-Fano coded monotone sequences over numpy arrays, which may be memory-mapped; all queries take arrays."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
ONE = U64(1)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of a fixed number of bits, packed in 64-bit words, with a word to spare."""
    if not bits or not len(values):
        return np.zeros(1, U64)
    out = np.zeros(len(values) * bits // 64 + 2, U64)
    step = 1 << 16  # multiples of 64 values start at whole words
    for first in range(0, len(values), step):
        part = values[first : first + step].astype(U64)
        at = np.arange(first, first + len(part), dtype=np.int64) * bits
        word, off = at >> 6, (at & 63).astype(U64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] |= np.bitwise_or.reduceat(part << off, starts)
        over = np.flatnonzero(off + U64(bits) > U64(64))  # at most one value goes over a word's end
        out[word[over] + 1] |= part[over] >> (U64(64) - off[over])
    return out


def unpack(words: np.ndarray, bits: int, index: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(index), U64)
    at = index.astype(np.int64) * bits
    word, off = at >> 6, (at & 63).astype(U64)
    low = words[word] >> off
    high = (words[word + 1] << (U64(63) - off)) << ONE  # in two steps: a shift by 64 is undefined
    return (low | high) & ((ONE << U64(bits)) - ONE)


def _select_table() -> np.ndarray:
    """[k * 256 + byte]: place of the k-th (from 0) set bit of a byte."""
    table = np.zeros(8 * 256, np.uint8)
    for byte in range(256):
        for k, place in enumerate(i for i in range(8) if byte >> i & 1):
            table[k * 256 + byte] = place
    return table


SELECT = _select_table()
EACH_BYTE, TOP_BITS = U64(0x0101010101010101), U64(0x8080808080808080)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word: its byte by the bytes' running sums, then by table."""
    k = k.astype(U64)
    pairs = word - ((word >> ONE) & U64(0x5555555555555555))
    nibbles = (pairs & U64(0x3333333333333333)) + ((pairs >> U64(2)) & U64(0x3333333333333333))
    sums = ((nibbles + (nibbles >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * EACH_BYTE
    place = np.bitwise_count(((k * EACH_BYTE | TOP_BITS) - sums) & TOP_BITS).astype(U64) << U64(3)
    rest = k - (((sums << U64(8)) >> place) & U64(255))
    return (place + SELECT[(rest << U64(8)) | ((word >> place) & U64(255))]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of non-negative integers; about 2 + log2(universe / n) bits each.

    High parts are a unary bit vector (with the number of ones before each word), low parts are packed.
    """

    def __init__(self, low_bits: int, n: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.low_bits, self.n, self.low, self.high, self.ones = low_bits, n, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(U64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = pack(values & ((ONE << U64(bits)) - ONE), bits)
        marks = (values >> U64(bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
        length = (top >> bits) + n + 2
        words = np.zeros(length // 64 + 1, U64)
        if n:
            word = marks >> 6
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[starts]] = np.bitwise_or.reduceat(ONE << (marks & 63).astype(U64), starts)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
        return cls(bits, n, low, words, ones.astype(np.uint32))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones, "shape": np.array([self.low_bits, self.n], np.int64)}

    @classmethod
    def from_arrays(cls, arrays: dict[str, np.ndarray]) -> EliasFano:
        bits, n = (int(x) for x in arrays["shape"])
        return cls(bits, n, arrays["low"], arrays["high"], arrays["ones"])

    def _mark(self, i: np.ndarray) -> np.ndarray:
        """Place in the bit vector of the i-th one."""
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        return (word << 6) + _select_in_word(self.high[word], i - self.ones[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        return (((self._mark(i) - i).astype(U64)) << U64(self.low_bits)) | unpack(self.low, self.low_bits, i)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """Number of elements whose high part is below `high`."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        k = high[some] - 1  # the k-th zero ends the run of high part k
        if not hasattr(self, "_zeros"):
            self._zeros = np.arange(len(self.high), dtype=np.int64) * 64 - self.ones[:-1]
        word = np.searchsorted(self._zeros, k, side="right") - 1
        out[some] = (word << 6) + _select_in_word(~self.high[word], k - self._zeros[word]) - k
        return out

    def _run(self, bit: np.ndarray) -> np.ndarray:
        """Length of the run of ones that begins at each bit, 64 for longer ones."""
        word, off = bit >> 6, (bit & 63).astype(U64)
        after = np.minimum(word + 1, len(self.high) - 1)
        window = (self.high[word] >> off) | ((self.high[after] << (U64(63) - off)) << ONE)
        return np.bitwise_count(window & ~(window + ONE)).astype(np.int64)

    def find(self, value: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of each value among the elements [lo, hi), or -1. Elements of the range are distinct."""
        value = value.astype(U64)
        high = (value >> U64(self.low_bits)).astype(np.int64)
        limit = len(self.high) * 64 - self.n - 2
        inside = high <= limit
        high = np.where(inside, high, 0)
        left = self._before(high)
        run = self._run(np.minimum(left + high, len(self.high) * 64 - 1))
        right = left + run
        long = np.flatnonzero(run >= 64)
        right[long] = self._before(high[long] + 1)
        left, right = np.maximum(left, lo), np.minimum(right, self.n if hi is None else hi)
        right = np.where(inside, right, left)
        want = value & ((ONE << U64(self.low_bits)) - ONE)
        found = np.full(len(value), -1, np.int64)
        open_ = np.flatnonzero(left < right)
        left, right, want = left[open_], right[open_], want[open_]
        mid = left  # runs are short: the first element first
        while len(open_):
            here = unpack(self.low, self.low_bits, mid)
            hit = here == want
            found[open_[hit]] = mid[hit]
            less = here < want
            left, right = np.where(less, mid + 1, left), np.where(less, right, mid)
            on = np.flatnonzero((left < right) & ~hit)
            open_, left, right, want = open_[on], left[on], right[on], want[on]
            mid = (left + right) >> 1
        return found
