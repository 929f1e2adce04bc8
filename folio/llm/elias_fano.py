"""Elias-Fano sequences and the levels of an n-gram trie, over plain bytes that can be memory-mapped.

Nothing is decoded as a whole: a lookup reads the sampled counts, one stretch of
512 high bits and the low bits of the few values in one bucket.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

#: Words of 64 high bits between two sampled counts.
STRETCH = 8
#: Queries looked up at a time.
CHUNK = 1 << 16
ONE = np.uint64(1)


def _select_table() -> np.ndarray:
    """By byte and r: the place of the byte's r-th one."""
    table = np.zeros((256, 8), np.uint8)
    for byte in range(256):
        ones = [k for k in range(8) if byte >> k & 1]
        table[byte, : len(ones)] = ones
    return table


IN_BYTE = _select_table()


def _words(bits: np.ndarray, multiple: int = 1) -> np.ndarray:
    """A vector of 0 and 1 as 64-bit words, a multiple of ``multiple`` of them."""
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate((packed, np.zeros(-max(len(packed), 1) % (8 * multiple) + (not len(packed)), np.uint8))).view("<u8")


def _lanes(width: int) -> np.uint64:
    """A one at the foot of each of a word's lanes of ``width`` bits."""
    return np.uint64(sum(1 << k for k in range(0, 64, width)))


BYTES, QUARTERS = _lanes(8), _lanes(16)
TOPS, HIGH_TOPS = BYTES << np.uint64(7), QUARTERS << np.uint64(15)
PAIRS, NIBBLES, HALVES = (np.uint64(sum(((1 << w) - 1) << k for k in range(0, 64, 2 * w))) for w in (1, 2, 4))


def _stretch_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running counts of ones over each row's eight words, four 16-bit lanes in each of two numbers (the second without the first's sum)."""
    both = np.bitwise_count(words).astype(np.uint16).view(np.uint64) * QUARTERS
    return both[:, 0], both[:, 1]


def _lane(x: np.ndarray, k: np.ndarray, width: int) -> np.ndarray:
    """The lane before the k-th one; 0 before the first."""
    mask = np.uint64((1 << width) - 1)
    return np.where(k > 0, x >> (np.maximum(k, 1) - 1).astype(np.uint64) * np.uint64(width) & mask, np.uint64(0))


def _before_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Ones in the words before the k-th one of each row."""
    first, second = _stretch_sums(words)
    late = k >= STRETCH // 2
    own = _lane(np.where(late, second, first), np.where(late, k - STRETCH // 2, k), 16)
    return (own + np.where(late, first >> np.uint64(48), np.uint64(0))).astype(np.int64)


def _place(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th one in each row of ``words`` (rows of STRETCH words)."""
    first, second = _stretch_sums(words)
    r = r.astype(np.uint64)
    late = r >= first >> np.uint64(48)
    r = r - np.where(late, first >> np.uint64(48), np.uint64(0))
    sums = np.where(late, second, first)
    # Lanes whose running count is r at most: their top bits survive the subtraction.
    k = np.bitwise_count(((r * QUARTERS | HIGH_TOPS) - sums) & HIGH_TOPS).astype(np.int64)
    r = r - _lane(sums, k, 16)
    word = k + late * (STRETCH // 2)
    found = words[np.arange(len(r)), word]
    counts = found - (found >> ONE & PAIRS)
    counts = (counts & NIBBLES) + (counts >> np.uint64(2) & NIBBLES)
    counts = (counts + (counts >> np.uint64(4)) & HALVES) * BYTES
    byte = np.bitwise_count(((r * BYTES | TOPS) - counts) & TOPS).astype(np.int64)
    r = r - _lane(counts, byte, 8)
    return word * 64 + byte * 8 + IN_BYTE[(found >> (byte * 8).astype(np.uint64) & np.uint64(255)).astype(np.int64), r.astype(np.int64)]


class Bits:
    """A bit vector with counts of ones sampled every 512 bits: select and rank."""

    HEAD = struct.Struct("<QQ")

    def __init__(self, data, at: int = 0):
        self.n, n_words = self.HEAD.unpack_from(data, at)
        at += self.HEAD.size
        self.words = np.frombuffer(data, "<u8", n_words, at).reshape(-1, STRETCH)
        at += 8 * n_words
        self.ones = np.frombuffer(data, "<u8", n_words // STRETCH + 1, at).view(np.int64)
        self.end = at + 8 * len(self.ones)

    @classmethod
    def pack(cls, bits: np.ndarray) -> bytes:
        words = _words(bits, STRETCH)
        ones = np.r_[0, np.cumsum(np.bitwise_count(words).reshape(-1, STRETCH).sum(axis=1, dtype=np.int64))]
        return cls.HEAD.pack(len(bits), len(words)) + words.tobytes() + ones.astype("<u8").tobytes()

    def select(self, i: np.ndarray, one: bool = True) -> np.ndarray:
        """Place of the i-th one (or zero); i must be below their number, the padding's zeros included."""
        before = self.ones if one else np.arange(len(self.ones)) * (64 * STRETCH) - self.ones
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), CHUNK):
            own = i[at : at + CHUNK]
            stretch = np.searchsorted(before, own, side="right") - 1
            words = self.words[stretch]
            out[at : at + CHUNK] = stretch * (64 * STRETCH) + _place(words if one else ~words, own - before[stretch])
        return out

    def zeros(self) -> int:
        return self.words.size * 64 - int(self.ones[-1])

    def rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each place, and how many ones stand before it."""
        here, before = np.empty(len(at), bool), np.empty(len(at), np.int64)
        for i in range(0, len(at), CHUNK):
            own = at[i : i + CHUNK]
            stretch, word, shift = own // (64 * STRETCH), own // 64 % STRETCH, (own & 63).astype(np.uint64)
            words = self.words[stretch]
            found = words[np.arange(len(own)), word]
            here[i : i + CHUNK] = found >> shift & ONE
            before[i : i + CHUNK] = self.ones[stretch] + _before_word(words, word) + np.bitwise_count(found & ((ONE << shift) - ONE))
        return here, before

    def ones_after(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand in a row from each place on; 64 stands for 64 or more."""
        flat = self.words.reshape(-1)
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        here = flat[np.minimum(word, flat.size - 1)] >> shift
        later = np.where(word + 1 < flat.size, flat[np.minimum(word + 1, flat.size - 1)], np.uint64(0)) << ONE << (np.uint64(63) - shift)
        gap = ~(here | later)
        return np.bitwise_count(~gap & (gap - ONE)).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of n integers in about n * (2 + log2(universe / n)) bits.

    The low bits of the values are packed side by side; the high parts are
    unary gaps in one bit vector.
    """

    HEAD = struct.Struct("<QQQ")

    def __init__(self, data, at: int = 0):
        self.n, self.low_bits, n_low = self.HEAD.unpack_from(data, at)
        at += self.HEAD.size
        self.low = np.frombuffer(data, "<u8", n_low, at)
        self.high = Bits(data, at + 8 * n_low)
        self.end = self.high.end
        self.mask = np.uint64((1 << self.low_bits) - 1)

    @classmethod
    def pack(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.int64)
        n = len(values)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n and values[-1] >= n else 0
        parts = []
        for at in range(0, n if bits else 0, CHUNK):  # a chunk's bits fill whole bytes
            own = values[at : at + CHUNK]
            cells = np.empty((len(own), bits), np.uint8)
            for k in range(bits):
                cells[:, k] = own >> k & 1
            parts.append(np.packbits(cells.ravel(), bitorder="little"))
        low = np.concatenate([*parts, np.zeros(8 + -sum(map(len, parts)) % 8, np.uint8)])
        high = np.zeros(int(values[-1] >> bits) + n + 1 if n else 0, np.uint8)
        high[(values >> bits) + np.arange(n)] = 1
        return cls.HEAD.pack(n, bits, len(low) // 8) + low.tobytes() + Bits.pack(high)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        return (self.low[word] >> shift | self.low[word + 1] << ONE << (np.uint64(63) - shift)) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        return (self.high.select(i) - i) << self.low_bits | self.low_of(i).astype(np.int64)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values have a smaller high part, and how many have this one at most."""
        zeros = self.high.zeros()
        at = np.full(len(high), -1)
        later = np.flatnonzero((high > 0) & (high <= zeros))
        at[later] = self.high.select(high[later] - 1, one=False)
        first = np.where(high > zeros, self.n, at + 1 - high)
        run = self.high.ones_after(at + 1)
        stop = np.where(high > zeros, self.n, first + run)
        long = np.flatnonzero((run == 64) & (high < zeros))
        stop[long] = self.high.select(high[long], one=False) - high[long]
        return first, stop

    def successor(self, x: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first value >= x within [first, stop), and whether it equals x.

        ``first`` must not lie behind x's bucket unless all its values are larger.
        """
        high = x >> self.low_bits
        bucket, end = self._bucket(high)
        lo, hi = np.clip(bucket, first, stop), np.clip(end, first, stop)
        bound, low = hi.copy(), x.astype(np.uint64) & self.mask
        while len(open_ := np.flatnonzero(lo < hi)):
            middle = (lo[open_] + hi[open_]) >> 1
            less = self.low_of(middle) < low[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
        equal = lo < bound
        equal[equal] = self.low_of(lo[equal]) == low[equal]
        return lo, equal


def by_runs(f, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """``f`` of each run of equal numbers once, spread over the runs."""
    heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    times = np.diff(np.r_[heads, len(x)])
    return tuple(np.repeat(y, times) for y in f(x[heads]))


class Level:
    """Sorted lists of integers, one per group, as monotone pointers and one monotone sequence of values.

    Each list is shifted behind the one before it.  A search reads the two
    pointers of a group and looks for the successor between them.
    """

    def __init__(self, data, at: int = 0):
        self.pointers = EliasFano(data, at)
        self.sequence = EliasFano(data, self.pointers.end)
        self.end = self.sequence.end

    @staticmethod
    def pack(groups: np.ndarray, values: np.ndarray, n_groups: int) -> bytes:
        """``groups`` and ``values`` sorted by group, then value; values increase within a group."""
        starts = np.searchsorted(groups, np.arange(n_groups + 1))
        lasts = np.zeros(n_groups, np.int64)
        full = np.flatnonzero(starts[1:] > starts[:-1])
        lasts[full] = values[starts[1:][full] - 1] + 1
        shift = np.r_[0, np.cumsum(lasts)]
        return EliasFano.pack(starts) + EliasFano.pack(values + shift[groups])

    def bounds(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First position, stop and shift of each group's list."""
        first, stop = self.pointers.get(groups), self.pointers.get(groups + 1)
        shift = np.zeros(len(groups), np.int64)
        # Where a list begins, the shift is the value before it plus one.
        later = first > 0
        shift[later] = self.sequence.get(first[later] - 1) + 1
        return first, stop, shift

    def find(self, groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each value in its group's list (-1: not there), within the level and within the list; groups below 0 have none."""
        at, inside = np.full(len(groups), -1), np.full(len(groups), -1)
        ok = np.flatnonzero((groups >= 0) & (values >= 0)) if self.sequence.n else np.zeros(0, np.int64)
        first, stop, shift = by_runs(self.bounds, groups[ok])
        found, equal = self.sequence.successor(values[ok] + shift, first, stop)
        at[ok[equal]] = found[equal]
        inside[ok[equal]] = found[equal] - first[equal]
        return at, inside


class Quantised:
    """Positive numbers as 255 steps of their logarithm between the smallest and the largest.

    The most frequent step costs one bit; the others one bit and a byte.
    """

    HEAD = struct.Struct("<QQQdd")

    def __init__(self, data, at: int = 0):
        self.n, self.mode, n_codes, self.least, self.step = self.HEAD.unpack_from(data, at)
        self.other = Bits(data, at + self.HEAD.size)
        self.codes = np.frombuffer(data, np.uint8, n_codes, self.other.end)
        self.end = self.other.end + n_codes + -n_codes % 8

    @classmethod
    def pack(cls, values: np.ndarray) -> bytes:
        logs = np.log2(values)
        least, most = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
        step = (most - least) / 255
        codes = np.round((logs - least) / step).astype(np.uint8) if step else np.zeros(len(values), np.uint8)
        mode = int(np.bincount(codes, minlength=1).argmax())
        others = codes[codes != mode]
        padding = bytes(-len(others) % 8)
        return cls.HEAD.pack(len(values), mode, len(others), least, step) + Bits.pack((codes != mode).astype(np.uint8)) + others.tobytes() + padding

    def get(self, at: np.ndarray, otherwise: float) -> np.ndarray:
        """Values at positions; ``otherwise`` at positions below 0."""
        out = np.full(len(at), otherwise)
        known = np.flatnonzero(at >= 0) if self.n else np.zeros(0, np.int64)
        differs, before = self.other.rank(at[known])
        codes = np.full(len(known), self.mode, np.int64)
        codes[differs] = self.codes[before[differs]]
        out[known] = np.exp2(self.least + self.step * codes)
        return out


class Trie:
    """Bigrams and trigrams that share a middle word v.

    Level 1 has the words v; level 2 for each v its successors w; the contexts
    level for each v the words u before it; level 3 for each (u, v) the
    positions of its successors among those of v, which are small numbers.
    Discounted probabilities and left-over masses are quantised.
    """

    def __init__(self, data):
        self.words = EliasFano(data)
        self.two = Level(data, self.words.end)
        self.before = Level(data, self.two.end)
        self.three = Level(data, self.before.end)
        at, self.tables = self.three.end, []
        for _ in range(4):
            self.tables.append(Quantised(data, at))
            at = self.tables[-1].end

    @staticmethod
    def pack(v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray, discount: float, lean: Callable[[np.ndarray], np.ndarray], whole: bool = True, total: np.ndarray | None = None) -> bytes:
        """From distinct (v, u, w) sorted in this order with counts over 0; u = 0 stands for no word, w is over 0.

        Trigrams are discounted; bigrams after a word of count n leave ``lean(n)``
        to the unigrams.  Without ``whole`` the words' bigrams are not all here:
        level 2 has no probabilities, and a query gives what level 3 leaves over
        as a whole.  ``total`` has each row's count of v where its tokens are
        not all here.
        """
        words, vk = np.unique(v, return_inverse=True)
        pair = np.lexsort((w, vk))
        fresh = np.r_[True, (vk[pair][1:] != vk[pair][:-1]) | (w[pair][1:] != w[pair][:-1])] if len(v) else np.zeros(0, bool)
        place = np.empty(len(v), np.int64)
        place[pair] = np.cumsum(fresh) - 1
        two_v, two_w = vk[pair][fresh], w[pair][fresh]
        first2 = np.searchsorted(two_v, np.arange(len(words)))
        p2 = left2 = np.zeros(0)
        if whole and len(v):
            two_n = np.bincount(place, count, len(two_v))
            total2 = np.bincount(two_v, two_n, len(words)) if total is None else total[np.searchsorted(v, words)]
            left2 = lean(total2)
            p2 = (1 - left2[two_v]) * two_n / total2[two_v]

        context = np.r_[True, (vk[1:] != vk[:-1]) | (u[1:] != u[:-1])] if len(v) else np.zeros(0, bool)
        ck = np.cumsum(context) - 1
        total3 = np.bincount(ck, count) if len(v) else np.zeros(0)
        kept = u > 0
        used = np.unique(ck[kept])
        heads = np.flatnonzero(context)[used]
        k3 = np.searchsorted(used, ck[kept])
        relative = place[kept] - first2[vk[kept]]
        p3 = (count[kept] - discount) / total3[ck[kept]]
        left3 = np.bincount(k3, minlength=len(used)) * discount / total3[used]
        return b"".join(
            (
                EliasFano.pack(words),
                Level.pack(two_v, two_w, len(words)),
                Level.pack(vk[heads], u[heads], len(words)),
                Level.pack(k3, relative, len(used)),
                *map(Quantised.pack, (p2, left2, p3, left3)),
            )
        )

    def query(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) so that P(w | u v) = a + b * P(w); faster where equal v and u are neighbours."""
        p2, left2, p3, left3 = self.tables
        if not self.words.n:
            return np.zeros(len(v)), np.ones(len(v))

        def word(x: np.ndarray) -> tuple[np.ndarray]:
            at, equal = self.words.successor(x, np.zeros(len(x), np.int64), np.full(len(x), self.words.n))
            return (np.where(equal, at, -1),)

        (k,) = by_runs(word, v)
        at2, relative = self.two.find(k, np.where(w > 0, w, -1))
        a2, b2 = p2.get(at2, 0.0), left2.get(k, 1.0)
        # Each context is looked up once.
        heads = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])]) if len(v) else np.zeros(0, np.int64)
        context = self.before.find(k[heads], np.where(u[heads] > 0, u[heads], -1))[0]
        context = np.repeat(context, np.diff(np.r_[heads, len(v)]))
        at3, _ = self.three.find(context, relative)
        a3, b3 = p3.get(at3, 0.0), left3.get(context, 1.0)
        return a3 + b3 * a2, b3 * b2
