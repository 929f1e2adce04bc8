"""Hashes of words and of word n-grams, straight from the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._common import WORD_SEPARATORS

#: Odd multipliers of the hashes.
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
STEP = np.uint64(0xD6E8FEB86659FD93)


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    return h ^ (h >> np.uint64(27))


def _letters() -> np.ndarray:
    """A random number for each byte: 0 for separators, and A-Z have those of a-z."""
    table = finish((np.arange(256, dtype=np.uint64) + np.uint64(1)) * MULTIPLY)
    table[65:91] = table[97:123]
    table[list(WORD_SEPARATORS)] = 0
    return table


LETTERS = _letters()
IN_WORD = LETTERS != 0


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, STEP)])


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string column (A-Z lower-cased), and the number of words of each row."""
    flat = column.cast(pa.large_binary())
    n_rows = len(flat)
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + n_rows + 1] if n_rows else np.zeros(1, np.int64)
    first, stop = int(offsets[0]), int(offsets[-1])
    if stop == first:
        return np.zeros(0, np.uint64), np.zeros(n_rows, np.int64)
    data = np.frombuffer(flat.buffers()[2], np.uint8)[first:stop]
    bounds = offsets - first
    inside = IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_rows, np.int64)
    place = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    at = place - np.maximum.accumulate(np.where(begins, place, 0))
    # Bytes before the first word, and separators, add nothing.
    parts = LETTERS[data] * _powers(int(at[inside].max()))[np.where(inside, at, 0)]
    sums = np.add.reduceat(parts, starts)
    rows = np.searchsorted(starts, bounds)
    return finish(sums * MULTIPLY + np.uint64(len(LETTERS))), np.diff(rows)


def text_hash(word: bytes) -> np.uint64:
    """The hash of one word, as ``word_hashes`` gives it; other bytes are allowed too."""
    raw = np.frombuffer(word, np.uint8)
    return finish((LETTERS[raw] * _powers(len(raw))[: len(raw)]).sum(keepdims=True) * MULTIPLY + np.uint64(len(LETTERS)))[0]


def ngram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` words; one for the whole sequence where it is shorter; none if empty."""
    if not len(words):
        return words
    n = min(size, len(words))
    count = len(words) - n + 1
    h = np.full(count, n, np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(31))) * MULTIPLY + words[k : k + count]
    return finish(h)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased: views of one array."""
    words, lengths = word_hashes(column)
    stops = np.cumsum(lengths)
    starts = stops - lengths
    # All windows at once; those that cross into the next text are never looked at.
    h = ngram_hashes(words, size) if len(words) >= size else np.zeros(0, np.uint64)
    fresh = np.zeros(len(h), bool)
    counts = np.maximum(lengths - size + 1, 0)
    for at, n in zip(starts.tolist(), counts.tolist(), strict=True):
        if n:
            h[at : at + n].sort()
            fresh[at] = True
    inside = np.zeros(len(h) + 1, np.int8)
    whole = counts > 0
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, (starts + counts)[whole], -1)
    inside = np.cumsum(inside[:-1]) > 0
    if len(h):
        fresh[1:] |= h[1:] != h[:-1]
    kept = fresh & inside
    flat, places = h[kept], np.r_[0, np.cumsum(kept)]
    ends = np.minimum(starts + counts, len(h))
    firsts = np.minimum(starts, len(h))
    out = [flat[i:j] for i, j in zip(places[firsts].tolist(), places[ends].tolist(), strict=True)]
    for k in np.flatnonzero((lengths > 0) & ~whole).tolist():
        out[k] = ngram_hashes(words[starts[k] : stops[k]], size)
    return out
