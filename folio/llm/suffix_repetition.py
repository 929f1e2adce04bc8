"""Quality rules: repetition inside a text by suffix array and LCP intervals.

Many texts at a time are laid end to end as word ids, each closed by a symbol
of its own, and sorted by prefix doubling; suffixes that are already alone in
their rank leave the sort, so ordinary prose costs two or three rounds.  The
ranks of every round are kept, which gives the LCP of neighbours by binary
descent.  The parent LCP interval of a suffix is the longest repeated substring
that starts there, so the union of the spans ``[i, i + LCP)`` over suffixes with
an LCP of ``min_words`` or more equals the union of all occurrences of all
maximal repeats (an interval that is not left-maximal lies inside its left
extension).  The operator is a narrow map: no shuffle, memory bounded by a
slice of a batch or one text.

Defined cases: a null text has no words; a text without words or with fewer than
``min_words`` has no repeats; equal texts get equal figures; ties need no order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import WORD_SEPARATORS, slices

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """A text passes with ``min_words`` words, base repeats of ``base_repeat_percent`` at most, and
    maximal repeats of ``min_repeat`` words or more that cover ``max_covered`` of its words and are
    ``max_longest`` words long at most."""

    min_words: int = 20
    base_window: int = 8
    base_repeat_percent: int = 30
    min_repeat: int = 5
    max_covered: float = 0.40
    max_longest: int = 100


def suffix_lcp(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, inverse and LCP with the suffix before; an LCP under ``least`` may be given as 0.

    ``symbols`` must end each text with a symbol that occurs once.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    fresh = np.r_[True, ordered[1:] != ordered[:-1]]
    starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    active = order[~(fresh & np.r_[fresh[1:], True])]
    levels, step = [rank.astype(np.int32)], 1
    while len(active):
        key = rank[active] * n + rank[active + step]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        at = np.arange(len(active))
        old_start = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        fresh = np.r_[True, key[1:] != key[:-1]]
        new_start = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = old + new_start - old_start
        active = active[~(fresh & np.r_[fresh[1:], True])]
        step *= 2
        levels.append(rank.astype(np.int32))
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    floor = max(0, min(least, 1 << 30).bit_length() - 1)
    if floor < len(levels):
        same = levels[floor][suffixes]
        pairs = np.flatnonzero(same[1:] == same[:-1]) + 1
        a, b = suffixes[pairs - 1], suffixes[pairs]
        found = np.zeros(len(pairs), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            equal = levels[k][a] == levels[k][b]
            jump = equal.astype(np.int64) << k
            a, b, found = a + jump, b + jump, found + jump
        lcp[pairs] = found
    return suffixes, rank, lcp


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """True at positions inside the union of the spans."""
    delta = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(delta)[:n] > 0


@dataclass
class Repeats:
    n_words: int
    covered: int
    longest: int
    spans: list[tuple[int, int]]
    base_repeats: int


def repeats(texts: list[list[bytes]], min_repeat: int, base_window: int) -> list[Repeats]:
    """Repeats inside each list of words."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    counts = np.array([len(t) for t in texts])
    rows = [np.fromiter(map(ids.__getitem__, t), np.int64, len(t)) for t in texts]
    ends = np.cumsum(counts + 1)
    symbols = np.empty(int(ends[-1]) if len(texts) else 0, np.int64)
    for i, (row, end) in enumerate(zip(rows, ends.tolist(), strict=True)):
        symbols[end - 1 - len(row) : end - 1] = row
        symbols[end - 1] = len(ids) + i
    n = len(symbols)
    if not n:
        return []
    # No suffix of one text may match another text's: the text's number is part of each symbol.
    mixed = symbols + np.repeat(np.arange(len(texts)), counts + 1) * (len(ids) + len(texts))
    suffixes, rank, lcp = suffix_lcp(mixed, min(min_repeat, base_window))
    most = np.empty(n, np.int64)
    most[suffixes] = np.maximum(lcp, np.r_[lcp[1:], 0])
    wide = np.flatnonzero(most >= min_repeat)
    cover = covered(wide, most[wide], n)
    base = np.flatnonzero(most >= base_window)
    base_cover = covered(base, most[base], n)
    firsts = ends - counts - 1
    sums, base_sums = np.r_[0, np.cumsum(cover)], np.r_[0, np.cumsum(base_cover)]
    longest = np.maximum.reduceat(np.where(most >= min_repeat, most, 0), firsts)
    edges = np.flatnonzero(np.diff(np.r_[0, cover.astype(np.int8), 0]))
    begins, stops = edges[::2], edges[1::2]
    lo, hi = np.searchsorted(begins, firsts), np.searchsorted(begins, ends)
    return [
        Repeats(c, int(sums[e] - sums[f]), g, [(int(b - f), int(s - f)) for b, s in zip(begins[i:j], stops[i:j], strict=True)], int(base_sums[e] - base_sums[f]))
        for c, f, e, g, i, j in zip(counts.tolist(), firsts.tolist(), ends.tolist(), longest.tolist(), lo.tolist(), hi.tolist(), strict=True)
    ]


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(WORD_SEPARATORS)]
    return len(lines) - len(set(lines))


JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long, spans array<struct<first:int,stop:int>>"


def judge(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limits: Limits = Limits()) -> DataFrame:
    """``keep`` columns, base figures, the repetition figures, word spans of repeats, and the verdict."""
    names = [x.split()[0] for x in JUDGED.split(", ")]
    span = pa.struct([("first", pa.int32()), ("stop", pa.int32())])
    types = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text", 2 << 20):
            texts = [x or "" for x in part.column("__text").to_pylist()]
            raw = [x.encode() for x in texts]
            rows = []
            for s, b, r in zip(texts, raw, repeats([x.split() for x in raw], limits.min_repeat, limits.base_window), strict=True):
                chars = len(s) - len(b) + len(b.translate(None, WORD_SEPARATORS))
                symbols = len(b) - len(b.translate(None, SYMBOLS))
                failed = r.n_words < limits.min_words or 100 * r.base_repeats > limits.base_repeat_percent * r.n_words
                kept = not failed and r.covered <= limits.max_covered * r.n_words and r.longest <= limits.max_longest
                rows.append((r.n_words, chars, symbols, _dup_lines(b), r.base_repeats, failed, kept, r.covered, r.longest, [{"first": f, "stop": e} for f, e in r.spans]))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *made], names=[*keep, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), JUDGED])
    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)
