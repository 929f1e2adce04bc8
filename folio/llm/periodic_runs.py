"""Periodic runs of words: suffix automaton with merged end-position sets.

A run is a maximal stretch of words with smallest period q, at least ``least``
words and two periods long.  Every text is read whole:

1. Stretches.  A run repeats each of its windows of ``least / 2`` words a period
   further on, inside itself.  Words that no such repeated window covers belong
   to no run, so a text falls into the stretches between them (mostly none).
   Hashes that collide, or that fold letter case, only leave more stretches.
2. Seeds.  Each stretch gets a suffix automaton over its words.  Sets of end
   positions go up its suffix links, the smaller into the larger; a position that
   gets a new neighbour at a distance of at most the state's length ends a
   square.  For a run of period q, the prefixes that end q words before its end
   and at its end first meet at a state at least as long as the run less q, and
   nothing lies between them there, so each run is seeded.  States shorter than
   half of ``least`` are too short for any run and are not merged.
3. Runs.  Each square is extended both ways while words a period apart are
   identical.  Seeds of a multiple of the smallest period extend to the same
   stretch; the smallest of them stays.

The map is narrow: no shuffle, and a lost executor costs the batches it held.  A
set of end positions is kept in blocks, so a text of one word a million times
costs as little a word as any other.  Only words inside stretches meet Python's
interpreter; the automaton takes about 400 bytes for each of them while its
text is worked on.

Defined cases: a null or empty text has no words, no runs and an empty collapsed
text; repeated rows get equal answers; columns that aren't kept play no part;
an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, slices
from ._words import ngram_hashes, word_hashes

LEAST_WORDS = 12
#: Times that stretches are cut anew by the windows that repeat within them; more would only cost time.
CUTS = 3
BLOCK = 512
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Ends:
    """An ordered set of positions, in blocks, that tells a new member's neighbours."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, position: int):
        self.blocks, self.firsts, self.size = [[position]], [position], 1

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, position: int) -> tuple[int | None, int | None]:
        """Put a new position in; returns the members next to it."""
        k = max(0, bisect_left(self.firsts, position) - 1)
        block = self.blocks[k]
        at = bisect_left(block, position)
        before = block[at - 1] if at else None
        if at < len(block):
            after = block[at]
        else:
            after = self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        block.insert(at, position)
        if not at:
            self.firsts[k] = position
        if len(block) > 2 * BLOCK:
            self.blocks.insert(k + 1, block[BLOCK:])
            self.firsts.insert(k + 1, block[BLOCK])
            del block[BLOCK:]
        self.size += 1
        return before, after


def automaton(letters: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and first end (-1 for a split-off state) of every state; state 0 is the root."""
    length, link, end, steps = [0], [-1], [-1], [{}]
    last = 0
    for i, letter in enumerate(letters):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        steps.append({})
        state = last
        while state >= 0 and letter not in steps[state]:
            steps[state][letter] = new
            state = link[state]
        if state >= 0:
            found = steps[state][letter]
            if length[found] == length[state] + 1:
                link[new] = found
            else:
                part = len(length)
                length.append(length[state] + 1)
                link.append(link[found])
                end.append(-1)
                steps.append(dict(steps[found]))
                while state >= 0 and steps[state].get(letter) == found:
                    steps[state][letter] = part
                    state = link[state]
                link[found] = link[new] = part
        last = new
    return length, link, end


def squares(letters: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(end, period, overlap): the ``overlap`` words up to ``end`` recur ``period`` words later, and ``period <= overlap``."""
    length, link, end = automaton(letters)
    ends: list[Ends | None] = [None] * len(length)
    for state in np.argsort(np.negative(length), kind="stable").tolist():
        parent = link[state]
        if parent < 0 or length[state] < least:
            continue
        mine, ends[state] = ends[state], None
        if end[state] >= 0:
            # A state's own prefix joins those of its longer states, which have come up by now.
            if mine is None:
                mine = Ends(end[state])
            else:
                yield from _near(mine, [end[state]], length[state])
        if length[parent] < least or mine is None:
            continue
        theirs = ends[parent]
        if theirs is None:
            ends[parent] = mine
            continue
        small, large = (mine, theirs) if len(mine) < len(theirs) else (theirs, mine)
        ends[parent] = large
        yield from _near(large, small, length[parent])


def _near(large: Ends, small, overlap: int) -> Iterator[tuple[int, int, int]]:
    for position in small:
        before, after = large.add(position)
        if before is not None and position - before <= overlap:
            yield before, position - before, overlap
        if after is not None and after - position <= overlap:
            yield position, after - position, overlap


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        wrong = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(wrong):
            return at + int(wrong[0])
        at, step = at + step, step * 4
    return n


def runs_of(letters: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    codes = np.array(letters, np.int64)
    back = codes[::-1]
    known: dict[int, list[tuple[int, int]]] = {}
    for end, period, overlap in squares(letters, -(-least // 2)):
        spans = known.setdefault(period, [])
        at = bisect_left(spans, (end + 1, 0))
        if at and end + period < spans[at - 1][1]:
            continue
        start, stop = end - overlap + 1, end + 1 + period
        n = len(letters)
        start -= _equal(back[n - start :], back[n - start - period :])
        stop += _equal(codes[stop - period :], codes[stop:])
        spans.insert(bisect_left(spans, (start, stop)), (start, stop))
    smallest: dict[tuple[int, int], int] = {}
    for period, spans in known.items():
        for span in spans:
            smallest[span] = min(period, smallest.get(span, period))
    return sorted((i, j - i, q) for (i, j), q in smallest.items() if j - i >= max(least, 2 * q))


def stretches(windows: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(first, stop) words that hold all runs of a text, from the hashes of its windows of ``size`` words."""
    todo, out = [(0, len(windows) + size - 1, 0)], []
    while todo:
        first, stop, cuts = todo.pop()
        own = windows[first : stop - size + 1]
        ordered = np.sort(own)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        near = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
        hit = np.flatnonzero(twice[near] == own)
        edges = np.zeros(stop - first + 1, np.int32)
        edges[hit] += 1
        edges[hit + size] -= 1
        inside = np.r_[False, np.cumsum(edges)[:-1] > 0, False]
        bounds = (np.flatnonzero(inside[1:] != inside[:-1]) + first).reshape(-1, 2).tolist()
        if cuts == CUTS or bounds == [[first, stop]]:
            out.extend((i, j) for i, j in bounds)
        else:
            todo.extend((i, j, cuts + 1) for i, j in bounds if j - i >= 2 * size - 1)
    return out


def find_runs(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST_WORDS) -> DataFrame:
    """``keep`` columns, n_words, runs (by start, then period) and collapsed of every whole text.

    ``collapsed`` is the text without the words that lie in any run after its
    first period, joined by single spaces.
    """
    size = -(-least // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            column = part.column("__text")
            hashes, counts = word_hashes(column)
            windows = ngram_hashes(hashes, size) if len(hashes) >= size else hashes[:0]
            found, sizes, collapsed, at = [], [], [], 0
            for raw, n in zip(as_bytes(column), counts.tolist(), strict=True):
                words, own = (raw or b"").split(), []
                for i, j in stretches(windows[at : at + n - size + 1], size) if n >= least else ():
                    codes: dict[bytes, int] = {}
                    own.extend((i + start, length, q) for start, length, q in runs_of([codes.setdefault(w, len(codes)) for w in words[i:j]], least))
                at += n
                if own:
                    own.sort(key=lambda r: (r[0], r[2]))
                    gone = np.zeros(n + 1, np.int32)
                    for start, length, q in own:
                        gone[start + q] += 1
                        gone[start + length] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                found.extend(own)
                sizes.append(len(own))
                collapsed.append(b" ".join(words))
            fields = np.array(found, np.int64).reshape(-1, 3)
            rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(fields[:, k])) for k in range(3)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(counts, pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=[*keep, "n_words", "runs", "collapsed"],
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), f"n_words long, runs {RUNS}, collapsed string"])
    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run of greatest length (then smallest start, then period); null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def listing(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
