"""Best-fit packing by a configuration linear program over the length histogram.

Documents become pieces of at most ``capacity`` tokens.  What the driver sees is
the histogram of piece lengths, which has ``capacity`` entries at most whatever
the input's size.  The linear program asks how often each pattern of lengths is
used.  Its first columns are the patterns of best fit.  In every round the lengths
are priced by their weights; a knapsack dynamic program finds the best pattern
through each of many lengths, and these are new columns.  The value of the best
one of all gives a dual bound, below which no packing falls.  Multiplicative
weights of columns against lengths then settle the fractional solution, which is
rounded: whole uses of the patterns, the fullest first, then best fit of the few
pieces that are left into the open room and new sequences.  The best packing of
all rounds counts, so none needs more sequences than best fit alone; rounds end
as soon as the bound shows that no fewer will do.  The solution is a table of
slot ranges by length; every piece finds its slot by its number among the pieces
of its length.

Numbering is done in two steps so that no length's pieces meet in one task:
hash buckets within a length, and running sums of bucket counts.

Defined cases: a null text is an empty one; an empty text is one piece with the
end token alone; repeated rows are separate documents; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import token_cache
from ._common import slices, staged

END = np.array([0], "<u4").tobytes()
#: Rounds of pricing at most, rounds without a better packing after which they end, and steps of the weights in a round.
ROUNDS, PATIENCE, TURNS = 60, 25, 200
#: Step sizes, by turns, over the largest share that a pattern covers: small ones settle few lengths, large ones many.
RATES = (4.0, 100.0, 10.0, 30.0)
#: Patterns that a round adds at most; share of use under which one is dropped.
FRESH, LEAST_SHARE = 256, 1e-7
#: A packing this near the dual bound is taken for the best.
NEAR = 0.0005
#: Pieces in a numbering bucket.
BUCKET_ROWS = 20_000

Pattern = tuple[tuple[int, int], ...]


def pieces(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = 2048) -> DataFrame:
    """``keep`` columns, piece, start, length and ids_crc32 of every piece of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text", keep_caches=True):
            rows, at = [], []
            for i, ids in enumerate(token_cache.encode([x or "" for x in part.column("__text").to_pylist()], tokenizer)):
                ids += END
                for k, first in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[first : first + 4 * capacity]
                    at.append(i)
                    rows.append((k, first // 4, len(cut) // 4, zlib.crc32(cut)))
            kept = part.select(list(keep)).take(pa.array(at))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*keep, "piece", "start", "length", "ids_crc32"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), "piece int, start long, length long, ids_crc32 long"])
    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """By room: the largest value of a pattern, and the length (its index) put in last (-1: the room's last token stays free)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    reach = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := reach[c]:
            worth = best[c - lengths[:k]] + values[:k]
            j = int(worth.argmax())
            if worth[j] > best[c]:
                best[c], last[c] = worth[j], j
    return best, last


def price(lengths: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int, fresh: int = FRESH) -> tuple[float, list[Pattern]]:
    """The largest value of any pattern, and the best pattern through each of the ``fresh`` best lengths, times cut to ``most``."""
    best, last = knapsack(lengths, values, capacity)
    # Rooms whose last token stays free are skipped.
    down = np.maximum.accumulate(np.where(last >= 0, np.arange(capacity + 1), 0))
    found = []
    for j in np.argsort(-(values + best[capacity - lengths]), kind="stable")[:fresh].tolist():
        times, room = Counter([j]), int(down[capacity - lengths[j]])
        while room:
            times[int(last[room])] += 1
            room = int(down[room - lengths[last[room]]])
        found.append(tuple((int(lengths[i]), min(n, int(most[i]))) for i, n in sorted(times.items(), reverse=True)))
    return float(best[capacity]), found


def play(patterns: list[Pattern], lengths: np.ndarray, need: np.ndarray, x: np.ndarray, w: np.ndarray, rate: float, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiplicative weights of patterns (``x``) and of lengths (``w``) against each other; the averages of both.

    Patterns gain by the share that they cover of heavy lengths, lengths by being
    covered less than others.  Each step looks ahead by the last one.
    """
    row = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    item = np.searchsorted(lengths, [length for p in patterns for length, _ in p])
    share = np.array([times for p in patterns for _, times in p]) / need[item]
    firsts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    gains = lambda x, w: (np.add.reduceat(w[item] * share, firsts), np.bincount(item, x[row] * share, len(w)))
    rate /= share.max()
    sum_x, sum_w, (old_x, old_w) = np.zeros_like(x), np.zeros_like(w), gains(x, w)
    for _ in range(turns):
        gain_x, gain_w = gains(x, w)
        ahead_x, ahead_w = rate * (2 * gain_x - old_x), rate * (old_w - 2 * gain_w)
        x, w = x * np.exp(ahead_x - ahead_x.max()), w * np.exp(ahead_w - ahead_w.max())
        x, w = x / x.sum(), w / w.sum()
        sum_x, sum_w, old_x, old_w = sum_x + x, sum_w + w, gain_x, gain_w
    return sum_x / turns, sum_w / turns


def rounded(patterns: list[Pattern], uses: np.ndarray, histogram: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Whole uses of the patterns, the fullest first, a lost share carried on to the next; best fit of the rest into their room and new sequences."""
    fill = [sum(length * times for length, times in p) for p in patterns]
    left, out, carried = dict(histogram), Counter(), 0.0
    for i in sorted(range(len(patterns)), key=lambda i: (-fill[i], -uses[i])):
        carried += uses[i]
        n = min(int(carried), min(left[length] // times for length, times in patterns[i]))
        if n > 0:
            out[patterns[i]] += n
            for length, times in patterns[i]:
                left[length] -= n * times
        carried = min(carried - n, 1.0)
    return best_fit({x: n for x, n in left.items() if n}, capacity, out)


def best_fit(left: dict[int, int], capacity: int, begun: dict[Pattern, int] | None = None) -> dict[Pattern, int]:
    """Best fit by decreasing length into the room of sequences ``begun`` and new ones, over groups of equal sequences rather than single ones."""
    groups: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if not groups[room]:
            insort(rooms, room)
        groups[room].append((pattern, n))

    for pattern, n in (begun or {}).items():
        put(capacity - sum(length * times for length, times in pattern), pattern, n)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                times = min(capacity // length, n)
                put(capacity - times * length, ((length, times),), n // times)
                n %= times
                continue
            room = rooms[at]
            pattern, have = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            times = max(1, min(room // length, n // have))
            used = min(have, n // times)
            if used < have:
                put(room, pattern, have - used)
            put(room - times * length, (*pattern, (length, times)), used)
            n -= used * times
    out: dict[Pattern, int] = defaultdict(int)
    for room in rooms:
        for pattern, n in groups[room]:
            out[pattern] += n
    return out


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[dict[Pattern, int], float]:
    """Patterns and how many sequences use each, together the histogram exactly; and a number of sequences that no packing falls below.

    The first columns are those of best fit, so the result never needs more
    sequences than best fit alone; where the dual bound shows that these are
    (nearly) as few as can be, no round is played.
    """
    lengths = np.array(sorted(x for x, n in histogram.items() if n), np.int64)
    if not len(lengths):
        return {}, 0.0
    histogram = {int(x): histogram[x] for x in lengths.tolist()}
    need = np.array(list(histogram.values()), np.float64)
    found = best_fit(histogram, capacity)
    weight: dict[Pattern, float] = Counter()
    for pattern, n in found.items():
        # A length may come more than once in a pattern of best fit.
        times = Counter()
        for length, k in pattern:
            times[length] += k
        weight[tuple(sorted(times.items(), reverse=True))] += n
    fewest, w, bound = sum(found.values()), need * lengths, 0.0
    w, since = w / w.sum(), 0
    for turn in range(rounds):
        value, fresh = price(lengths, w / need, need, capacity)
        # By duality: lengths priced so that no pattern is worth more than 1.
        bound = max(bound, 1 / value)
        if fewest <= max(np.ceil(bound - 1e-6), bound * (1 + NEAR)) or since == PATIENCE:
            break
        total = sum(weight.values())
        columns = list(weight | dict.fromkeys(p for p in fresh if p not in weight))
        # Every column keeps a little weight, so that it can grow.
        x = np.array([0.9 * weight.get(p, 0.0) / total + 0.1 / len(columns) for p in columns])
        x, w = play(columns, lengths, need, x, w, RATES[turn % len(RATES)], TURNS)
        weight = {p: share for p, share in zip(columns, x.tolist(), strict=True) if share > LEAST_SHARE}
        tried = rounded(list(weight), np.array(list(weight.values())) * bound, histogram, capacity)
        since += 1
        if sum(tried.values()) < fewest:
            found, fewest, since = tried, sum(tried.values()), 0
    return dict(found), bound


def slots(patterns: dict[Pattern, int]) -> dict[int, np.ndarray]:
    """By length: rows (first number, first sequence, times in a sequence, offset in it), by first number."""
    table: dict[int, list] = defaultdict(list)
    filled: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in sorted(patterns.items()):
        offset = 0
        for length, times in pattern:
            table[length].append((filled[length], sequence, times, offset))
            filled[length] += n * times
            offset += length * times
        sequence += n
    return {length: np.array(rows, np.int64) for length, rows in table.items()}


def pack(cut: DataFrame, key: tuple[str, ...] = ("doc_id", "piece"), capacity: int = 2048, rounds: int = ROUNDS) -> DataFrame:
    """The staged pieces with sequence_id and offset; ``cut`` is read three times."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(solve(histogram, capacity, rounds)[0]))
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS))
    bucketed = cut.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    counts = bucketed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    # Rows that tie are equal in all columns, so a retried task hands out the same slots.
    within = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*key, "start", "ids_crc32")) - 1
    numbered = bucketed.withColumn("__within", within).join(bases, ["length", "__bucket"]).withColumn("__number", F.col("__base") + F.col("__within")).select(*cut.columns, "__number")

    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            length = part.column("length").to_numpy(zero_copy_only=False)
            number = part.column("__number").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for one in np.unique(length).tolist():
                at = np.flatnonzero(length == one)
                rows = table.value[one]
                row = rows[np.searchsorted(rows[:, 0], number[at], side="right") - 1]
                nth = number[at] - row[:, 0]
                sequence[at] = row[:, 1] + nth // row[:, 2]
                offset[at] = row[:, 3] + nth % row[:, 2] * one
            columns = [part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = cut.select("*").schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = 2048) -> DataFrame:
    """Tokenise, cut and pack all rows of ``df``."""
    return pack(staged(pieces(df, tokenizer, text, keep, capacity), "pieces"), (*keep, "piece"), capacity)
