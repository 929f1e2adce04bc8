"""Style of text lines: line grouping, colours, fonts, character alignment; ``raster`` has the operators on images."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAMMA = 2.2


def group_lines(boxes: DataFrame) -> DataFrame:
    """doc_id, page, line, place, box_id: boxes whose height overlaps the open line's extent by half join it.

    The extent grows with the line, so this is a fold over the page's boxes
    from top to bottom rather than a comparison of neighbours.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y1", "box_id"], kind="stable")
        line, top, bottom, lines = -1, 0, -1, []
        for y1, y2 in zip(page["y1"], page["y2"], strict=True):
            if line >= 0 and (y2 - y1) // 2 <= max(min(bottom, y2) - max(top, y1), 0):
                top, bottom = min(top, y1), max(bottom, y2)
            else:
                line, top, bottom = line + 1, y1, y2
            lines.append(line)
        page = page.assign(line=lines).sort_values(["line", "x1", "box_id"], kind="stable")
        return page.assign(place=page.groupby("line").cumcount())[["doc_id", "page", "line", "place", "box_id"]]

    return boxes.groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, line int, place int, box_id string")


def median_colour(pixels: DataFrame, *keys: str) -> DataFrame:
    """Median of each channel (0 to 255) in linear light, cut back to a byte."""
    linear = lambda c: F.pow(F.col(c) / 255.0, F.lit(GAMMA))
    byte = lambda c: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow(F.median(linear(c)), F.lit(1 / GAMMA)))) * 255 + 1e-9).cast("int")
    return pixels.groupBy(*keys).agg(byte("red").alias("red"), byte("green").alias("green"), byte("blue").alias("blue"))


def merge_fonts(predictions: DataFrame) -> DataFrame:
    """block_id, font, size: the font of least mean cost and the median size of its predictions; NaN is no value."""
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    merged = predictions.groupBy("block_id", "font").agg(F.avg(value("cost")).alias("cost"), F.median(value("size")).alias("size"))
    best = F.min(F.struct("cost", "font", "size"))
    return merged.where(F.col("cost").isNotNull()).groupBy("block_id").agg(best.alias("b")).select("block_id", "b.font", "b.size")


#: Letters of a pattern that one machine word holds; texts, and letters of the longest, that are searched side by side.
WORD_LETTERS, ABREAST, ABREAST_LETTERS = 63, 512, 1 << 23


def _columns(source: str, found: str) -> Iterator[tuple[int, int, int]]:
    """Edit distances of ``found`` to the slices of ``source``, a column of bits at a time (Myers; Hyyrö).

    After every letter of ``source``: the bits at which the distance grows by one
    from the letter of ``found`` above, those at which it falls, and the distance
    of the nearest slice that ends there.  A letter costs a dozen operations on
    numbers of as many bits as ``found`` has letters.
    """
    where: dict[str, int] = {}
    for i, c in enumerate(found):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(found)) - 1, len(found) - 1
    up, down, score = full, 0, len(found)
    yield up, down, score
    for c in source:
        eq = where.get(c, 0) | down
        flat = (((eq & up) + up) ^ up) | eq
        right, left = down | (full & ~(up | flat)), up & flat
        score += (right >> top & 1) - (left >> top & 1)
        right = right << 1 & full
        up, down = (left << 1 & full) | (full & ~(right | flat)), right & flat
        yield up, down, score


def _begin(source: str, found: str, end: int, cost: int) -> int:
    """Where the slice that ends at ``end`` begins: back over substitutions first, then letters left out, then letters too many.

    Slices as near as ``cost`` that end there or on the way back reach no
    further than the pattern and twice the cost, so only these columns are
    worked out again.
    """
    low = max(0, end - len(found) - 2 * cost - 2)
    states = list(_columns(source[low:end], found))
    i, j = len(found), end
    while i and j > low:
        up, down, _ = states[j - low]
        below = (1 << i - 1) - 1
        before = states[j - low - 1]
        corner = (before[0] & below).bit_count() - (before[1] & below).bit_count()
        if corner + (found[i - 1] != source[j - 1]) == cost:
            i, j, cost = i - 1, j - 1, corner
            continue
        above = cost - (up >> i - 1 & 1) + (down >> i - 1 & 1)
        if above + 1 == cost:
            i, cost = i - 1, above
        else:
            j, cost = j - 1, cost - 1
    return j


def _nearest_of(source: str, found: str, least: int, ends) -> tuple[int, int]:
    """Of the slices at ``ends``, all ``least`` edits away, the shortest, then the first."""
    best = None
    for end in ends:
        first = _begin(source, found, end, least)
        if best is None or end - first < best[1] - best[0]:
            best = first, end
            # No slice with so few edits is shorter.
            if end - first <= max(0, len(found) - least):
                break
    return best


def _best_slice(source: str, found: str) -> tuple[int, int]:
    """The slice of ``source`` nearest to ``found`` by edits, the shortest where several are, then the first."""
    if not source or not found:
        return 0, 0
    costs = [score for _, _, score in _columns(source, found)]
    least = min(costs)
    return _nearest_of(source, found, least, (j for j, cost in enumerate(costs) if cost == least))


def _best_slices(sources: list[str], founds: list[str]) -> list[tuple[int, int]]:
    """``_best_slice`` of many texts, their columns side by side in machine words, texts of like length together."""
    out: list = [None] * len(sources)
    short = [k for k, f in enumerate(founds) if sources[k] and 0 < len(f) <= WORD_LETTERS]
    short.sort(key=lambda k: len(sources[k]))
    table, one = np.zeros(0x110000, np.uint64), np.uint64(1)
    at = 0
    while at < len(short):
        to = min(len(short), at + ABREAST)
        while to > at + 1 and (to - at) * len(sources[short[to - 1]]) > ABREAST_LETTERS:
            to = at + (to - at) // 2
        some, at = short[at:to], to
        longest = len(sources[some[-1]])
        same = np.zeros((longest, len(some)), np.uint64)
        size = np.array([len(founds[k]) for k in some], np.int64)
        for n, k in enumerate(some):
            letters = np.frombuffer(founds[k].encode("utf-32-le", "surrogatepass"), np.uint32)
            np.bitwise_or.at(table, letters, one << np.arange(len(letters), dtype=np.uint64))
            text = np.frombuffer(sources[k].encode("utf-32-le", "surrogatepass"), np.uint32)
            same[: len(text), n] = table[text]
            table[letters] = 0
        top = (size - 1).astype(np.uint64)
        full = (one << size.astype(np.uint64)) - one
        up, down, score = full.copy(), np.zeros_like(full), size.copy()
        costs = np.empty((longest + 1, len(some)), np.int8)
        costs[0] = score
        for j in range(longest):
            eq = same[j] | down
            flat = (((eq & up) + up) ^ up) | eq
            right, left = down | ~(up | flat), up & flat
            score += ((right >> top) & one).astype(np.int64) - ((left >> top) & one).astype(np.int64)
            right <<= one
            up, down = ((left << one) | ~(right | flat)) & full, right & flat & full
            costs[j + 1] = score
        for n, k in enumerate(some):
            own = costs[: len(sources[k]) + 1, n]
            least = int(own.min())
            out[k] = _nearest_of(sources[k], founds[k], least, np.flatnonzero(own == least).tolist())
    return [_best_slice(sources[k], founds[k]) if r is None else r for k, r in enumerate(out)]


def edit_slice(source: Column, found: Column) -> Column:
    """struct<first, stop> of the best slice of ``source`` for a recognised text."""

    def run(source: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_best_slices([s or "" for s in source], [f or "" for f in found]), columns=["first", "stop"])

    return F.pandas_udf(run, "first int, stop int")(source, found)


def _after(text: str) -> dict[str, np.ndarray]:
    """By character: where its next occurrence from each place on ends; -1 for none."""
    found: dict[str, np.ndarray] = {}
    for c in set(text):
        at = np.array([i for i, x in enumerate(text) if x == c])
        nth = np.searchsorted(at, np.arange(len(text) + 1))
        found[c] = np.where(nth < len(at), at[np.minimum(nth, len(at) - 1)] + 1, -1)
    return found


def best_chain(text: str, boxes: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The boxes, each right of the one before with a gap, that spell most letters of ``text`` in order.

    ``boxes`` (xmin, xmax, characters) may miss letters of the text and may hold
    several.  Of equal chains the one that ends earliest in the text is taken,
    then the one of the first box.
    """
    boxes = sorted(boxes, key=lambda r: (r[1], r[0], r[2]))
    after, rights, n = _after(text), [r[1] for r in boxes], len(text)
    # By number of boxes looked at and letters of the text used up: most letters matched, and the box that does it.
    most, who = [np.where(np.arange(n + 1) == 0, 0, -1)], [np.full(n + 1, -1)]
    back: list[np.ndarray] = []
    for i, (xmin, _, letters) in enumerate(boxes):
        before = most[bisect_left(rights, xmin, 0, i)]
        end = np.where(before >= 0, np.arange(n + 1), -1)
        for c in letters:
            end = np.where(end >= 0, after[c][end], -1) if c in after else np.full(n + 1, -1)
        gained, origin = np.full(n + 1, -1), np.full(n + 1, -1)
        # Later writes win: go from the worst start to the best, and of equal ones to the first.
        start = np.flatnonzero(end >= 0)
        start = start[np.lexsort((-start, before[start]))]
        gained[end[start]], origin[end[start]] = before[start] + len(letters), start
        better = gained > most[-1]
        most.append(np.where(better, gained, most[-1]))
        who.append(np.where(better, i, who[-1]))
        back.append(origin)
    chain, j = [], int(np.argmax(most[-1]))
    looked = len(boxes)
    while (i := int(who[looked][j])) >= 0:
        chain.append(boxes[i])
        looked, j = bisect_left(rights, boxes[i][0], 0, i), int(back[i][j])
    return chain[::-1]


def align_characters(candidates: DataFrame) -> DataFrame:
    """block_id, place, xmin, xmax, char: the chain of boxes that spells most of ``text``.

    Candidates (block_id, text, xmin, xmax, char) of one block are few; the
    dynamic program goes over them from left to right.
    """

    def run(block: pd.DataFrame) -> pd.DataFrame:
        chain = best_chain(block["text"].iloc[0] or "", list(zip(block["xmin"], block["xmax"], block["char"], strict=True)))
        return pd.DataFrame([(block["block_id"].iloc[0], i, *c) for i, c in enumerate(chain)], columns=["block_id", "place", "xmin", "xmax", "char"])

    return candidates.groupBy("block_id").applyInPandas(run, "block_id string, place int, xmin int, xmax int, char string")


def rendered(blocks: DataFrame) -> DataFrame:
    """doc_id, page, json: blocks with HTML as positioned, styled entries of a rendered page."""
    c = F.col
    css = F.concat_ws(
        " ", F.concat(F.lit("font-family: "), F.coalesce("font_family", F.lit("sans-serif")), F.lit(";")), F.concat(F.lit("color: "), F.coalesce("color", F.lit("#000")), F.lit(";")),
        F.concat(F.lit("line-height: "), F.round((c("y2") - c("y1")) / F.greatest(F.lit(1), F.coalesce("line_count", F.lit(1))), 2), F.lit("px;")),
    )
    rows = blocks.where(c("html").isNotNull())
    entry = F.struct("block_index", F.array("x1", "y1", "x2", "y2").alias("bbox"), css.alias("css"), "html")
    return rows.groupBy("doc_id", "page").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("json"))
