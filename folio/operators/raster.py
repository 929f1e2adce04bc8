"""Image columns: ink masks, colours, components, character windows, box filling, glyph distances.

A raster is a struct column (width, height, pixels): rows of grey bytes, or of
red, green and blue ones.  Every operator is a narrow Arrow map over the flat
pixels of a slice of a batch (about ``MOST_BYTES`` at a time, one raster at
least), so a task holds one slice whatever a table or partition holds.

Defined cases: a raster that is null, has no pixels, or has not as many bytes as
its sides say, gives null results and no components or windows; columns that
aren't kept play no part; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RASTER = "struct<width: int, height: int, pixels: binary>"
BOXES = "array<struct<x1: int, y1: int, x2: int, y2: int>>"
MOST_BYTES = 4 << 20
GAMMA = 2.2
#: Pixels of border looked at, least ring of a filled box and its share of the box, pixels filled beyond the box,
#: columns looked ahead and page margin of a grown box, widths of a character over the line's height.
BORDER = 2
RING_PIXELS, RING_SHARE = 2, 0.1
FILL_BEFORE, FILL_AFTER = 2, 3
LOOK, MARGIN = 4, 8
NARROWEST, WIDEST = 0.1, 2
#: Rows of glyph pairs whose distances are found together.
STACK_ROWS = 16_384


def from_text(text: Column, width: int = 64, channels: int = 1) -> Column:
    """A raster of a whole text by rule: its UTF-8 bytes in rows of ``width`` pixels, the last row filled up with spaces."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / (width * channels))).cast("int")
    padding = F.repeat(F.lit(" "), rows * width * channels - F.octet_length(raw))
    return F.struct(F.lit(width).alias("width"), rows.alias("height"), F.concat(raw, F.encode(padding, "UTF-8")).alias("pixels"))


def drawn_line(text: Column) -> Column:
    """A line of made-up glyphs, by rule, for texts that come without images (null for a null text).

    A glyph is a bar of four pixels from which each pixel's column hangs down as
    far as four bits of the letter's checksum say; white space is blank.
    """
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    depth = lambda c, k: 1 + F.shiftright(F.crc32(c), 4 * k).bitwiseAND(F.lit(15)) % 7
    glyph = lambda c, y: F.when(c.rlike("\\s"), "      ").otherwise(F.concat(*(F.when(depth(c, k) > y, "#").otherwise(" ") for k in range(4)), F.lit("  ")))
    blank = F.repeat(F.lit(" "), 2 * (6 * F.size(letters) + 2))
    line = lambda y: F.concat(F.lit("  "), F.array_join(F.transform(letters, lambda c: glyph(c, y)), ""))
    shown = F.encode(F.concat(blank, *map(line, range(8)), blank), "UTF-8")
    return F.when(text.isNotNull(), F.struct((6 * F.size(letters) + 2).alias("width"), F.lit(12).alias("height"), shown.alias("pixels")))


@dataclass
class Flat:
    """The whole rasters of a batch slice, their pixels laid end to end."""

    rows: np.ndarray  # places of whole rasters in the slice
    width: np.ndarray
    height: np.ndarray
    channels: np.ndarray
    data: np.ndarray  # bytes of the whole rasters
    firsts: np.ndarray  # first byte of each, and the end

    @classmethod
    def read(cls, column: pa.StructArray) -> Flat:
        side = lambda k: np.nan_to_num(column.field(k).cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(np.int64)
        width, height = side("width"), side("height")
        raw = [x if there else None for x, there in zip(column.field("pixels").to_pylist(), column.is_valid().to_pylist(), strict=True)]
        size = np.array([len(x or b"") for x in raw], np.int64)
        area = width * height
        good = np.flatnonzero((width > 0) & (height > 0) & ((size == area) | (size == 3 * area)))
        data = np.frombuffer(b"".join(raw[i] for i in good.tolist()), np.uint8)
        return cls(good, width[good], height[good], size[good] // area[good], data, np.r_[0, np.cumsum(size[good])])

    def __len__(self) -> int:
        return len(self.rows)

    def image(self, i: int) -> np.ndarray:
        """One raster as rows x columns x channels."""
        return self.data[self.firsts[i] : self.firsts[i + 1]].reshape(self.height[i], self.width[i], self.channels[i])

    @cached_property
    def area(self) -> np.ndarray:
        return self.width * self.height

    @cached_property
    def own(self) -> np.ndarray:
        """The raster of each pixel."""
        return np.repeat(np.arange(len(self)), self.area)

    @cached_property
    def place(self) -> np.ndarray:
        """The place of each pixel in its raster."""
        return np.arange(len(self.own)) - np.repeat(np.cumsum(self.area) - self.area, self.area)

    def by_pixel(self, channel: int) -> np.ndarray:
        if (self.channels == 1).all():
            return self.data
        at = np.repeat(self.firsts[:-1], self.area) + self.place * self.channels[self.own]
        return self.data[at + np.minimum(channel, self.channels - 1)[self.own]]

    @cached_property
    def grey(self) -> np.ndarray:
        """Luminance by the usual weights, in fixed point; grey rasters as they are."""
        if (self.channels == 1).all():
            return self.data
        red, green, blue = (self.by_pixel(k).astype(np.int64) for k in range(3))
        mixed = (4899 * red + 9617 * green + 1868 * blue + 8192) >> 14
        return np.where(self.channels[self.own] == 1, red, mixed).astype(np.uint8)

    def histograms(self, values: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        code = self.own * 256 + values
        return np.bincount(code if where is None else code[where], minlength=256 * len(self)).reshape(-1, 256)


def _map(df: DataFrame, keep: tuple[str, ...], extra: list[Column], made: str, each: Callable[[pa.RecordBatch, Flat], list[pa.Array] | tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """Narrow map of ``each`` over slices; it returns columns for all rows, or the source row of every output row and columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, int(MOST_BYTES * batch.num_rows / max(1, batch.column("__raster").nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = each(part, Flat.read(part.column("__raster")))
                kept = [part.column(c) for c in keep]
                if isinstance(found, tuple):
                    rows, found = found
                    kept = [c.take(pa.array(rows)) for c in kept]
                yield pa.RecordBatch.from_arrays([*kept, *found], names=[*keep, *names])

    shown = df.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shown), made])
    names = [x.strip().split(" ")[0].strip(":") for x in _columns(made)]
    return df.select(*keep, *extra).mapInArrow(run, schema)


def _columns(made: str) -> list[str]:
    """The columns of a schema text, not cut inside brackets."""
    out, depth = [""], 0
    for c in made:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _spread(n: int, rows: np.ndarray, values, kind: pa.DataType) -> pa.Array:
    """Values of whole rasters at their rows, null elsewhere."""
    out: list = [None] * n
    for i, x in zip(rows.tolist(), values.tolist() if isinstance(values, np.ndarray) else values, strict=True):
        out[i] = x
    return pa.array(out, kind)


# --- thresholds, masks, colours --------------------------------------------------------------


def otsu(histograms: np.ndarray) -> np.ndarray:
    """By histogram: the level that splits it with the largest variance between both sides (0 if all is one level)."""
    low = np.cumsum(histograms, axis=1)
    level = np.cumsum(histograms * np.arange(256), axis=1)
    total, sums = low[:, -1:], level[:, -1:]
    # Whole numbers up to the square, so that equal histograms split alike everywhere.
    apart = (level * total - sums * low).astype(np.float64)
    sides = (low * (total - low)).astype(np.float64)
    between = np.where(sides > 0, apart * apart / np.maximum(sides, 1), -1.0)
    return between.argmax(axis=1)


def masks(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Threshold and whether ink is the light side, by raster, and 1 for the pixels of ink.

    Ink is the side of the threshold that the median of the border is not on;
    on a tie the dark side.
    """
    threshold = otsu(flat.histograms(flat.grey))
    light = flat.grey > threshold[flat.own]
    width, height = flat.width[flat.own], flat.height[flat.own]
    y, x = flat.place // width, flat.place % width
    inner = (y >= BORDER) & (y < height - BORDER)
    # Rows and columns count twice where a raster is too small to tell its borders apart.
    times = (y < BORDER).astype(np.int64) + (y >= height - BORDER) + (inner & (x < BORDER)) + (inner & (x >= width - BORDER))
    lit = np.bincount(flat.own, times * light, len(flat))
    bright = 2 * lit >= np.bincount(flat.own, times, len(flat))
    return threshold, ~bright, (light != bright[flat.own]).astype(np.uint8)


def ink_mask(df: DataFrame, raster: str = "raster", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, threshold, light_ink, n_ink and mask: a raster of 0 for ink and 255 for background."""

    def each(part: pa.RecordBatch, flat: Flat) -> list[pa.Array]:
        threshold, light, ink = masks(flat)
        spread = lambda values, kind: _spread(part.num_rows, flat.rows, values, kind)
        shown, ends = np.where(ink, 0, 255).astype(np.uint8), np.r_[0, np.cumsum(flat.area)]
        made = [{"width": int(w), "height": int(h), "pixels": shown[i:j].tobytes()} for w, h, i, j in zip(flat.width, flat.height, ends[:-1], ends[1:], strict=True)]
        kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])
        return [spread(threshold, pa.int32()), spread(light, pa.bool_()), spread(np.bincount(flat.own, ink, len(flat)).astype(np.int64), pa.int64()), spread(made, kind)]

    return _map(df, keep, [F.col(raster).alias("__raster")], f"threshold int, light_ink boolean, n_ink long, mask {RASTER}", each)


def ink_colours(df: DataFrame, raster: str = "raster", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, red, green, blue: medians of the ink pixels in linear light, cut back to bytes (null without ink)."""
    linear = (np.arange(256) / 255.0) ** GAMMA

    def each(part: pa.RecordBatch, flat: Flat) -> list[pa.Array]:
        _, _, ink = masks(flat)
        out = []
        for channel in range(3):
            counts = flat.histograms(flat.by_pixel(channel), ink > 0).cumsum(axis=1)
            n = counts[:, -1]
            low, high = (np.sum(counts <= k[:, None], axis=1) for k in ((n - 1) // 2, n // 2))
            middle = (linear[np.minimum(low, 255)] + linear[np.minimum(high, 255)]) / 2
            byte = np.floor(np.clip(middle ** (1 / GAMMA), 0, 1) * 255 + 1e-9).astype(np.int64)
            out.append(_spread(part.num_rows, flat.rows, [int(b) if k else None for b, k in zip(byte, n, strict=True)], pa.int32()))
        return out

    return _map(df, keep, [F.col(raster).alias("__raster")], "red int, green int, blue int", each)


# --- connected components --------------------------------------------------------------------


@dataclass
class Components:
    """Components of ink (by edges, not corners) of all rasters, by raster and first pixel; boxes with their last row and column."""

    own: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    x2: np.ndarray
    y2: np.ndarray
    area: np.ndarray


def components_of(ink: np.ndarray, width: np.ndarray, height: np.ndarray) -> Components:
    """Label runs of ink by union-find over runs that touch in neighbouring rows, for all rasters at once.

    ``ink`` are the flat pixels; the work grows with runs and touches, not with
    pixels, but for finding the runs.
    """
    line_width = np.repeat(width, height)  # of every row of every raster
    line_first = np.cumsum(line_width) - line_width
    line_raster = np.repeat(np.arange(len(width)), height)
    begins = ink.astype(bool)
    stops = begins.copy()
    begins[1:] &= ~stops[:-1]
    fresh = line_first[line_first < len(ink)]
    begins[fresh] = ink[fresh] > 0
    start = np.flatnonzero(begins)
    ends = np.r_[stops[:-1] & ~stops[1:], stops[-1:]]
    last = fresh[1:] - 1
    ends[last] = stops[last]
    stop = np.flatnonzero(ends) + 1
    line = np.searchsorted(line_first, start, side="right") - 1
    # The same columns one row down; the last row of a raster has none below.
    below = line + 1 < len(line_raster)
    below[below] = line_raster[line[below] + 1] == line_raster[line[below]]
    upper = np.flatnonzero(below)
    shift = line_width[line[upper]]
    first = np.searchsorted(stop, start[upper] + shift, side="right")
    n = np.maximum(np.searchsorted(start, stop[upper] + shift, side="left") - first, 0)
    a = np.repeat(upper, n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    parent = np.arange(len(start))
    while len(a):
        # Hook the larger root under the smaller, then let every run see its root.
        ra, rb = parent[a], parent[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    roots, label = np.unique(parent, return_inverse=True)
    x1, x2, y = start - line_first[line], stop - 1 - line_first[line], line - (np.cumsum(height) - height)[line_raster[line]]
    k = len(roots)
    out = Components(line_raster[line[roots]], np.full(k, 1 << 60), np.full(k, 1 << 60), np.full(k, -1), np.full(k, -1), np.bincount(label, stop - start, k).astype(np.int64))
    np.minimum.at(out.x1, label, x1)
    np.minimum.at(out.y1, label, y)
    np.maximum.at(out.x2, label, x2)
    np.maximum.at(out.y2, label, y)
    return out


def components(df: DataFrame, raster: str = "raster", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, component (from 0, by first pixel), x1, y1, x2, y2 (inclusive) and area of each component of ink."""

    def each(part: pa.RecordBatch, flat: Flat) -> tuple[np.ndarray, list[pa.Array]]:
        found = components_of(masks(flat)[2], flat.width, flat.height)
        number = np.arange(len(found.own)) - np.searchsorted(found.own, found.own)
        return flat.rows[found.own], [pa.array(v.astype(np.int32)) for v in (number, found.x1, found.y1, found.x2, found.y2)] + [pa.array(found.area)]

    return _map(df, keep, [F.col(raster).alias("__raster")], "component int, x1 int, y1 int, x2 int, y2 int, area long", each)


# --- windows that may hold a character -------------------------------------------------------


def split_points(inked: np.ndarray, edges: np.ndarray) -> list[int]:
    """Proposed cuts of a line: sorted distinct edges, without those that only background parts from the cut before.

    ``inked`` tells the columns that hold ink.  A line without edges is cut at its sides.
    """
    if not len(edges):
        return [0, len(inked) - 1]
    upto = np.r_[0, np.cumsum(inked)]
    cuts: list[int] = []
    for x in np.unique(edges).tolist():
        if not cuts or inked[cuts[-1]] or upto[x + 1] > upto[cuts[-1] + 1]:
            cuts.append(x)
    return cuts


def windows(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, width: int, height: int, symbols: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes of one line's components that may hold one character, in order of proposal, each once.

    Every pair of cuts whose distance is a character's proposes the components
    that reach between them, and then those that these reach.
    """
    inked = np.zeros(width + 1, np.int64)
    np.add.at(inked, x1, 1)
    np.add.at(inked, x2 + 1, -1)
    inked = np.cumsum(inked[:-1]) > 0
    edges = np.minimum(np.r_[x1, x2 + 1, symbols.astype(np.int64)], width - 1)
    cuts = split_points(inked, edges)
    # By column: how far the components over it reach.
    left, right, top, bottom = np.full(width, width), np.full(width, -1), np.full(width, height), np.full(width, -1)
    for i in np.argsort(-x1, kind="stable").tolist():
        left[x1[i] : x2[i] + 1] = x1[i]
    for i in np.argsort(x2, kind="stable").tolist():
        right[x1[i] : x2[i] + 1] = x2[i]
    for i in range(len(x1)):
        span = slice(x1[i], x2[i] + 1)
        np.minimum(top[span], y1[i], out=top[span])
        np.maximum(bottom[span], y2[i], out=bottom[span])
    least, most = max(1, int(height * NARROWEST)), int(height * WIDEST)
    found: dict[tuple[int, int, int, int], None] = {}
    for i, begin in enumerate(cuts[:-1]):
        for end in cuts[i + 1 :]:
            if end - begin + 1 <= least or end - begin + 1 >= most:
                break
            if not inked[begin : end + 1].any():
                continue
            near = slice(int(left[begin : end + 1].min()), int(right[begin : end + 1].max()) + 1)
            found[int(left[near].min()), int(top[near].min()), int(right[near].max()), int(bottom[near].max())] = None
    return list(found)


def character_windows(df: DataFrame, raster: str = "raster", symbols: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, place, x1, y1, x2, y2 and pixels (grey, of the window) of each window of a line raster.

    ``symbols`` may name an array column of further edges, say of a symbol
    detector.  What recognises a window's character is a join or a column of the
    caller; the recognised ones go to ``style.align_characters``.
    """

    def each(part: pa.RecordBatch, flat: Flat) -> tuple[np.ndarray, list[pa.Array]]:
        threshold, light, ink = masks(flat)
        found = components_of(ink, flat.width, flat.height)
        bounds = np.searchsorted(found.own, np.arange(len(flat) + 1))
        ends = np.r_[0, np.cumsum(flat.area)]
        more = part.column("__symbols").to_pylist()
        rows, boxes, pixels = [], [], []
        for i, row in enumerate(flat.rows.tolist()):
            own = slice(bounds[i], bounds[i + 1])
            w, h = int(flat.width[i]), int(flat.height[i])
            image = np.where(ink[ends[i] : ends[i + 1]], 0, 255).astype(np.uint8).reshape(h, w)
            edges = np.array([min(max(int(e), 0), w - 1) for e in more[row] or [] if e is not None], np.int64)
            for place, box in enumerate(windows(found.x1[own], found.y1[own], found.x2[own], found.y2[own], w, h, edges)):
                rows.append(row)
                boxes.append((place, *box))
                pixels.append(image[box[1] : box[3] + 1, box[0] : box[2] + 1].tobytes())
        shown = np.array(boxes, np.int32).reshape(-1, 5)
        return np.array(rows, np.int64), [pa.array(np.ascontiguousarray(shown[:, k])) for k in range(5)] + [pa.array(pixels, pa.binary())]

    edges = F.col(symbols).cast("array<int>") if symbols else F.lit(None).cast("array<int>")
    return _map(df, keep, [F.col(raster).alias("__raster"), edges.alias("__symbols")], "place int, x1 int, y1 int, x2 int, y2 int, pixels binary", each)


# --- boxes on pages --------------------------------------------------------------------------


def fill_box(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> None:
    """Fill a box, grown a little, by the median of a ring around its edge, in place.

    The ring goes a tenth of the box (two pixels at least) to both sides of the
    edge; a box off the image fills nothing.
    """
    high, wide = image.shape[:2]
    dx, dy = (max(RING_PIXELS, int(side * RING_SHARE)) for side in (x2 - x1, y2 - y1))
    near = np.zeros((high, wide), bool)
    near[max(0, y1 - dy) : max(0, min(high, y2 + dy)), max(0, x1 - dx) : max(0, min(wide, x2 + dx))] = True
    top, left = min(y1 + (y2 - y1) // 2, y1 + dy), min(x1 + (x2 - x1) // 2, x1 + dx)
    low, right = max(y1 + (y2 - y1) // 2, y2 - dy), max(x1 + (x2 - x1) // 2, x2 - dx)
    near[max(0, top) : max(0, low), max(0, left) : max(0, right)] = False
    ring = image[near]
    if len(ring):
        image[max(0, y1 - FILL_BEFORE) : max(0, y2 + FILL_AFTER), max(0, x1 - FILL_BEFORE) : max(0, x2 + FILL_AFTER)] = np.median(ring, axis=0).astype(np.uint8)


def grown_right(image: np.ndarray, y1: int, x2: int, y2: int) -> int:
    """The right edge moved on while the next columns are those of the edge, up to the page's margin; boxes off the page stay."""
    high, wide = image.shape[:2]
    if x2 <= 0 or x2 > wide or y1 < 0 or y2 > high or y1 >= y2:
        return x2
    ahead = image[y1:y2, x2 : max(x2, wide - MARGIN + LOOK - 1)]
    other = np.flatnonzero((ahead != image[y1:y2, x2 - 1 : x2]).any(axis=(0, 2)))
    same = int(other[0]) if len(other) else ahead.shape[1]
    return max(x2, min(x2 + same - LOOK + 1, wide - MARGIN))


def _boxed(df: DataFrame, raster: str, boxes: str, keep: tuple[str, ...], made: str, each) -> DataFrame:
    shown = F.transform(F.col(boxes), lambda b: F.struct(*(b[k].cast("int").alias(k) for k in ("x1", "y1", "x2", "y2"))))
    return _map(df, keep, [F.col(raster).alias("__raster"), shown.alias("__boxes")], made, each)


def _whole(boxes: list | None) -> list[tuple[int, int, int, int]]:
    return [tuple(b.values()) for b in boxes or [] if b is not None and None not in b.values()]


def erase_boxes(df: DataFrame, raster: str = "raster", boxes: str = "boxes", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and raster, its boxes filled one after another; boxes that are null or lack a side are skipped."""

    def each(part: pa.RecordBatch, flat: Flat) -> list[pa.Array]:
        lists, out = part.column("__boxes").to_pylist(), []
        for i, row in enumerate(flat.rows.tolist()):
            image = flat.image(i).copy()
            for box in _whole(lists[row]):
                fill_box(image, *box)
            out.append({"width": int(flat.width[i]), "height": int(flat.height[i]), "pixels": image.tobytes()})
        return [_spread(part.num_rows, flat.rows, out, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))]

    return _boxed(df, raster, boxes, keep, f"raster {RASTER}", each)


def extend_boxes(df: DataFrame, raster: str = "raster", boxes: str = "boxes", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and boxes, each with its right edge moved on as far as the page repeats it."""

    def each(part: pa.RecordBatch, flat: Flat) -> list[pa.Array]:
        lists, out = part.column("__boxes").to_pylist(), []
        for i, row in enumerate(flat.rows.tolist()):
            out.append([{"x1": x1, "y1": y1, "x2": grown_right(flat.image(i), y1, x2, y2), "y2": y2} for x1, y1, x2, y2 in _whole(lists[row])])
        return [_spread(part.num_rows, flat.rows, out, pa.list_(pa.struct([(k, pa.int32()) for k in ("x1", "y1", "x2", "y2")])))]

    return _boxed(df, raster, boxes, keep, f"boxes {BOXES}", each)


# --- glyphs ----------------------------------------------------------------------------------


def stacked_distances(ink: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Squared distance of every pixel to the nearest ink of its raster, exactly, in time linear in the pixels (-1 without ink).

    ``ink`` are rasters of one width on top of each other; ``first`` and ``stop``
    say, for every row, where its raster begins and ends.  Down the columns the
    nearest ink comes from two scans.  Along the rows, the lower envelope of the
    parabolas that these distances raise is kept as a stack, for all rows at once.
    """
    high, wide = ink.shape
    rows = np.arange(high)
    far = (stop - first + wide)[:, None]
    above = np.maximum.accumulate(np.where(ink, rows[:, None], -1), axis=0)
    below = np.minimum.accumulate(np.where(ink, rows[:, None], high)[::-1], axis=0)[::-1]
    column = np.minimum(np.where(above >= first[:, None], rows[:, None] - above, far), np.where(below < stop[:, None], below - rows[:, None], far))
    column *= column
    top = np.zeros(high, np.int64)
    # The columns whose parabolas make the envelope, and where each takes over.
    vertex, since = np.zeros((high, wide), np.int32), np.zeros((high, wide), np.int32)
    for x in range(1, wide):
        live = rows
        while len(live):
            v = vertex[live, top[live]].astype(np.int64)
            # The first place at which the new parabola lies under the stack's top.
            place = (x * x - v * v + column[live, x] - column[live, v]) // (2 * (x - v)) + 1
            under = place <= since[live, top[live]]
            push = ~under & (place < wide)
            onto = live[push]
            top[onto] += 1
            vertex[onto, top[onto]], since[onto, top[onto]] = x, place[push]
            live = live[under]
            # What lies under the new one everywhere goes; the first of a row is replaced.
            only = top[live] == 0
            vertex[live[only], 0], since[live[only], 0] = x, 0
            live = live[~only]
            top[live] -= 1
    out = np.empty((high, wide), np.int64)
    for x in range(wide - 1, -1, -1):
        v = vertex[rows, top].astype(np.int64)
        out[:, x] = (x - v) ** 2 + column[rows, v]
        done = (since[rows, top] == x) & (top > 0)
        top[done] -= 1
    has = np.r_[0, np.cumsum(ink.any(axis=1))]
    out[has[stop] == has[first]] = -1
    return out


def squared_distances(ink: np.ndarray) -> np.ndarray:
    """The same of one raster."""
    rows = np.zeros(len(ink), np.int64)
    return stacked_distances(ink, rows, rows + len(ink))


def match_costs(seen: list[np.ndarray], drawn: list[np.ndarray]) -> list[float]:
    """How far drawn glyphs (255 for ink) are from seen ones (0 for ink), pair by pair of one size; all of one width.

    Mean distance of each one's ink, by weight, to the other's, half of the
    95th-percentile distances, and ten times the share of the union that is not
    common.  Distances end at the square root of the area; a side without ink
    costs a million.
    """
    heights = np.array([len(a) for a in seen])
    stops = np.cumsum(heights)
    first, stop = np.repeat(stops - heights, heights), np.repeat(stops, heights)
    far = [stacked_distances(np.vstack(side), first, stop) for side in ([b >= 128 for b in drawn], [a < 128 for a in seen])]
    out = []
    for a, b, end in zip(seen, drawn, stops.tolist(), strict=True):
        most, cost = float(np.sqrt(a.size)), 0.0
        weights = (255 - a.astype(np.float64)) / 255, b.astype(np.float64) / 255
        solid = weights[0] > 0.5, weights[1] > 0.5
        for weight, own, squares in zip(weights, solid, far, strict=True):
            squares = squares[end - len(a) : end]
            distance = np.minimum(np.sqrt(np.where(squares < 0, np.inf, squares)), most)
            total = weight.sum()
            cost += float((distance * weight).sum() / total) if total > 0 else 1e6
            cost += 0.5 * (float(np.percentile(distance[own], 95)) if own.any() else 1e6)
        union = np.logical_or(*solid).sum()
        out.append(cost + 10 * (1 - (float(np.logical_and(*solid).sum() / union) if union else 0.0)))
    return out


def glyph_costs(df: DataFrame, seen: str = "seen", drawn: str = "drawn", keep: tuple[str, ...] = ("block_id", "font")) -> DataFrame:
    """``keep`` columns and cost of every pair of grey rasters; null where sizes differ or a raster is not whole.

    A seen character is joined with the fonts' drawings of it by an equi-join of
    the caller; ``style.merge_fonts`` takes the costs.
    """

    def each(part: pa.RecordBatch, flat: Flat) -> list[pa.Array]:
        other = Flat.read(part.column("__other"))
        place = {row: i for i, row in enumerate(other.rows.tolist())}
        pairs = [(row, flat.image(i), other.image(place[row])) for i, row in enumerate(flat.rows.tolist()) if row in place]
        pairs = sorted((p for p in pairs if p[1].shape == p[2].shape and p[1].shape[2] == 1), key=lambda p: p[1].shape[1])
        out, at = [None] * part.num_rows, 0
        while at < len(pairs):
            # Pairs of one width together, up to some rows of pixels (one pair at least).
            to, rows = at, 0
            while to < len(pairs) and pairs[to][1].shape[1] == pairs[at][1].shape[1] and (to == at or rows + len(pairs[to][1]) <= STACK_ROWS):
                rows, to = rows + len(pairs[to][1]), to + 1
            costs = match_costs([a[:, :, 0] for _, a, _ in pairs[at:to]], [b[:, :, 0] for _, _, b in pairs[at:to]])
            for (row, *_), cost in zip(pairs[at:to], costs, strict=True):
                out[row] = cost
            at = to
        return [pa.array(out, pa.float64())]

    return _map(df, keep, [F.col(seen).alias("__raster"), F.col(drawn).alias("__other")], "cost double", each)
