"""Image operators against plain versions: pixel by pixel, pair by pair."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import raster as I
from folio.plans import images

SCHEMA = f"doc_id long, raster {I.RASTER}"


def as_raster(image):
    return (image.shape[1], image.shape[0], image.astype(np.uint8).tobytes())


def plain_otsu(values):
    best, level = -1.0, 0
    for t in range(256):
        low, high = values[values <= t].astype(float), values[values > t].astype(float)
        if len(low) and len(high):
            between = len(low) * len(high) * (low.mean() - high.mean()) ** 2
            if between > best * (1 + 1e-12):
                best, level = between, t
    return level


def plain_ink(image):
    threshold = plain_otsu(image.ravel())
    light = image > threshold
    border = np.concatenate([light[:2].ravel(), light[2:-2, :2].ravel(), light[2:-2, -2:].ravel(), light[-2:].ravel()])
    return threshold, light != (np.median(border) >= 0.5)


def flood(ink):
    """(x1, y1, x2, y2, area) of each component, by first pixel, and the label of each pixel."""
    label, out = np.full(ink.shape, -1), []
    for y, x in np.argwhere(ink).tolist():
        if label[y, x] >= 0:
            continue
        todo, pixels = [(y, x)], []
        label[y, x] = len(out)
        while todo:
            a, b = todo.pop()
            pixels.append((a, b))
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < ink.shape[0] and 0 <= d < ink.shape[1] and ink[c, d] and label[c, d] < 0:
                    label[c, d] = len(out)
                    todo.append((c, d))
        ys, xs = zip(*pixels, strict=True)
        out.append((min(xs), min(ys), max(xs), max(ys), len(pixels)))
    return out, label


def test_masks_and_thresholds(spark):
    draw = np.random.default_rng(0)
    pictures = [np.clip(draw.normal(draw.integers(40, 200), 30, draw.integers(1, 12, 2)), 0, 255).astype(np.uint8) for _ in range(30)]
    pictures += [np.full((4, 5), 9, np.uint8), np.zeros((1, 1), np.uint8)]
    rows = [(i, as_raster(p)) for i, p in enumerate(pictures)]
    bad = [(100, None), (101, (3, 3, b"x")), (102, (0, 5, b"")), (103, (None, 2, b"ab")), (104, (2, 2, None))]
    got = {r.doc_id: r for r in I.ink_mask(spark.createDataFrame(rows + bad, SCHEMA)).collect()}
    assert len(got) == len(rows) + 5
    for i, p in enumerate(pictures):
        threshold, ink = plain_ink(p)
        assert (got[i].threshold, got[i].n_ink) == (threshold, ink.sum())
        assert np.array_equal(np.frombuffer(got[i].mask.pixels, np.uint8).reshape(p.shape) == 0, ink)
    assert all(got[i].threshold is None and got[i].mask is None for i, _ in bad)
    assert I.ink_mask(spark.createDataFrame([], SCHEMA)).count() == 0


def test_colours_of_ink(spark):
    draw = np.random.default_rng(1)
    pictures = [draw.integers(0, 256, (6, 7, 3)).astype(np.uint8) for _ in range(8)]
    rows = [(i, (7, 6, p.tobytes())) for i, p in enumerate(pictures)] + [(50, as_raster(np.full((3, 3), 7))), (51, None)]
    got = {r.doc_id: (r.red, r.green, r.blue) for r in I.ink_colours(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, p in enumerate(pictures):
        wide = p.astype(int)
        grey = (4899 * wide[..., 0] + 9617 * wide[..., 1] + 1868 * wide[..., 2] + 8192) >> 14
        ink = plain_ink(grey.astype(np.uint8))[1]
        linear = np.median((p[ink] / 255.0) ** 2.2, axis=0)
        assert got[i] == tuple(int(x) for x in linear ** (1 / 2.2) * 255 + 1e-9)
    assert got[50] == got[51] == (None, None, None)


def test_components_equal_a_flood_fill(spark):
    draw = np.random.default_rng(2)
    pictures = [draw.random(draw.integers(1, 24, 2)) < draw.choice([0.0, 0.2, 0.5, 0.6, 0.9, 1.0]) for _ in range(200)]
    for at in range(0, 200, 8):
        some = pictures[at : at + 8]
        found = I.components_of(np.concatenate([p.ravel() for p in some]).astype(np.uint8), np.array([p.shape[1] for p in some]), np.array([p.shape[0] for p in some]))
        got = [[] for _ in some]
        for own, *box in zip(*(getattr(found, k).tolist() for k in ("own", "x1", "y1", "x2", "y2", "area")), strict=True):
            got[own].append(tuple(box))
        assert got == [flood(p)[0] for p in some]
    rows = [(i, as_raster(np.where(p, 0, 255))) for i, p in enumerate(pictures[:20])] + [(99, None)]
    out = I.components(spark.createDataFrame(rows, SCHEMA)).collect()
    for i, p in enumerate(pictures[:20]):
        ink = plain_ink(np.where(p, 0, 255).astype(np.uint8))[1]
        assert [tuple(r)[2:] for r in sorted((r for r in out if r.doc_id == i), key=lambda r: r.component)] == flood(ink)[0]


def plain_windows(ink):
    high, wide = ink.shape
    boxes, label = flood(ink)
    edges = sorted(min(e, wide - 1) for b in boxes for e in (b[0], b[2] + 1))
    inked = ink.any(axis=0)
    cuts = edges[:1] or [0, wide - 1]
    for x in edges[1:]:
        if x != cuts[-1] and (inked[cuts[-1]] or inked[cuts[-1] + 1 : x + 1].any()):
            cuts.append(x)

    def fit(a, b):
        near = np.unique(label[:, a : b + 1])
        own = [boxes[k] for k in near if k >= 0]
        return (min(c[0] for c in own), min(c[1] for c in own), max(c[2] for c in own), max(c[3] for c in own)) if own else None

    out = []
    for i, a in enumerate(cuts[:-1]):
        for b in cuts[i + 1 :]:
            if b - a + 1 <= max(1, int(high * 0.1)) or b - a + 1 >= int(high * 2):
                break
            if (box := fit(a, b)) and (box := fit(box[0], box[2])) not in out:
                out.append(box)
    return out


def test_windows_equal_labelled_ones():
    draw = np.random.default_rng(3)
    for _ in range(150):
        ink = draw.random((draw.integers(3, 14), draw.integers(1, 40))) < draw.choice([0.05, 0.15, 0.3])
        found = I.components_of(ink.ravel().astype(np.uint8), np.array([ink.shape[1]]), np.array([ink.shape[0]]))
        got = I.windows(found.x1, found.y1, found.x2, found.y2, ink.shape[1], ink.shape[0], np.zeros(0, np.int64))
        assert got == plain_windows(ink)


def test_windows_lead_to_the_text(spark):
    rows = images.char_segments(spark, "/root/testdata/sf0.001").collect()
    texts = {f"b{r.item_id}": "".join(r.text.split()) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    spelt = {k: "".join(r.char for r in sorted((r for r in rows if r.block_id == k), key=lambda r: r.place)) for k in texts}
    assert sum(map(len, spelt.values())) >= 0.99 * sum(map(len, texts.values()))
    assert sum(spelt[k] == t for k, t in texts.items()) >= 0.8 * len(texts)


def test_symbol_edges_add_windows(spark):
    line = np.full((10, 30), 255)
    line[2:8, 3:9] = line[2:8, 14:20] = 0
    df = spark.createDataFrame([(1, as_raster(line), [5, None, 900, -4]), (2, as_raster(line), None), (3, None, [1])], f"{SCHEMA}, symbols array<int>")
    n = {r.doc_id: r.n for r in I.character_windows(df, symbols="symbols").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 3, 2: 3}
    assert {(r.x1, r.y1, r.x2, r.y2) for r in I.character_windows(df).collect()} == {(3, 2, 8, 7), (14, 2, 19, 7), (3, 2, 19, 7)}


def test_filled_and_grown_boxes(spark):
    page = np.full((30, 60), 200)
    page[12:16, 10:30] = 20
    page[0:5, 50:] = 90
    boxes = [(10, 12, 30, 16), None, (0, 0, None, 4), (200, 200, 210, 220)]
    df = spark.createDataFrame([(1, as_raster(page), boxes), (2, None, boxes), (3, as_raster(page), None)], f"{SCHEMA}, boxes {I.BOXES}")
    got = {r.doc_id: r.raster for r in I.erase_boxes(df).collect()}
    filled = np.frombuffer(got[1].pixels, np.uint8).reshape(30, 60)
    assert (filled[10:19, 8:33] == 200).all() and (filled[0:5, 50:] == 90).all()
    assert got[2] is None and np.array_equal(np.frombuffer(got[3].pixels, np.uint8).reshape(30, 60), page)
    grown = {r.doc_id: r.boxes for r in I.extend_boxes(df.withColumn("boxes", F.expr("array(named_struct('x1', 2, 'y1', 5, 'x2', 6, 'y2', 9), named_struct('x1', 2, 'y1', 0, 'x2', 6, 'y2', 4), named_struct('x1', 2, 'y1', 5, 'x2', 99, 'y2', 9))"))).collect()}
    # To the margin; short of the other colour by the look ahead; off the page.
    assert [b.x2 for b in grown[1]] == [52, 47, 99] and grown[2] is None


def plain_grown(image, y1, x2, y2):
    out = x2
    for x in range(x2, image.shape[1] - 8):
        if not (image[y1:y2, x : x + 4] == image[y1:y2, x2 - 1 : x2]).all():
            break
        out = x + 1
    return out


def test_growth_column_by_column():
    draw = np.random.default_rng(5)
    for _ in range(500):
        image = (draw.random((6, 30, 1)) < 0.04).astype(np.uint8)
        x2, y1 = int(draw.integers(1, 31)), int(draw.integers(0, 5))
        assert I.grown_right(image, y1, x2, 6) == plain_grown(image, y1, x2, 6)


def plain_cost(seen, drawn):
    there, away = np.argwhere(seen < 128), np.argwhere(drawn >= 128)
    most = np.sqrt(seen.size)

    def nearest(points):
        y, x = np.mgrid[: seen.shape[0], : seen.shape[1]]
        return np.minimum(np.sqrt(((y[..., None] - points[:, 0]) ** 2 + (x[..., None] - points[:, 1]) ** 2).min(axis=-1)), most) if len(points) else np.full(seen.shape, most)

    a, b = (255 - seen.astype(float)) / 255, drawn.astype(float) / 255
    cost = 0.0
    for weight, distance in ((a, nearest(away)), (b, nearest(there))):
        cost += (weight * distance).sum() / weight.sum() if weight.sum() else 1e6
        cost += 0.5 * (np.percentile(distance[weight > 0.5], 95) if (weight > 0.5).any() else 1e6)
    union = ((a > 0.5) | (b > 0.5)).sum()
    return cost + 10 * (1 - (((a > 0.5) & (b > 0.5)).sum() / union if union else 0))


def test_costs_equal_all_pairs():
    draw, pairs = np.random.default_rng(4), {}
    for k in range(100):
        shape = draw.integers(1, 22, 2)
        if k % 2:
            seen, drawn = draw.integers(0, 256, (2, *shape)).astype(np.uint8)
        else:
            share = draw.choice([0.0, 0.02, 0.3, 1.0], 2)
            seen, drawn = np.where(draw.random(shape) < share[0], 0, 255).astype(np.uint8), np.where(draw.random(shape) < share[1], 255, 0).astype(np.uint8)
        pairs.setdefault(int(shape[1]), []).append((seen, drawn))
    for some in pairs.values():
        seen, drawn = zip(*some, strict=True)
        assert I.match_costs(list(seen), list(drawn)) == pytest.approx([plain_cost(*p) for p in some])


def test_distances_are_exact_and_small_in_memory():
    ink = np.random.default_rng(6).random((500, 500)) < 0.002
    tracemalloc.start()
    found = I.squared_distances(ink)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    points = np.argwhere(ink)
    for y, x in np.random.default_rng(7).integers(0, 500, (300, 2)):
        assert found[y, x] == ((points - (y, x)) ** 2).sum(axis=1).min()
    assert peak < 50e6


def test_glyph_costs_pick_the_font(spark):
    draw = np.random.default_rng(8)
    shapes = {f: np.where(draw.random((12, 9)) < 0.4, 255, 0).astype(np.uint8) for f in ("a", "b", "c")}
    rows = [(f"x{g}", f, as_raster(255 - shapes[g]), as_raster(shapes[f]), 10.0) for g in shapes for f in shapes]
    rows += [("x?", "a", as_raster(shapes["a"]), as_raster(np.zeros((3, 3))), 1.0), ("x?", "b", None, as_raster(shapes["a"]), 1.0)]
    df = spark.createDataFrame(rows, f"block_id string, font string, seen {I.RASTER}, drawn {I.RASTER}, size double")
    from folio.operators import style

    costs = I.glyph_costs(df, keep=("block_id", "font", "size"))
    assert {(r.block_id, r.font) for r in style.merge_fonts(costs).collect()} == {("xa", "a"), ("xb", "b"), ("xc", "c")}
    assert [r.cost for r in costs.where("block_id = 'x?'").collect()] == [None, None]
