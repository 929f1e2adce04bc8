"""Queries of the image operators over rasters of whole texts, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import raster as I
from folio.operators import style as Y
from folio.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rasters(spark: SparkSession, sf_dir: str, channels: int = 1) -> DataFrame:
    """doc_id and raster of every document's whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", I.from_text(F.col("text"), channels=channels).alias("raster"))


@query
def raster_ink(spark, sf_dir):
    """Threshold, side of the ink and mask of every document's raster."""
    return I.ink_mask(rasters(spark, sf_dir)).select("doc_id", "threshold", "light_ink", "n_ink", F.md5("mask.pixels").alias("mask_md5"))


@query
def raster_colours(spark, sf_dir):
    """Median colour of the ink of every document's raster in three channels."""
    return I.ink_colours(rasters(spark, sf_dir, 3))


@query
def raster_components(spark, sf_dir):
    """Connected components of the ink of every document's raster: how many, the largest, and all boxes."""
    found = I.components(rasters(spark, sf_dir))
    box = F.concat_ws(",", "x1", "y1", "x2", "y2", "area")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("component", box.alias("box")))), lambda r: r["box"]), ";")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("area").alias("largest"), F.sum("area").alias("n_ink"), F.md5(listed).alias("boxes_md5"))


def _box(high: int | None = None):
    """One box a raster, by the document's number; ``high`` rows, or some."""
    d, h = F.col("doc_id"), F.col("raster.height")
    x1, y1 = d % 40, (d * 7) % h
    x2, y2 = (x1 + 5 + d % 17, F.least(h, y1 + 4 + d % 7)) if high is None else (x1 + 1 + d % 5, y1 + high)
    return F.array(F.struct(*(c.cast("int").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2")))))


@query
def raster_erase(spark, sf_dir):
    """Every document's raster with a box filled by the median around its edge."""
    found = I.erase_boxes(rasters(spark, sf_dir).withColumn("boxes", _box()))
    return found.select("doc_id", "raster.height", F.md5("raster.pixels").alias("pixels_md5"))


@query
def raster_extend(spark, sf_dir):
    """A box of one row of every document's mask, moved on while the row repeats its edge."""
    masks = I.ink_mask(rasters(spark, sf_dir)).select("doc_id", F.col("mask").alias("raster"))
    return I.extend_boxes(masks.withColumn("boxes", _box(1))).select("doc_id", F.inline("boxes"))


@query
def glyph_match(spark, sf_dir):
    """Cost of every document's mask against that of the same text in lower case, as a seen and a drawn glyph."""
    docs = table(spark, sf_dir, "documents").select("doc_id", I.from_text(F.col("text")).alias("raster"), I.from_text(F.lower("text")).alias("other"))
    seen = I.ink_mask(docs, keep=("doc_id", "other")).select("doc_id", F.col("mask").alias("seen"), "other")
    drawn = I.ink_mask(seen, "other", keep=("doc_id", "seen"))
    swapped = F.unhex(F.translate(F.hex("mask.pixels"), "0F", "F0"))
    pairs = drawn.select("doc_id", "seen", F.struct("mask.width", "mask.height", swapped.alias("pixels")).alias("drawn"))
    return I.glyph_costs(pairs, keep=("doc_id",)).select("doc_id", F.round("cost", 6).alias("cost"))


@query
def char_segments(spark, sf_dir):
    """Every benchmark text drawn as a line, cut into windows, each recognised by its pixels, and aligned with the text."""
    texts = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("block_id"), "text")
    windows = I.character_windows(texts.withColumn("raster", I.drawn_line(F.col("text"))), keep=("block_id", "text"))
    letters = texts.select(F.explode(F.regexp_extract_all("text", F.lit("\\S"), F.lit(0))).alias("char")).distinct()
    # The recogniser: what each letter looks like alone, the first letter where several look alike.
    known = I.character_windows(letters.withColumn("raster", I.drawn_line(F.col("char"))), keep=("char",)).where("place = 0").groupBy("pixels").agg(F.min("char").alias("char"))
    seen = windows.join(known, "pixels").select("block_id", "text", F.col("x1").alias("xmin"), F.col("x2").alias("xmax"), "char")
    return Y.align_characters(seen)


def _pixels(channels: int = 1) -> str:
    """px(doc_id, h, i, v): the pixels of all rasters of 64 columns."""
    values = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda z: ('0x' || z)::INT)"
    raw = f"""raw AS (SELECT doc_id, h, generate_subscripts(b, 1) - 1 AS i, unnest(b) AS v FROM (
  SELECT doc_id, h, list_concat(b, list_transform(range({64 * channels} * h - len(b)), lambda z: 32)) AS b FROM (
    SELECT doc_id, {values} AS b, greatest(1, ceil(len(b) / {64.0 * channels}))::INT AS h FROM documents)))"""
    if channels == 1:
        return f"{raw}, px AS (SELECT * FROM raw)"
    rgb = "SELECT doc_id, h, i // 3 AS i, max(v) FILTER (i % 3 = 0) AS r, max(v) FILTER (i % 3 = 1) AS g, max(v) FILTER (i % 3 = 2) AS b FROM raw GROUP BY ALL"
    return f"{raw}, rgb AS ({rgb}), px AS (SELECT *, (4899 * r + 9617 * g + 1868 * b + 8192) // 16384 AS v FROM rgb)"


def _ink(channels: int = 1) -> str:
    """ink(doc_id, h, i, ...), with the threshold, whether the background is the light side, and whether a pixel is ink."""
    return f"""{_pixels(channels)}, hist AS (SELECT doc_id, v, count(*) AS n FROM px GROUP BY ALL),
sums AS (SELECT doc_id, v, sum(n) OVER w AS low, sum(n * v) OVER w AS level, sum(n) OVER d AS total, sum(n * v) OVER d AS s FROM hist WINDOW w AS (PARTITION BY doc_id ORDER BY v), d AS (PARTITION BY doc_id)),
cut AS (SELECT doc_id, v AS t FROM (SELECT doc_id, v, (level * total - s * low)::DOUBLE AS a, (low * (total - low))::DOUBLE AS q FROM sums WHERE low < total) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY a * a / q DESC, v) = 1),
lit AS (SELECT px.*, coalesce(t, 0) AS t, v > coalesce(t, 0) AS light, i // 64 AS y, i % 64 AS x FROM px LEFT JOIN cut USING (doc_id)),
edge AS (SELECT doc_id, 2 * sum(k) FILTER (light) >= sum(k) AS bg FROM (SELECT doc_id, light, (y < 2)::INT + (y >= h - 2)::INT + (y >= 2 AND y < h - 2 AND x < 2)::INT + (y >= 2 AND y < h - 2 AND x >= 62)::INT AS k FROM lit) GROUP BY doc_id),
ink AS (SELECT lit.*, coalesce(bg, false) AS bright, light <> coalesce(bg, false) AS ink FROM lit JOIN edge USING (doc_id))"""


def _median(c: str) -> str:
    return f"floor(least(1.0, greatest(0.0, pow(median(pow({c} / 255.0::DOUBLE, 2.2::DOUBLE)) FILTER (ink), 1 / 2.2::DOUBLE))) * 255 + 1e-9)::INT"


ORACLES["raster_ink"] = f"""WITH {_ink()} SELECT doc_id, any_value(t) AS threshold, NOT any_value(bright) AS light_ink, count(*) FILTER (ink) AS n_ink,
  md5(unhex(string_agg(CASE WHEN ink THEN '00' ELSE 'FF' END, '' ORDER BY i))) AS mask_md5 FROM ink GROUP BY doc_id"""
ORACLES["raster_colours"] = f"WITH {_ink(3)} SELECT doc_id, {_median('r')} AS red, {_median('g')} AS green, {_median('b')} AS blue FROM ink GROUP BY doc_id"
ORACLES["raster_erase"] = f"""WITH {_pixels()},
box AS (SELECT *, i // 64 AS y, i % 64 AS x, doc_id % 40 AS x1, (doc_id * 7) % h AS y1, doc_id % 40 + 5 + doc_id % 17 AS x2, least(h, (doc_id * 7) % h + 4 + doc_id % 7) AS y2 FROM px),
near AS (SELECT doc_id, floor(median(v))::INT AS m FROM (SELECT *, greatest(2, (x2 - x1) // 10) AS dx, greatest(2, (y2 - y1) // 10) AS dy FROM box)
  WHERE y >= y1 - dy AND y < y2 + dy AND x >= x1 - dx AND x < x2 + dx AND NOT (y >= least(y1 + (y2 - y1) // 2, y1 + dy) AND y < greatest(y1 + (y2 - y1) // 2, y2 - dy) AND x >= least(x1 + (x2 - x1) // 2, x1 + dx) AND x < greatest(x1 + (x2 - x1) // 2, x2 - dx)) GROUP BY doc_id)
SELECT doc_id, any_value(h) AS height, md5(unhex(string_agg(printf('%02X', CASE WHEN y >= y1 - 2 AND y < y2 + 3 AND x >= x1 - 2 AND x < x2 + 3 THEN m ELSE v END), '' ORDER BY i))) AS pixels_md5 FROM box JOIN near USING (doc_id) GROUP BY doc_id"""
ORACLES["raster_extend"] = f"""WITH {_ink()}, box AS (SELECT doc_id, x, ink, doc_id % 40 AS x1, (doc_id * 7) % h AS y1, doc_id % 40 + 1 + doc_id % 5 AS x2 FROM ink WHERE y = (doc_id * 7) % h),
edge2 AS (SELECT doc_id, ink AS e FROM box WHERE x = x2 - 1),
stop AS (SELECT doc_id, any_value(x1) AS x1, any_value(y1) AS y1, any_value(x2) AS x2, coalesce(min(x) FILTER (x >= x2 AND x < 59 AND ink <> e), greatest(x2, 59)) AS f FROM box JOIN edge2 USING (doc_id) GROUP BY doc_id, x2)
SELECT doc_id, x1::INT AS x1, y1::INT AS y1, greatest(x2, least(f - 3, 56))::INT AS x2, (y1 + 1)::INT AS y2 FROM stop"""
