"""Positioned text blocks: derived from plain texts or from parsed pages, and made canonical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import text as T

# Raw labels and their canonical ones, and the label groups that rules use.
LABELS = {
    "doc_title": "document_title",
    "paragraph_title": "section_heading_or_panel_title",
    "text": "paragraph_or_meta",
    "table": "table",
    "chart": "chart",
    "image": "image",
    "vision_footnote": "footnote",
}
TEXT_LIKE = ("document_title", "section_heading", "subheading", "paragraph", "paragraph_or_meta", "section_heading_or_panel_title", "caption_or_panel_title")
META_CANONICAL, META_RAW = ("meta_candidate", "footnote"), ("header", "foot", "fnote", "list", "anno", "vision_footnote")
WIDTH, HEIGHT = 1000, 1400


def derived(documents: DataFrame) -> DataFrame:
    """Ten lines of a text make a synthetic page of blocks, with whole-number boxes and labels by position.

    A stand-in for scanned input: the rule is arithmetic, so any engine derives
    the same blocks.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    index = F.col("pos") % 10 + 1
    label = (
        F.when(F.col("pos") == 0, "doc_title")
        .when((F.col("doc_id") + F.col("pos")) % 11 == 0, "image")
        .when((F.col("doc_id") + F.col("pos")) % 13 == 0, "table")
        .when(index == 10, "vision_footnote")
        .when(F.length("content") <= 40, "paragraph_title")
        .otherwise("text")
    )
    two = F.col("doc_id") % 3 == 0
    x1 = F.when(two & (index % 2 == 0), 520).otherwise(60)
    y1 = 40 + (index - 1) * 130
    return lines.select(
        "doc_id", (F.floor(F.col("pos") / 10) + 1).cast("int").alias("page"), index.cast("int").alias("block_index"), label.alias("raw_label"), "content",
        x1.alias("x1"), y1.cast("int").alias("y1"), (x1 + F.when(two, 420).otherwise(880)).alias("x2"),
        (y1 + F.least(F.lit(110), 20 + F.floor(F.length("content") / 8))).cast("int").alias("y2"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
    )


PARSED_PAGE = "width int, height int, parsing_res_list array<struct<block_bbox:array<int>,block_label:string,block_content:string,block_order:int>>"


def from_parsed_pages(pages: DataFrame) -> DataFrame:
    """Rows (doc_id, page, json) of page-parser output as blocks; absent sizes are 1, absent labels ``unknown``."""
    parsed = pages.select("doc_id", "page", F.from_json("json", PARSED_PAGE).alias("p"))
    rows = parsed.select("doc_id", "page", F.coalesce("p.width", F.lit(1)).alias("width"), F.coalesce("p.height", F.lit(1)).alias("height"), F.posexplode("p.parsing_res_list").alias("pos", "b"))
    box = [F.coalesce(F.get(F.col("b.block_bbox"), F.lit(i)), F.lit(0)).alias(name) for i, name in enumerate(("x1", "y1", "x2", "y2"))]
    return rows.select("doc_id", "page", (F.col("pos") + 1).alias("block_index"), F.coalesce("b.block_label", F.lit("unknown")).alias("raw_label"), F.coalesce("b.block_content", F.lit("")).alias("content"), *box, "width", "height", F.col("b.block_order").alias("given_order"))


def label_of(raw: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(table[raw], F.lit("unknown"))


def is_meta(block_label: Column, raw: Column) -> Column:
    return block_label.isin(*META_CANONICAL) | raw.isin(*META_RAW)


def canonical(blocks: DataFrame, measured: bool = False) -> DataFrame:
    """Cleaned text, canonical label, normalised box, quality, ids and a reading order from 0; ``measured`` adds what quality is made of."""
    given = F.col("given_order") if "given_order" in blocks.columns else F.lit(None).cast("int")
    index = F.col("block_index") - 1
    named = blocks.select(
        "doc_id", "page", "block_index", "raw_label", label_of(F.col("raw_label")).alias("label"), T.clean_text(F.col("content")).alias("text"), "x1", "y1", "x2", "y2", "width", "height",
        *(G.normalised(F.col(c), F.col(size)).alias(n) for c, size, n in (("x1", "width", "n1"), ("y1", "height", "n2"), ("x2", "width", "n3"), ("y2", "height", "n4"))),
        F.concat(F.lit("paddle-"), F.col("doc_id"), F.lit("-"), F.lpad((F.col("page") - 1).cast("string"), 2, "0"), F.lit("-"), index.cast("string")).alias("block_id"),
        F.coalesce(given, index).alias("given"),
    )
    order = Window.partitionBy("doc_id", "page").orderBy("given", "y1", "x1")
    rows = named.withColumn("measures", T.measures(F.col("text"))).withColumn("quality", F.col("measures.quality"))
    rows = rows.withColumn("reading_order", F.row_number().over(order) - 1)
    return rows.drop("given") if measured else rows.drop("given", "measures")
