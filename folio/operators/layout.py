"""Layout analytics over canonical blocks: page metrics, archetypes, sections, style, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import text as T

from .blocks import TEXT_LIKE, is_meta

# Fixed values of the rules.
NOTICES = ("compliance notice", "투자판단", "중요 내용", "중요내용", "유동성공급자", "면책", "notice")
LISTS = ("list", "fnote", "vision_footnote")
SUBSTANTIAL, BODY_CHARS, TITLE_CHARS = 20, 40, 80
COLUMN_GAP, TITLE_GAP, LARGE_VISUAL, LOW_QUALITY, SLOT_AREA = 0.18, 0.03, 0.18, 0.55, 0.03
STYLE = {"body": 0.028, "title": 1.8, "subtitle": 1.3, "paragraph": 0.018, "section": 0.03, "width": 0.52, "line_height": 1.45}
#: Lifts a half that binary fractions put just below it, so that halves round up.
HALF = 1e-9
ANCHORS = ("cover_summary", "body_narrative")
HEADINGS = ("document_title", "section_heading", "subheading")


def _notice(text: Column) -> Column:
    lower, found = F.lower(text), F.lit(False)
    for word in NOTICES:
        found = found | lower.contains(word)
    return found


def page_metrics(blocks: DataFrame) -> DataFrame:
    """One row per page: area ratios, counts, flags, columns, content box and quality."""
    label, raw = F.col("label"), F.col("raw_label")
    ratio = G.area_ratio(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("width"), F.col("height"))
    textual = label.isin(*TEXT_LIKE)
    rows = blocks.select(
        "*", ratio.alias("ratio"), textual.alias("textual"), (textual & (F.length("text") >= SUBSTANTIAL)).alias("substantial"), is_meta(label, raw).alias("meta"),
    )
    page = Window.partitionBy("doc_id", "page")
    # Column positions come from substantial blocks, or from all textual ones on a page that has none.
    rows = rows.withColumn("placed", F.when(F.max("substantial").over(page), F.col("substantial")).otherwise(F.col("textual")))
    gap = F.col("x1") - F.lag("x1").over(Window.partitionBy("doc_id", "page", "placed").orderBy("x1"))
    rows = rows.withColumn("break", (F.col("placed") & (gap > COLUMN_GAP * F.col("width"))).cast("int"))
    total = lambda test: F.round(F.sum(F.when(test, F.col("ratio")).otherwise(0.0)), 4)
    some = lambda test: F.coalesce(F.max(test), F.lit(False))
    own = lambda f, c, otherwise: F.coalesce(f(F.when(~F.col("meta"), F.col(c))), otherwise)
    has_text = F.length("text") > 0
    return rows.groupBy("doc_id", "page").agg(
        F.max("width").alias("width"), F.max("height").alias("height"),
        own(F.min, "x1", F.lit(0)).alias("content_x1"), own(F.min, "y1", F.lit(0)).alias("content_y1"),
        own(F.max, "x2", F.max("width")).alias("content_x2"), own(F.max, "y2", F.max("height")).alias("content_y2"),
        total(label.isin("table", "chart")).alias("table_ratio"), total(label.isin("image", "chart")).alias("visual_ratio"), total(F.col("substantial")).alias("text_ratio"),
        total(F.col("n3") <= G.SIDEBAR).alias("sidebar_ratio"), total(F.col("meta")).alias("meta_ratio"),
        F.least(F.lit(4), F.greatest(F.lit(1), 1 + F.coalesce(F.sum("break"), F.lit(0)))).cast("int").alias("columns"),
        F.round(F.coalesce(F.median(F.when(F.col("substantial"), F.col("quality"))), F.lit(0.75)) + HALF, 4).alias("quality"),
        F.count_if(label == "table").alias("tables"), F.count_if(label == "image").alias("images"), F.count_if(F.col("textual")).alias("text_blocks"), F.count_if(F.col("substantial")).alias("substantial_blocks"),
        F.count_if(F.col("textual") & has_text).alias("filled_text_blocks"), F.count_if(T.financial_signal(F.col("text"))).alias("financial_signals"),
        some(_notice(F.col("text"))).alias("has_notice"), some(raw.isin(*LISTS)).alias("has_list"),
        some((F.col("n3") <= G.SIDEBAR) & (F.col("ratio") >= 0.015) & (F.col("textual") | label.isin("table", "chart", "image"))).alias("left_panel"),
        some((F.col("n1") >= G.BODY) & (F.length("text") >= BODY_CHARS) & F.col("substantial")).alias("main_body"),
        some(has_text & (F.col("n2") >= 0.6) & (raw.isin(*LISTS) | _notice(F.col("text")))).alias("bottom_notice"),
    )


def classify_pages(metrics: DataFrame) -> DataFrame:
    """Archetype, layout pattern and warnings of each page."""
    c = F.col
    archetype = (
        F.when(c("bottom_notice") & (c("has_notice") | c("has_list")), "compliance")
        .when((c("financial_signals") >= 2) & c("left_panel") & c("main_body"), "cover_summary")
        .when((c("tables") >= 3) & (c("text_ratio") < 0.12) & ~c("main_body"), "evidence_table")
        .when((c("table_ratio") >= 0.45) | (c("tables") >= 2) & (c("text_ratio") < 0.08) & (c("visual_ratio") < 0.1), "evidence_table")
        .when((c("text_ratio") >= 0.12) & (c("table_ratio") < 0.35), "body_narrative")
        .when((c("images") >= 3) & (c("text_blocks") >= 2), "body_narrative")
        .otherwise("unknown")
    )
    pattern = F.when(c("columns") >= 3, "multi_column").when(c("columns") == 2, "two_column").when(c("visual_ratio") >= LARGE_VISUAL, "visual_heavy").otherwise("single_column")
    warnings = F.filter(F.array(F.when(c("quality") < LOW_QUALITY, "low_ocr_quality"), F.when(c("substantial_blocks") == 0, "sparse_text")), lambda w: w.isNotNull())
    return metrics.select("*", archetype.alias("archetype"), pattern.alias("pattern"), F.array_join(warnings, ",").alias("warnings"), (c("visual_ratio") >= LARGE_VISUAL).alias("large_visual"))


def document_family(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, family from the first two pages' financial signs, then from tables, text and images of all pages."""
    first = blocks.where("page <= 2").groupBy("doc_id").agg(
        F.count_if(T.financial_signal(F.col("text"))).alias("hits"), F.max(F.col("text").rlike(T.TICKER)).alias("ticker"),
        F.max(F.col("text").contains("목표주가") | F.lower("text").contains("buy")).alias("advice"),
    )
    totals = pages.groupBy("doc_id").agg(F.sum("tables").alias("tables"), F.sum("filled_text_blocks").alias("texts"), F.sum("images").alias("images"), F.max(F.col("archetype").isin(*ANCHORS)).alias("anchored"))
    c = F.col
    family = (
        F.when((c("hits") >= 2) | c("ticker") & c("advice"), "financial_report")
        .when((c("tables") >= 1) & (c("texts") <= 1), "form")
        .when(c("anchored"), "article")
        .when((c("images") >= 3) & (c("texts") >= 1), "article")
        .otherwise("report")
    )
    return totals.join(first, "doc_id", "left").select("doc_id", family.alias("family"))


def page_specs(pages: DataFrame) -> DataFrame:
    c = F.col
    return pages.select(
        "doc_id", "page", "width", "height", "columns", c("content_y1").alias("margin_top"), F.greatest(F.lit(0), c("width") - c("content_x2")).alias("margin_right"),
        F.greatest(F.lit(0), c("height") - c("content_y2")).alias("margin_bottom"), c("content_x1").alias("margin_left"), "large_visual", "pattern",
    )


def anchored(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    return blocks.join(pages.where(F.col("archetype").isin(*ANCHORS)).select("doc_id", "page"), ["doc_id", "page"], "left_semi")


def _role(blocks: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in blocks.columns else F.lit("")


def narrative(blocks: DataFrame) -> DataFrame:
    generic = _role(blocks, "generic_role")
    return blocks.where(
        (F.length("text") > 0)
        & (F.col("label").isin(*TEXT_LIKE) | generic.isin("main_title", "section_heading", "body"))
        & ~generic.isin("metadata", "author_info", "disclaimer", "evidence", "visual")
        & ~F.col("raw_label").isin("header", "foot", "fnote", "anno", "list")
    )


def section_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, section, page, title, blocks: gaps and islands over the narrative blocks of anchor pages."""
    rows = narrative(anchored(blocks, pages))
    in_page = Window.partitionBy("doc_id", "page").orderBy("reading_order")
    in_doc = Window.partitionBy("doc_id").orderBy("page", "reading_order").rowsBetween(Window.unboundedPreceding, 0)
    upper = F.lag("y2").over(in_page)
    rows = rows.withColumn("first", upper.isNull()).withColumn("gap", G.relative_gap(upper, F.col("y1"), F.col("height")))
    named = _role(blocks, "domain_role").isin("report_title", "thesis_heading") | F.col("label").isin(*HEADINGS)
    title = named | (F.length("text") <= TITLE_CHARS) & (F.col("first") | (F.col("gap") >= TITLE_GAP))
    rows = rows.withColumn("titled", F.coalesce(title, F.lit(False))).withColumn("number", F.sum((F.col("titled") | F.col("first")).cast("int")).over(in_doc))
    line = F.split("text", "\n")[0]
    head = F.when(F.col("titled"), F.substring(line, 1, 160)).otherwise(F.substring(line, 1, TITLE_CHARS))
    return rows.groupBy("doc_id", "number").agg(
        F.min("page").alias("page"), F.min_by(head, "reading_order").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "block_id"))), lambda b: b["block_id"]), ",").alias("block_ids"),
    ).select("doc_id", F.concat(F.lit("section-"), F.lpad(F.col("number").cast("string"), 3, "0")).alias("section_id"), "page", "title", "block_ids")


def style_tokens(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document with anchor pages: font scales, gaps, widths and alignment, with defaults."""
    rows = anchored(blocks, pages).withColumn("high", F.greatest(F.lit(0.0), F.col("n4") - F.col("n2"))).withColumn("wide", F.greatest(F.lit(0.0), F.col("n3") - F.col("n1")))
    domain = _role(blocks, "domain_role")
    kind = (
        F.when((domain == "report_title") | (F.col("label") == "document_title"), "title")
        .when((domain == "thesis_heading") | F.col("label").isin("section_heading", "subheading"), "subtitle")
        .when(F.col("label").isin("paragraph", "paragraph_or_meta") & (F.length("text") >= SUBSTANTIAL), "body")
    )
    rows = rows.withColumn("kind", kind).withColumn("side", F.when(F.col("label") == "image", G.alignment(F.col("n1"), F.col("n3"))))
    line = F.when(F.col("kind") == "body", "body").when(F.col("kind").isNotNull(), "heading")
    order = Window.partitionBy("doc_id", "line").orderBy("page", "reading_order")
    rows = rows.withColumn("line", line).withColumn("upper", F.lag("y2").over(order)).withColumn("space", F.when(F.col("upper").isNotNull(), G.relative_gap(F.col("upper"), F.col("y1"), F.col("height"))))
    of = lambda k, c: F.median(F.when(F.col("kind") == k, F.col(c)))
    base = rows.groupBy("doc_id").agg(
        F.coalesce(of("body", "high"), F.lit(STYLE["body"])).alias("body"), of("title", "high").alias("title"), of("subtitle", "high").alias("subtitle"), of("body", "space").alias("paragraph"),
        of("subtitle", "space").alias("section"), of("body", "wide").alias("width"), F.array_join(F.array_sort(F.collect_set("side")), ",").alias("sides"),
    )
    counts = rows.where(F.col("side").isNotNull()).groupBy("doc_id", "side").agg(F.count("*").alias("n"), F.min(F.struct("page", "reading_order")).alias("at"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "at"))).where("r = 1").select("doc_id", F.col("side").alias("top_side"))
    columns = pages.where(F.col("archetype").isin(*ANCHORS)).groupBy("doc_id").agg(F.median("columns").alias("columns"))
    c, default = F.col, lambda name, value: F.coalesce(F.col(name), value)
    body = F.greatest(c("body"), F.lit(0.001))
    return columns.join(base, "doc_id", "left").join(top, "doc_id", "left").select(
        "doc_id", F.round(default("title", c("body") * STYLE["title"]) / body, 4).alias("title_scale"), F.round(default("subtitle", c("body") * STYLE["subtitle"]) / body, 4).alias("subtitle_scale"), F.round("body", 4).alias("body_scale"),
        F.lit(STYLE["line_height"]).alias("line_height"), F.round(default("paragraph", F.lit(STYLE["paragraph"])), 4).alias("paragraph_spacing"), F.round(default("section", F.lit(STYLE["section"])), 4).alias("section_spacing"),
        F.bround("columns").cast("int").alias("columns"), F.round(default("width", F.lit(STYLE["width"])), 4).alias("body_width"), default("top_side", F.lit("center")).alias("alignment"),
        F.coalesce(F.nullif("sides", F.lit("")), F.lit("center")).alias("alignments"),
    )


def image_slots(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    c = F.col
    rows = anchored(blocks, pages).where((c("label") == "image") & (G.area_ratio(c("x1"), c("y1"), c("x2"), c("y2"), c("width"), c("height")) >= SLOT_AREA))
    return rows.select("doc_id", "page", F.concat(F.lit("image-slot-"), c("block_id")).alias("slot_id"), G.alignment(c("n1"), c("n3")).alias("alignment"), F.round(c("n3") - c("n1"), 4).alias("width_ratio"), F.round(c("n4") - c("n2"), 4).alias("height_ratio"))


def unsupported_blocks(blocks: DataFrame) -> DataFrame:
    evidence = F.col("label").isin("table", "chart")
    kind = F.when(evidence, F.col("label")).when(_role(blocks, "generic_role") == "disclaimer", "disclaimer")
    reason = F.when(evidence, "unsupported_for_generation").otherwise("reference_only_non_body_content")
    return blocks.select("doc_id", "page", "block_id", kind.alias("type"), reason.alias("reason")).where(F.col("type").isNotNull())


def repeating_elements(blocks: DataFrame, raw_labels: tuple[str, ...] = ("header", "foot")) -> DataFrame:
    """doc_id, text, times, example: texts in headers and footers that stand twice or more in a document of several pages."""
    text = T.strip(F.col("text"))
    many = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages")).where("n_pages > 1").select("doc_id")
    rows = blocks.where(F.col("raw_label").isin(*raw_labels)).withColumn("shown", text).where(F.length("shown") > 0).join(many, "doc_id", "left_semi")
    found = rows.groupBy("doc_id", F.lower("shown").alias("key")).agg(F.count("*").alias("times"), F.max_by("shown", F.struct("page", "reading_order")).alias("text"), F.max_by("block_id", F.struct("page", "reading_order")).alias("example"))
    return found.where("times >= 2").select("doc_id", "text", "times", "example")


def review_gate(families: DataFrame, pages: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, score, low_pages, unsupported_pages, review_required, notes."""
    low = F.col("quality") < LOW_QUALITY
    per_doc = pages.groupBy("doc_id").agg(
        F.round(F.avg("quality") + HALF, 4).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(low, F.col("page")))), lambda p: p.cast("string")), ",").alias("low_pages"),
        F.count_if(F.col("archetype").isin("evidence_table", "compliance")).alias("unsupported_pages"),
    )
    rows = families.join(per_doc, "doc_id").join(sections.select("doc_id").distinct().withColumn("sectioned", F.lit(True)), "doc_id", "left")
    bad, family = F.length("low_pages") > 0, F.col("family").isin("form", "unknown")
    notes = F.array(F.when(bad, F.concat(F.lit("low_ocr_quality_pages:"), F.col("low_pages"))), F.when(F.col("sectioned").isNull(), "no_narrative_sections_extracted"), F.when(family, "unsupported_for_mvp"))
    return rows.select("doc_id", "family", "score", "low_pages", "unsupported_pages", (bad | family).alias("review_required"), F.array_join(F.filter(notes, lambda n: n.isNotNull()), ";").alias("notes"))


def template(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, template_id, template: family, page specs, sections, style, slots and review of a document as one JSON object."""
    families, sections = document_family(blocks, pages), section_order(blocks, pages)

    def listed(rows: DataFrame, name: str, *order: str) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in rows.columns if c != "doc_id" and c not in order)))).alias(name))

    style = style_tokens(blocks, pages)
    parts = [
        listed(page_specs(pages), "pages", "page"), listed(sections, "sections", "section_id"), listed(image_slots(blocks, pages), "image_slots", "page", "slot_id"), listed(unsupported_blocks(blocks), "unsupported", "page", "block_id"),
        listed(repeating_elements(blocks), "repeating", "text"), style.select("doc_id", F.struct(*(c for c in style.columns if c != "doc_id")).alias("style")), review_gate(families, pages, sections).drop("family"),
    ]
    rows = families
    for part in parts:
        rows = rows.join(part, "doc_id", "left")
    return rows.select("doc_id", F.concat(F.lit("template-"), T.stable_hash(F.col("doc_id").cast("string"), F.col("family"))).alias("template_id"), F.to_json(F.struct(*(c for c in rows.columns if c != "doc_id"))).alias("template"))
