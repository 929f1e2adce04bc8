"""Ingest: files to page images, page images to parsed blocks, artifacts built once.

Renderers and parsers are models that callers pass in; each gets an iterator
of pandas batches, so a model loads once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_IMAGE = "path string, display_order int, width int, height int, image binary"
PARSED = "doc_id long, page int, json string"
DPI = 300
Batches = Iterator[pd.DataFrame]


def page_images(files: DataFrame, render: Callable[[bytes, int], list[tuple[int, int, bytes]]], dpi: int = DPI) -> DataFrame:
    """One row per page of each accepted file, in order from 1; an image file is its own single page.

    ``render`` turns a PDF's bytes into (width, height, png) per page.  A file
    that it can't read gives no rows and does not stop the others.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"], strict=True):
                try:
                    pages = render(content, dpi) if kind == "pdf" else [(0, 0, content)]
                except Exception:  # noqa: BLE001  a broken file fails alone
                    pages = []
                rows += [(path, i, *p) for i, p in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["path", "display_order", "width", "height", "image"])

    return files.where("reject_reason IS NULL").select("path", "kind", "content").mapInPandas(run, PAGE_IMAGE)


def parse_pages(images: DataFrame, load: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """doc_id, page, json: each page image through a parser that ``load`` makes once per task."""

    def run(batches: Batches) -> Batches:
        parser = load()
        for batch in batches:
            yield batch.assign(json=batch["image"].map(lambda x: parser(bytes(x))))[["doc_id", "page", "json"]]

    return images.select("doc_id", "page", "image").mapInPandas(run, PARSED)


def build_missing(wanted: DataFrame, existing: DataFrame, build: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """Build artifacts that are not there yet; what there is stays as it is."""
    return existing.unionByName(build(wanted.join(existing.select(*key), key, "left_anti")))


def centre_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes as centre and size in shares of the page: cx, cy, w, h."""
    c = F.col
    share = lambda value, size: F.round(value / F.greatest(F.lit(1), size), 6)
    return boxes.select("*", share((c("x1") + c("x2")) / 2, c("width")).alias("cx"), share((c("y1") + c("y2")) / 2, c("height")).alias("cy"), share(c("x2") - c("x1"), c("width")).alias("w"), share(c("y2") - c("y1"), c("height")).alias("h"))


def font_css(family: Column, path: Column, base: str = "/api/fonts/") -> Column:
    return F.concat(F.lit("@font-face { font-family: '"), family, F.lit(f"'; src: url('{base}"), F.regexp_extract(path, "([^/]+)$", 1), F.lit("'); }"))
