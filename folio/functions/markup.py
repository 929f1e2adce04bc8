"""HTML and JSON text: structured blocks out of pages, objects and documents out of answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

IMAGES, TABLES = ("image", "chart"), ("table",)
SCALE = 1000
FENCE = "(?is)^```(?:json)?\\s*(.*?)\\s*```$"
DOCUMENT, PAGE = "(?is)(<document\\b[^>]*>.*?</document>)", "(?is)(<page\\b[^>]*>.*?</page>)"
OPEN_DOCUMENT = "(?i)<document\\b[^>]*>"
DOCUMENT_KEYS = ("document", "output", "content", "html")
TRUE_WORDS = ("true", "1", "yes")
NUMBER = "^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def paragraphs(text: Column) -> Column:
    lines = F.split(T.strip(text), "[\\r\\n]+")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  <p>"), escape(x), F.lit("</p>"))), "\n")


def block_html(block_id: Column, raw_label: Column, content: Column, x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """A ``div`` with the box in thousandths of the page and the content by kind of block."""
    box = F.concat_ws(", ", *(F.floor(v * SCALE / size).cast("string") for v, size in ((x1, width), (y1, height), (x2, width), (y2, height))))
    image = F.concat(F.lit('  <img src="/'), block_id, F.lit('/image">'))
    inner = F.when(raw_label.isin(*IMAGES), image).when(raw_label.isin(*TABLES), F.concat(F.lit("  "), content)).otherwise(paragraphs(content))
    return F.concat(F.lit('<div id="'), block_id, F.lit('" data-bbox="['), box, F.lit(']">\n'), inner, F.lit("\n</div>"))


def page_html(page_id: Column, ordered_blocks: Column) -> Column:
    """A page from its blocks' HTML in order."""
    return F.concat(F.lit('<page id="'), page_id, F.lit('">\n'), F.array_join(ordered_blocks, "\n"), F.lit("\n</page>"))


def json_text(answer: Column) -> Column:
    """The JSON part of an answer without its thoughts: a fenced object, or from the first brace to the last; else null."""
    plain = T.strip(F.regexp_replace(F.coalesce(answer, F.lit("")), "(?is)<think>.*?</think>", ""))
    fenced = F.regexp_extract(plain, "(?s)^```(?:json)?\\s*(\\{.*\\})\\s*```$", 1)
    braces = F.regexp_extract(plain, "(?s)(\\{.*\\})", 1)
    return F.when(fenced != "", T.strip(fenced)).when(braces != "", braces)


def _find_object(text: str | None, whole: bool) -> str | None:
    if text is None:
        return None
    text = text.strip()
    if (m := regex.match(FENCE, text)) is not None:
        text = m[1].strip()
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            found, end = decoder.raw_decode(text, at)
        except (json.JSONDecodeError, RecursionError):
            found, end = None, -1
        if isinstance(found, dict) and (not whole or end == len(text)):
            return json.dumps(found, ensure_ascii=False, sort_keys=True)
        at = text.find("{", at + 1)
    return None


def _series(f: Callable[[str | None], str | None]):
    """A pandas UDF over strings; a scanner has no form in built-in functions."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return F.pandas_udf(run, "string")


def json_object(text: Column, whole: bool = False) -> Column:
    """The first JSON object in a text (``whole``: it must end where the text ends), as JSON; else null."""
    return _series(lambda x: _find_object(x, whole))(text)


def _find_document(text: str) -> str | None:
    """What ``document_block`` gives where a text has no closed document: down into JSON answers, then what is left open, then pages."""
    if closed := re.search(DOCUMENT, text):
        return closed[1]
    payload = _find_object(text, False)
    for key in DOCUMENT_KEYS if payload else ():
        inner = json.loads(payload).get(key)
        if isinstance(inner, str) and inner.strip() and (found := _find_document(inner)) is not None:
            return found
    if opened := re.search(OPEN_DOCUMENT, text):
        return text[opened.start() :] + "</document>"
    pages = re.findall(PAGE, text)
    return '<document id="output">\n' + "\n".join(pages) + "\n</document>" if pages else None


def document_block(text: Column) -> Column:
    """The first ``<document>``; else that in a JSON answer, at any depth; else an open one up to the end; else one around the pages; else null."""
    plain = F.nullif(F.regexp_extract(text, DOCUMENT, 1), F.lit(""))
    # Only texts without a document of their own go to the scanner.
    return F.coalesce(plain, _series(_find_document)(F.when(plain.isNull(), text)))


def as_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(*TRUE_WORDS), F.lit(False))


def as_int(value: Column) -> Column:
    return F.coalesce(F.trim(value).try_cast("int"), F.lit(0))


def as_float(value: Column) -> Column:
    return F.coalesce(F.when(value.rlike(NUMBER), F.trim(value).try_cast("double")), F.lit(0.0))


def as_text(value: Column) -> Column:
    return F.coalesce(T.strip(value), F.lit(""))


def as_list(value: Column) -> Column:
    """The trimmed, non-empty items of a JSON list; anything else is an empty list."""
    items = F.filter(F.transform(F.from_json(value, "array<string>"), as_text), lambda x: F.length(x) > 0)
    return F.coalesce(F.when(F.ltrim(value).startswith("["), items), F.array().cast("array<string>"))


def as_box(value: Column) -> Column:
    """The first four items of a JSON list as whole numbers, cut towards zero; null if there are fewer or one is no number."""
    items = F.slice(F.from_json(value, "array<string>"), 1, 4)
    fits = F.ltrim(value).startswith("[") & (F.size(items) == 4) & F.forall(items, lambda x: F.coalesce(x.rlike(NUMBER), F.lit(False)))
    return F.when(fits, F.transform(items, lambda x: F.trim(x).try_cast("double").cast("long")))


def shown(value: Column, kind: str) -> Column:
    """A value of the Spark type ``kind`` as a report prints it; null, empty texts and empty lists are a dash."""
    if kind == "boolean":
        text = F.when(value, "Yes").otherwise("No")
    elif kind in ("float", "double"):
        text = F.regexp_replace(F.format_string("%.4f", value), "\\.?0+$", "")
    elif kind.startswith("array"):
        text = F.array_join(value, ", ", "None")
    elif kind.startswith(("struct", "map")):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.when(value.isNull() | (text == ""), "-").otherwise(text)


def image_uri(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))
