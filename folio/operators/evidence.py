"""Evidence of generated documents: normalised analysis payloads, unsupported blocks, emptied tables."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import markup as M

# Fixed values of the contract with the writer.
STATUSES = ("supported", "partially_supported", "unsupported")
ACTIONS = ("empty_block", "empty_paragraph", "empty_table_values", "empty_cells")
BLOCK_ID = "^(?:target-|output-)?page-([0-9]+)-block-([0-9]+)$"
PAYLOAD = (
    "query string, user_intent string, source_documents array<struct<document_id:string,used:string,reason:string>>, "
    "evidence array<struct<document_id:string,page_id:string,block_id:string,matched_via:string,used_for:string,why_selected:string>>, "
    "writing_strategy string, uncertainties string, "
    "unsupported_blocks array<struct<block_id:string,support_status:string,reason:string,required_action:string,unsupported_selectors:struct<columns:array<string>>>>"
)
EMPTY = "-"


def parsed(payload: Column) -> Column:
    """The payload's JSON; a string where a list is due stays a string (``matched_via``)."""
    return F.from_json(payload, PAYLOAD)


def matched_via(value: Column) -> Column:
    """A JSON list, or a single string, as distinct channels in order."""
    many = F.from_json(value, "array<string>")
    return F.array_distinct(F.filter(F.coalesce(many, F.array(value)), lambda x: F.length(F.trim(x)) > 0))


def evidence(payloads: DataFrame) -> DataFrame:
    """id, at, document_id, page_id, block_id, matched_via, used_for, why_selected; rows need a document and a block."""
    rows = payloads.select("id", F.posexplode(parsed(F.col("payload"))["evidence"]).alias("at", "e"))
    e = F.col("e")
    return rows.where((M.as_text(e["document_id"]) != "") & (M.as_text(e["block_id"]) != "")).select(
        "id", "at", M.as_text(e["document_id"]).alias("document_id"), M.as_int(e["page_id"]).alias("page_id"), M.as_text(e["block_id"]).alias("block_id"),
        F.array_join(matched_via(e["matched_via"]), ",").alias("matched_via"), M.as_text(e["used_for"]).alias("used_for"), M.as_text(e["why_selected"]).alias("why_selected"),
    )


def analysis(payloads: DataFrame) -> DataFrame:
    """id, query (the asked one where the payload has none), user_intent, writing_strategy, uncertainties; a broken payload has only the query."""
    p = parsed(F.col("payload"))
    return payloads.select(
        "id", F.coalesce(F.nullif(M.as_text(p["query"]), F.lit("")), "query").alias("query"), M.as_text(p["user_intent"]).alias("user_intent"),
        M.as_list(p["writing_strategy"]).alias("writing_strategy"), M.as_list(p["uncertainties"]).alias("uncertainties"),
    )


def source_documents(payloads: DataFrame) -> DataFrame:
    """id, at, document_id, used, reason for each requested source in order; the last answer about a source counts."""
    asked = payloads.select("id", F.posexplode("source_ids").alias("at", "document_id"))
    told = payloads.select("id", F.posexplode(parsed(F.col("payload"))["source_documents"]).alias("nth", "s"))
    last = told.groupBy("id", F.trim("s.document_id").alias("document_id")).agg(F.max_by("s", "nth").alias("s"))
    return asked.join(last, ["id", "document_id"], "left").select("id", "at", "document_id", M.as_bool(F.col("s.used")).alias("used"), M.as_text(F.col("s.reason")).alias("reason"))


def unsupported(payloads: DataFrame) -> DataFrame:
    """id, at, block_id, support_status, required_action, columns, reason; ids that name no block are dropped."""
    rows = payloads.select("id", F.posexplode(parsed(F.col("payload"))["unsupported_blocks"]).alias("at", "u"))
    u = F.col("u")
    page, block = (F.regexp_extract(u["block_id"], BLOCK_ID, k) for k in (1, 2))
    return rows.where(u["block_id"].rlike(BLOCK_ID)).select(
        "id", "at", F.concat(F.lit("output-page-"), page, F.lit("-block-"), block).alias("block_id"),
        F.when(u["support_status"].isin(*STATUSES), u["support_status"]).otherwise("unsupported").alias("support_status"),
        F.when(u["required_action"].isin(*ACTIONS), u["required_action"]).otherwise("empty_block").alias("required_action"),
        F.coalesce(u["unsupported_selectors"]["columns"], F.array().cast("array<string>")).alias("columns"), M.as_text(u["reason"]).alias("reason"),
    )


def placements(outputs: DataFrame) -> DataFrame:
    """id, page, block, html: each ``div`` of an output's HTML by the target block it names; the last one wins, those with images don't count."""
    divs = F.regexp_extract_all("html", F.lit('(?is)(<div\\s[^>]*id="(?:target-|output-)?page-[0-9]+-block-[0-9]+"[^>]*>.*?</div>)'), F.lit(1))
    rows = outputs.select("id", F.posexplode(divs).alias("at", "div")).where(~F.col("div").rlike("(?i)<img\\b"))
    number = lambda k: F.regexp_extract("div", 'page-([0-9]+)-block-([0-9]+)"', k).cast("int")
    return rows.groupBy("id", number(1).alias("page"), number(2).alias("block")).agg(F.max_by("div", "at").alias("html"))


_CELL = regex.compile(r"(<t([dh])\b[^>]*>)(.*?)(</t\2>)", regex.I | regex.S)
_ROW = regex.compile(r"<tr\b[^>]*>.*?</tr>", regex.I | regex.S)
_PARAGRAPH = regex.compile(r"(<p\b[^>]*>)(.*?)(</p>)", regex.I | regex.S)


def _table(html: str, columns: list[str] | None) -> str:
    """Empty cells below the first row: all but the first column, or those under the named headers."""
    names: list[str] = []

    def row(m) -> str:
        cells = _CELL.findall(m[0])
        if not names:
            names.extend(regex.sub(r"<[^>]+>", "", c[2]).strip() for c in cells) or names.append("")
            return m[0]
        at = iter(range(len(cells)))

        def cell(c) -> str:
            k = next(at)
            hit = k > 0 if columns is None else k < len(names) and names[k] in columns
            return f"{c[1]}{EMPTY}{c[4]}" if hit else c[0]

        return _CELL.sub(cell, m[0])

    return _ROW.sub(row, html)


def _emptied(html: str, action: str, columns: list[str]) -> str:
    if action == "empty_table_values":
        return _table(html, None)
    if action == "empty_cells":
        return _table(html, columns)
    if action == "empty_paragraph":
        return _PARAGRAPH.sub(r"\1\3", html)
    return regex.sub(r"(?is)^(\s*<div\b[^>]*>).*(</div>\s*)$", r"\1\2", html)


def sanitize(blocks: DataFrame) -> DataFrame:
    """Rows (html, required_action, columns) with ``sanitized`` HTML and ``violates``: whether that changed anything."""

    def run(html: pd.Series, action: pd.Series, columns: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else _emptied(h, a, list(c if c is not None else [])) for h, a, c in zip(html, action, columns, strict=True)], dtype=object)

    clean = F.pandas_udf(run, "string")(F.col("html"), F.col("required_action"), F.col("columns"))
    return blocks.withColumn("sanitized", clean).withColumn("violates", F.col("sanitized") != F.col("html"))
