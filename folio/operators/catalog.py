"""Catalog queries: documents, page images, chats, messages and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T

# Fixed values of the model.
COMPLETED = 3
DEPTHS = {"user": 10, "assistant": 50, "system": 60}
LOG_DEPTHS = (60, 70)
VISIBLE_DEPTH = 40
NAME_CHARS, RENAME_CHARS = 32, 64


def document_list(documents: DataFrame, images: DataFrame) -> DataFrame:
    """Documents with their number of page images, newest first."""
    counts = images.groupBy("doc_id").agg(F.count("*").alias("n"))
    return documents.join(counts, "doc_id", "left").select("doc_id", "display_name", F.coalesce("n", F.lit(0)).alias("n_images")).orderBy(F.desc("doc_id"))


def all_exist(documents: DataFrame, ids: list[int]) -> DataFrame:
    """One row: whether as many documents have one of ``ids`` as ``ids`` has entries (a repeated id makes it false)."""
    return documents.where(F.col("doc_id").isin(ids)).agg((F.count("*") == len(ids)).alias("all_exist"))


def all_ready(documents: DataFrame, ids: list[int]) -> DataFrame:
    """One row: whether none of the documents with one of ``ids`` is unfinished."""
    return documents.where(F.col("doc_id").isin(ids)).agg((F.count_if(F.col("process_status") != COMPLETED) == 0).alias("all_ready"))


def page_images(images: DataFrame, files: DataFrame) -> DataFrame:
    """Every page image with its file, numbered from 0 by (display_order, file_id)."""
    order = Window.partitionBy("doc_id").orderBy("display_order", "file_id")
    return images.join(files, "file_id").withColumn("page", F.row_number().over(order) - 1)


def chat_name(query: Column) -> Column:
    return T.strip(F.substring(T.strip(query), 1, NAME_CHARS))


def rename_allowed(name: Column) -> Column:
    return F.length(T.strip(name)).between(1, RENAME_CHARS)


def chat_list(chats: DataFrame) -> DataFrame:
    return chats.select("chat_id", "display_name", F.col("rendered_file_id").isNotNull().alias("has_render")).orderBy(F.desc("chat_id"))


def chat_detail(chats: DataFrame, sources: DataFrame, messages: DataFrame) -> DataFrame:
    """Chats with their sources and ordered messages (a chat's messages are one bounded conversation)."""
    docs = sources.groupBy("chat_id").agg(F.array_sort(F.collect_set("doc_id")).alias("source_ids"))
    talk = messages.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("message_id", "depth", "content_text"))).alias("messages"))
    return chats.join(docs, "chat_id", "left").join(talk, "chat_id", "left")


def append_log(log: Column, message: Column) -> Column:
    return F.concat(log, T.strip(message), F.lit("\n"))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``gone``: delete, and its cascade to child tables."""
    return rows.join(gone.select(key), key, "left_anti")


def message_groups(messages: DataFrame) -> DataFrame:
    """chat_id, group, first_id, n_messages, is_log: log messages that follow each other are one group."""
    order = Window.partitionBy("chat_id").orderBy("message_id")
    rows = messages.withColumn("is_log", F.col("depth").isin(*LOG_DEPTHS))
    rows = rows.withColumn("starts", ~(F.col("is_log") & F.coalesce(F.lag("is_log").over(order), F.lit(False))))
    rows = rows.withColumn("group", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("chat_id", "group").agg(F.min("message_id").alias("first_id"), F.count("*").alias("n_messages"), F.first("is_log").alias("is_log"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``old`` but those that ``new`` replaces, and the rows of ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def split_valid(rows: DataFrame, schema: str, column: str = "content_json") -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON has the schema, parsed, and those whose JSON has not."""
    parsed = rows.withColumn("parsed", F.from_json(column, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("parsed").isNotNull() & F.col("parsed._bad").isNull()
    return parsed.where(ok).drop(column), parsed.where(~F.coalesce(ok, F.lit(False))).drop("parsed")


def missing(documents: DataFrame, artifacts: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, artifact_name of artifacts still to build."""
    wanted = documents.select("doc_id", F.explode(F.array(*map(F.lit, names))).alias("artifact_name"))
    return wanted.join(artifacts.select("doc_id", "artifact_name"), ["doc_id", "artifact_name"], "left_anti")


def clear(artifacts: DataFrame, doc_id: int | None = None, names: list[str] | None = None) -> DataFrame:
    """Artifacts that stay when those of a document, of some names, or both are cleared."""
    gone = F.lit(True)
    if doc_id is not None:
        gone = gone & (F.col("doc_id") == doc_id)
    if names is not None:
        gone = gone & F.col("artifact_name").isin(names)
    return artifacts.where(~gone)


def check_version(config: DataFrame, expected: int, key: str = "schema_version") -> None:
    """Raise if the stored schema version is another one; a store without one is new."""
    row = config.where(F.col("key") == key).select("value").first()
    if row is not None and int(row["value"]) != expected:
        raise ValueError(f"schema version {row['value']}, {expected} is needed: delete the store")


def fetch_page(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """doc_id, page, answer: a page's HTML for each request (doc_id, page from 1), or what is wrong with it."""
    sizes = pages.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    rows = requests.join(sizes, "doc_id", "left").join(pages, ["doc_id", "page"], "left")
    wrong = F.when(F.col("n_pages").isNull(), F.format_string("document %d does not exist", "doc_id")).when(~F.col("page").between(1, F.col("n_pages")), F.format_string("page must be between 1 and %d", "n_pages"))
    return rows.select("doc_id", "page", F.coalesce(wrong, F.col("html"), F.lit("")).alias("answer"))


def overlay(blocks: DataFrame) -> DataFrame:
    """Blocks that have any role, in reading order within their page."""
    roles = [F.col(c) for c in ("generic_role", "domain_role", "generated_role_name") if c in blocks.columns]
    return blocks.where(F.coalesce(*roles).isNotNull()).orderBy("doc_id", "page", F.coalesce("reading_order", F.lit(9999)), "block_id")


def export_chat(messages: DataFrame, trace_depth: int = 70) -> tuple[DataFrame, DataFrame]:
    """Trace lines (value), and one markdown text per chat of all its messages in order."""
    trace = messages.where(F.col("depth") == trace_depth).orderBy("chat_id", "message_id").select(F.col("content_text").alias("value"))
    part = F.concat(F.lit("## "), F.col("message_id"), F.lit(" ("), F.col("depth"), F.lit(")\n\n"), F.coalesce("content_text", F.lit("")), F.lit("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_id", "part"))), lambda m: m["part"]), "\n")
    return trace, messages.withColumn("part", part).groupBy("chat_id").agg(text.alias("markdown"))
