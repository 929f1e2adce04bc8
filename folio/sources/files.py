"""File sources and sinks: uploads, folders, logs, artifact JSON."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of upload by extension.
IMAGES = ("avif", "bmp", "gif", "heic", "jpeg", "jpg", "png", "tiff", "tif", "webp")
TEXTS = ("md", "txt", "html", "htm", "tex", "svg")
LOG_GROUPS = ("llm", "search", "retrieval", "output")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def classify_upload(path: Column) -> tuple[Column, Column]:
    """Kind of file (pdf, image, text or null) and why it is rejected (or null)."""
    ext = extension(path)
    kind = F.when(ext == "pdf", "pdf").when(ext.isin(*IMAGES), "image").when(ext.isin(*TEXTS), "text")
    reason = F.when(ext == "", "missing name or extension").when(kind == "text", "text files are not supported").when(kind.isNull(), "unknown extension")
    return kind, reason


def uploads(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Files of a folder with kind and reject_reason; contents are read only where selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    kind, reason = classify_upload(F.col("path"))
    return files.select("path", "length", kind.alias("kind"), reason.alias("reject_reason"), "content")


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files directly in a folder, by path."""
    return uploads(spark, folder, "*.[pP][dD][fF]").select("path", "length", "content").orderBy("path")


def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """group, paths of the log files under a folder, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    group = F.regexp_extract("path", f"/({'|'.join(LOG_GROUPS)})/", 1)
    return files.withColumn("group", group).where("`group` <> ''").groupBy("group").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def safe_path(root: str, name: str) -> str:
    """``name`` under ``root``; absolute names and steps out of it are refused."""
    parts = PurePosixPath(name)
    if not name or parts.is_absolute() or ".." in parts.parts or "\\" in name:
        raise ValueError(f"not a path under the root: {name!r}")
    return f"{root.rstrip('/')}/{parts}"


def write_json(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    df.write.mode("append").option("ignoreNullFields", str(not keep_nulls).lower()).json(path)
