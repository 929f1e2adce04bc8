"""What the training-data operators share: staged tables, words, batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folio.shared import shared_dir

#: Bytes that separate words; ``bytes.split()`` splits on exactly these.
WORD_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same class as a Java / RE2 / Python pattern.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folio/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, part: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage and survives the loss of executors; the folder's path is
    kept as ``df.staged_path`` for :func:`forget`.  ``part``, the last column,
    makes a folder for each of its values.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path, partitionBy=part)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def forget(df: DataFrame, folder: str = "") -> None:
    """Delete a staged table, or one folder of it, that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{df.staged_path}/{folder}".rstrip("/"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def give_back() -> None:
    """Return memory that earlier tasks of this worker have freed to the system; workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What empties the caches that a worker keeps from task to task; operators that don't use them call it.
CACHES: list[Callable[[], None]] = []


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, keep_caches: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most_bytes`` at most in each (one row at least)."""
    if not keep_caches:
        for empty in CACHES:
            empty()
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        each = max(1, int(most_bytes * batch.num_rows / max(1, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)
