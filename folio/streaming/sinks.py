"""Log sinks that a batch can be sent to twice: event and search logs, and a summary swapped in whole.

Every batch becomes one folder under a name of its own, written aside and moved
into place by one rename, so a reader sees all of a batch or nothing, in both
logs alike; a batch that comes again replaces itself.  The summary is a table of
last values by key, each version a folder moved into place the same way; readers
take the latest.  Nothing passes through the driver but folder names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


LOGS = ("events", "search")
RECORD = "run_id string, time string, ts double, component string, event string, duration_ms double, payload string"
SUMMARY = "key string, value string, at bigint"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _swap_in(spark: SparkSession, made: str, name: str) -> None:
    """Move a finished folder to its name; one that is there goes first, as it holds the same batch."""
    target, files = _files(spark, name)
    files.mkdirs(target.getParent())
    files.delete(target, True)
    if not files.rename(_files(spark, made)[0], target):
        raise OSError(f"{made} can't be moved to {name}")


def _names(spark: SparkSession, folder: str) -> list[str]:
    place, files = _files(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def write_logs(rows: DataFrame, folder: str, batch: int) -> None:
    """Rows of ``trace.recorded`` as JSON lines: all in the event log, those of search components also in the search log."""
    spark = rows.sparkSession
    made = f"{folder}/_making-{uuid.uuid4().hex}"
    logs = F.when(F.col("to_search"), F.array(*map(F.lit, LOGS))).otherwise(F.array(F.lit(LOGS[0])))
    named = rows.select(*(F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in RECORD.split(", ")), F.explode(logs).alias("log"))
    named.write.partitionBy("log").json(made)
    _swap_in(spark, made, f"{folder}/batches/batch={batch:012d}")


def read_log(spark: SparkSession, folder: str, log: str) -> DataFrame:
    """The rows of one log, with the batch that wrote each."""
    return spark.read.schema(f"{RECORD}, batch long, log string").option("basePath", f"{folder}/batches").json(f"{folder}/batches").where(F.col("log") == log).drop("log")


def merge_summary(updates: DataFrame, folder: str, batch: int) -> None:
    """Last values by key (key, value, at) into a new version of the summary; older versions go once it is in place."""
    spark = updates.sparkSession
    versions = [n for n in _names(spark, folder) if n.startswith("version=") and n < f"version={batch:012d}"]
    rows = updates.select("key", "value", "at")
    if versions:
        rows = rows.unionByName(spark.read.schema(SUMMARY).json(f"{folder}/{versions[-1]}"))
    last = rows.groupBy("key").agg(F.max_by(F.struct("value", "at"), F.struct("at", "value")).alias("last")).select("key", "last.value", "last.at")
    made = f"{folder}/_making-{uuid.uuid4().hex}"
    last.write.option("ignoreNullFields", "false").json(made)
    _swap_in(spark, made, f"{folder}/version={batch:012d}")
    # The version before stays, in case this batch is sent again.
    for name in versions[:-1]:
        place, files = _files(spark, f"{folder}/{name}")
        files.delete(place, True)


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    versions = [n for n in _names(spark, folder) if n.startswith("version=")]
    if not versions:
        return spark.createDataFrame([], SUMMARY)
    return spark.read.schema(SUMMARY).json(f"{folder}/{versions[-1]}")


def log_sink(folder: str, record, summary=None):
    """A function for ``foreachBatch``: ``record`` makes log rows of a batch, ``summary`` (key, value, at) updates."""

    def write(batch: DataFrame, number: int) -> None:
        write_logs(record(batch), f"{folder}/logs", number)
        if summary is not None:
            merge_summary(summary(batch), f"{folder}/summary", number)

    return write


