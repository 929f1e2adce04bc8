"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a few short columns are broadcast up to so many rows, larger ones joined by a shuffle.
FEW_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder; a real cluster
    must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='folio-shared-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, whatever reads it and whoever is lost."""
    path = f"{shared_dir(df.sparkSession)}/folio/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(side: DataFrame) -> DataFrame:
    """Broadcast after a look at its size: rows of a few short columns."""
    return F.broadcast(side) if side.count() <= FEW_ROWS else side
