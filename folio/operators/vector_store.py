"""A vector store with inverted lists: coarse centroids, every vector in one list, exact ranking of the lists probed.

The coarse centroids are fitted on a bounded sample (``sample_rows``); every
vector, sampled or not, goes to its nearest centroid's list.  The table is laid
out by list and id by range, so a list that holds a third of all vectors lies in
many files.  How many lists a search has to probe is measured on the sample when
the store is built: vectors in clusters take few, vectors without take many.  A
search looks at the lists of the ``probes`` nearest centroids of each query, at nothing but the documents asked for (the scan filters them), and
ranks what it finds by exact distance.  With as many probes as lists it is exact.

Defined cases: a record without an id, without a vector, with one of another
length or with a null, infinite or NaN component goes to the table of failures
with its reason, and fails alone; repeated rows are kept; an empty store gives
empty results; queries that are no whole vectors find nothing; ties go to the
smaller id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.shared import shared_dir

SAMPLE_ROWS = 20_000
#: Rounds of fitting; vectors that are compared at a time; bytes of query vectors that are broadcast.
ROUNDS, BLOCK, BROADCAST_BYTES = 8, 1024, 32 << 20
#: Vectors a list should have about, and lists at most.
LIST_ROWS, MOST_LISTS = 200, 4096
#: Sampled vectors that set how many lists are probed, their neighbours looked at, and the share of these that is to be found.
CALIBRATORS, NEIGHBOURS, RECALL = 200, 10, 0.95


@dataclass
class Store:
    spark: SparkSession
    path: str
    centroids: np.ndarray
    probes: int

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("record_id string, doc_id long, embedding array<double>, list int").parquet(f"{self.path}/vectors")

    @property
    def failures(self) -> DataFrame:
        return self.spark.read.schema("record_id string, doc_id long, reason string").parquet(f"{self.path}/failures")


def _reason(dims: int) -> Column:
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col("record_id").isNull(), "no id").when(v.isNull(), "no vector").when(F.size(v) != dims, "other length").when(bad, "not finite")


def _fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by a few rounds over the sample, from rows spread over it."""
    centroids = sample[np.arange(lists) * len(sample) // lists].copy()
    for _ in range(ROUNDS):
        own = _near(sample, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=lists)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _near(vectors: np.ndarray, centroids: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` nearest centroids of each vector, nearest first."""
    distance = (centroids**2).sum(axis=1) - 2 * vectors @ centroids.T
    return np.argsort(distance, axis=1, kind="stable")[:, :most]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _calibrated(sample: np.ndarray, centroids: np.ndarray) -> int:
    """Lists to probe so that ``RECALL`` of the nearest neighbours of some sampled vectors among all sampled ones lie in them."""
    asked = np.arange(min(CALIBRATORS, len(sample))) * len(sample) // max(1, min(CALIBRATORS, len(sample)))
    distance = (sample**2).sum(axis=1) - 2 * sample[asked] @ sample.T
    distance[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(distance, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(sample) - 1)]
    if not near.size:
        return len(centroids)
    order = _near(sample[asked], centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(asked), axis=0), axis=1)
    rank = np.take_along_axis(place, _near(sample, centroids, 1)[:, 0][near], axis=1)
    return int(np.quantile(rank, RECALL, method="higher")) + 1


def build(records: DataFrame, path: str | None = None, dims: int = 64, lists: int | None = None, sample_rows: int = SAMPLE_ROWS) -> Store:
    """Write records (record_id, doc_id, embedding) as a store; the rows that can't be kept go to its failures."""
    spark = records.sparkSession
    path = path or f"{shared_dir(spark)}/folio/vectors-{uuid.uuid4().hex}"
    rows = records.select(F.col("record_id").cast("string"), F.col("doc_id").cast("long"), F.col("embedding").cast("array<double>")).withColumn("reason", _reason(dims))
    rows.where("reason IS NOT NULL").select("record_id", "doc_id", "reason").write.parquet(f"{path}/failures")
    good = rows.where("reason IS NULL").drop("reason")
    n = good.count()
    lists = max(1, min(lists or n // LIST_ROWS, MOST_LISTS, n))
    share = min(1.0, sample_rows / max(1, n))
    chosen = good.where(F.pmod(F.xxhash64("record_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    # A bounded sample: an id that many rows share can't make it larger.
    sample = np.array([r[0] for r in chosen.select("embedding").limit(2 * sample_rows).collect()] or np.zeros((1, dims)), np.float64).reshape(-1, dims)
    sample = sample[np.lexsort(sample.T[::-1])]
    centroids = _fit(sample, min(lists, len(sample)))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _near(_matrix(batch.column("embedding"), dims), shared.value, 1)[:, 0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=[*batch.schema.names, "list"])

    placed = good.mapInArrow(assign, "record_id string, doc_id long, embedding array<double>, list int")
    placed.repartitionByRange("list", "record_id").write.partitionBy("list").parquet(f"{path}/vectors")
    return Store(spark, path, centroids, _calibrated(sample, centroids))


def _blocks(rows: DataFrame, names: tuple[str, str, str], dims: int) -> DataFrame:
    """Vectors of one list packed together, ``BLOCK`` at most: list, ids and numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for one in np.unique(own).tolist():
                at = np.flatnonzero(own == one)
                for k in range(0, len(at), BLOCK):
                    part = batch.take(pa.array(at[k : k + BLOCK]))
                    data = _matrix(part.column(2), dims).astype("<f8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([part.column(1).to_pylist()], pa.list_(pa.string())), pa.array([data], pa.binary())], names=["list", *names[1:]])

    return rows.mapInArrow(run, f"list int, {names[1]} array<string>, {names[2]} binary")


def search(store: Store, queries: DataFrame, top: int = 10, probes: int | None = None, doc_ids: list[int] | None = None) -> DataFrame:
    """query_id, record_id, distance, rank: the ``top`` records of each query (query_id, vector) by squared distance."""
    dims, probes = store.centroids.shape[1], probes or store.probes
    shared = store.spark.sparkContext.broadcast(store.centroids)
    asked = queries.select(F.col("query_id").cast("string").alias("record_id"), F.col("vector").cast("array<double>").alias("embedding"))
    asked = asked.where(_reason(dims).isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = _near(_matrix(batch.column(1), dims), shared.value, probes)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), lists.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["list", "query_id", "embedding"])

    probed = _blocks(asked.mapInArrow(probe, "list int, query_id string, embedding array<double>"), ("list", "query_ids", "query_data"), dims)
    held = probed.agg(F.sum(F.octet_length("query_data"))).first()[0] or 0
    own = store.vectors if doc_ids is None else store.vectors.where(F.col("doc_id").isin(doc_ids))
    pairs = _blocks(own.select("list", "record_id", "embedding"), ("list", "ids", "data"), dims).join(F.broadcast(probed) if held <= BROADCAST_BYTES else probed, "list")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v, q = (np.frombuffer(row[c], "<f8").reshape(-1, dims) for c in ("data", "query_data"))
                ids = np.array(row["ids"], object)
                by_id = np.argsort(ids.astype(str), kind="stable")
                out: list[tuple] = []
                for name, one in zip(row["query_ids"], q, strict=True):
                    d = np.round(((v - one) ** 2).sum(axis=1), 9)
                    best = by_id[np.argsort(d[by_id], kind="stable")[:top]]
                    out += [(name, ids[i], float(d[i])) for i in best.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)], names=["query_id", "record_id", "distance"])

    found = pairs.mapInArrow(rank, "query_id string, record_id string, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "record_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
