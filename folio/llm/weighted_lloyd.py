"""Centroids by Lloyd's rounds over distinct quantised vectors with multiplicities.

Vectors become whole numbers, ``floor(64 * x)`` a component.  Equal ones are
counted and staged once; every round reads the distinct vectors, assigns each to
its nearest centroid and adds up, in whole numbers, members and components times
the multiplicity.  A task emits one row per centroid and component, so a round
shuffles centroids x dimensions x tasks numbers, and the driver sees the
centroids alone.  Sums are exact, so neither the order of rows nor a lost
executor changes a result.

Assignments go back to the vectors by an equi-join.  A vector with more than a
thousandth of all rows (fewer than ``HOT_PARTS`` of them can exist) comes by
broadcast instead, so no copy group meets in one task.

Defined cases: vectors that are null, of another number of components, or with
a null or non-finite one are left out; components beyond ``LIMIT`` (x about two
million) are cut to it, so that distances fit a long; starting centroids are
kept vectors by hash of their id (a null id last; ties by the vector), fewer
where there are fewer rows; ties of distance go to the smaller centroid; a
centroid without members stays; repeated rows count each; columns that aren't
kept play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import staged

LIMIT = 1 << 27
HOT_PARTS = 1000
#: Vectors of an Arrow batch that are compared with all centroids at a time.
BLOCK_ROWS = 8192


def quantised(vector: Column, dims: int, scale: int) -> Column:
    """The whole-number vector, or null where it is not kept."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    cut = lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * scale))).cast("int")
    return F.when((F.size(vector) == dims) & fine, F.transform(vector, cut))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of a tie) and the squared distance, exactly."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    # Sums of up to dims products below 2**53 are exact in doubles.
    kind = np.float64 if 4 * most * most * centroids.shape[1] < 1 << 53 else np.int64
    v, c = vectors.astype(kind), centroids.astype(kind)
    apart = (c * c).sum(axis=1) - 2 * (v @ c.T)
    best = apart.argmin(axis=1)
    return best, ((v * v).sum(axis=1) + apart[np.arange(len(v)), best]).astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _totals(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """centroid, component (-1: the number of members, -2: their distances), total; exact decimals."""
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        k, dims = held.shape
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                vectors, times = _matrix(part.column("q"), dims), part.column("n").to_numpy()
                best, distance = nearest(vectors, held)
                for one in np.unique(best).tolist():
                    own = best == one
                    # Of whole numbers as objects where a long might not hold the sum.
                    safe = int(times[own].sum()) < 1 << 24 and int(np.abs(vectors[own]).max(initial=0)) < 1 << 16
                    n = times[own] if safe else times[own].astype(object)
                    figures = [*(n @ vectors[own]).tolist(), int(n.sum()), int((n * distance[own]).sum())]
                    for component, value in zip([*range(dims), -1, -2], figures, strict=True):
                        sums[one, component] = sums.get((one, component), 0) + int(value)
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([str(sums[x]) for x in keys], pa.string())],
            names=["centroid", "component", "total"],
        )

    made = distinct.mapInArrow(run, "centroid int, component int, total string")
    return made.groupBy("centroid", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _round(distinct: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Members, distances and component sums of the centroids: k x (dims + 2) numbers."""
    return {(r["centroid"], r["component"]): int(r["total"]) for r in _totals(distinct, centroids).collect()}


def _moved(centroids: np.ndarray, sums: dict[tuple[int, int], int]) -> np.ndarray:
    out = centroids.copy()
    for c in range(len(out)):
        if n := sums.get((c, -1), 0):
            out[c] = [sums[c, j] // n for j in range(out.shape[1])]
    return out


def cluster(df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid (its components) of every kept vector."""
    spark = df.sparkSession
    kept = df.select(F.col(key).alias("__key"), quantised(F.col(vector), dims, scale).alias("q")).where("q IS NOT NULL")
    distinct = staged(kept.groupBy("q").agg(F.count("*").alias("n")), "distinct-vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__key").cast("string")), 256)
    first = kept.select(rank.alias("rank"), "q").orderBy(F.asc_nulls_last("rank"), "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(centroids, _round(distinct, centroids))
    sums = _round(distinct, centroids) if len(centroids) else {}
    total = sum(n for (_, j), n in sums.items() if j == -2)
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                best, distance = nearest(_matrix(part.column("q"), dims), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("n"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["q", "n", "cluster", "distance"])

    assigned = distinct.mapInArrow(run, "q array<int>, n long, cluster int, distance long")
    most = max(1, sum(n for (_, j), n in sums.items() if j == -1) // HOT_PARTS)
    hot = F.broadcast(assigned.where(F.col("n") > most).drop("n"))
    often = kept.join(hot, "q").select("__key", "cluster", "distance")
    rare = kept.join(hot.select("q"), "q", "left_anti").join(assigned.where(F.col("n") <= most).drop("n"), "q").select("__key", "cluster", "distance")
    long = lambda x: min(x, (1 << 63) - 1)
    figures = [(c, long(sums.get((c, -2), 0)), long(total), [int(x) for x in row]) for c, row in enumerate(centroids)]
    shown = spark.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return often.unionByName(rare).join(F.broadcast(shown), "cluster").select(F.col("__key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)
