"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows.

Jaccard distance d = 1 - J is a metric, and two documents link at d <= eps.
Almost all pairs are at distance 1, where no pivot tells them apart, so regions
are seeded by shared rare shingles: with shingles in one global order, two
linked documents share one of their first ``prefix`` shingles (the exact prefix
bound of the threshold).  The smallest document of such a bucket is the pivot
of its region, and a document belongs to the regions of all its buckets'
pivots, so every linked pair meets in a region.

A region is joined exactly.  Documents within eps of the pivot link to it and
need no pairs among themselves.  The others, and the linked ones whose distance
from the pivot lies within eps of one of theirs (the triangle-inequality
window), go to a second round, in which the region is split into Voronoi cells
of pivots of its own, boundary documents are replicated by the windows, and
cells are joined recursively.  Links are exact comparisons of whole sets.

Exact copies (equal sets) are one node.  The global order puts shingles that
many nodes hold last: all shingles are counted in shards, and the most frequent
ones, a bounded number of them, are made known to every task.  Any order gives
the same links; a better one gives smaller buckets.  Components are found by minimum-label propagation
over the links, which are one star per region plus the second round's links.

Defined cases: a null text, an empty one and one without words have an empty
set and link with nothing; a shorter text is one shingle; rows that share an id
count as one document, linked with each other; a row with a null id gets the
component of its exact copies, or null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, give_back, slices, staged
from ._planes import expand, expand_sorted, press, press_sorted, runs
from ._words import shingle_sets

#: The most frequent shingles that every task knows; nodes that hold a shingle for it to count as frequent.
KNOWN, LEAST_FREQUENT = 3_000_000, 3
#: Node tables of up to so many rows are broadcast, larger ones joined by a shuffle.
BROADCAST_NODES = 500_000
#: Shingles of fewer nodes than this are grouped in packed shards, which bounds the group; the others by joins.
HOT = 50_000
SHARD_SHINGLES = 1_000_000
#: Bytes of text whose words are hashed at a time; hashing takes some thirty times as much memory.
SLICE_BYTES = 1 << 20
#: Members of a region that meet one copy of its pivot.
SALT_ROWS = 256
#: Bytes of a broadcast table whose rows differ in size; shingles of the open members that meet in one task.
BROADCAST_BYTES, GROUP_SHINGLES = 32 << 20, 4_000_000


def prefix_length(n: int, percent: int) -> int:
    """Two sets of J >= percent share a shingle among so many first ones of a set of n."""
    return n - -(-n * percent // 100) + 1


def _summaries(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, the size n of its set, and the set's signature s1, s2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text", SLICE_BYTES):
            sets = shingle_sets(part.column("__text"), size)
            signs = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(signs[:, 0]), pa.array(signs[:, 1])], names=["key", "n", "s1", "s2"])

    return df.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text")).mapInArrow(run, "key long, n long, s1 long, s2 long")


class Order:
    """Levels of the known frequent shingles; all others have level 0.

    Shingles are told apart by their first bits only, 32 times as many values
    as there are shingles; a clash moves a shingle back in the order, no more.
    """

    def __init__(self, bits: int, keys: np.ndarray, counts: np.ndarray):
        by = np.argsort(keys)
        self.shift, self.keys, self.counts = np.uint64(64 - bits), keys[by], np.minimum(counts[by], 1 << 30).astype(np.int32)

    def count(self, shingles: np.ndarray) -> np.ndarray:
        """Nodes that hold each shingle where it is a known one, else 0."""
        if not len(self.keys):
            return np.zeros(len(shingles), np.int64)
        keys = shingles >> self.shift
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)


#: Classes of counts: sixteenths of their binary logarithm.
CLASSES = 16 * 64


def count_class(counts: np.ndarray) -> np.ndarray:
    return (16 * np.log2(counts.astype(np.float64))).astype(np.int64)


def _frequent(rows: DataFrame, size: int, total: int) -> Order:
    """Count the shingles of all nodes (key, text) in shards; gather the ``KNOWN`` most frequent at most."""
    bits = min(48, max(24, total.bit_length() + 5))
    shift = np.uint64(64 - bits)
    shards = max(4, -(-total // (2 * SHARD_SHINGLES)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held) >> shift, return_counts=True)
            shard = (keys * np.uint64(shards) >> np.uint64(bits)).astype(np.int64)
            out = [(s, press_sorted(keys[i:j]), press(counts[i:j])) for s, i, j in runs(shard)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "x", "y"])

        held, n = [], 0
        for part in slices(batches, "text", SLICE_BYTES):
            held += [s for s in shingle_sets(part.column("text"), size) if len(s)]
            n = sum(map(len, held))
            if n >= SHARD_SHINGLES:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def add(t: pa.Table) -> pa.Table:
        give_back()
        keys, at = np.unique(np.concatenate([expand_sorted(x) for x in t["x"].to_pylist()]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([expand(x) for x in t["y"].to_pylist()])).astype(np.int64)
        often = counts >= LEAST_FREQUENT
        histogram = np.bincount(count_class(counts[often]), minlength=1)
        return pa.table({"histogram": pa.array([press(histogram)], pa.binary()), "keys": pa.array([press(keys[often])], pa.binary()), "counts": pa.array([press(counts[often])], pa.binary())})

    counted = staged(rows.mapInArrow(send, "shard long, x binary, y binary").groupBy("shard").applyInArrow(add, "histogram binary, keys binary, counts binary"), "frequent")
    histogram = np.zeros(CLASSES + 1, np.int64)
    for row in counted.select("histogram").toLocalIterator():
        part = expand(bytes(row["histogram"])).astype(np.int64)
        histogram[: len(part)] += part
    # The least class from which on there are KNOWN shingles at most.
    least = int(np.argmax(np.cumsum(histogram[::-1])[::-1] <= KNOWN))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys, counts = expand(x), expand(y)
                kept = count_class(counts) >= least
                yield pa.RecordBatch.from_arrays([pa.array([press_sorted(keys[kept])], pa.binary()), pa.array([press(counts[kept])], pa.binary())], names=["x", "y"])

    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for row in counted.select("keys", "counts").mapInArrow(cut, "x binary, y binary").toLocalIterator():
        keys.append(expand_sorted(bytes(row["x"])))
        counts.append(expand(bytes(row["y"])).astype(np.int64))
    forget(counted)
    return Order(bits, np.concatenate(keys), np.concatenate(counts))


def _packed(rows: DataFrame, size: int, percent: int, order: Order, shards: int) -> DataFrame:
    """The first shingles of every node (key, text) in the global order, as packed arrays by shard; hot ones as single rows of shard -1.

    ``band`` is the size class; sets that link are in the same or in neighbouring ones.
    """
    shared = rows.sparkSession.sparkContext.broadcast(order)
    schema = pa.schema([("shard", pa.int64()), ("shingle", pa.int64()), ("node", pa.int64()), ("band", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value

        def flush(held: list) -> Iterator[pa.RecordBatch]:
            shingle, node, band, count = (np.concatenate([h[k] for h in held]) for k in range(4))
            hot = count >= HOT
            if hot.any():
                none = pa.nulls(int(hot.sum()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(none), -1)), pa.array(shingle[hot].view(np.int64)), pa.array(node[hot]), pa.array(band[hot]), none, none, none], schema=schema)
            shingle, node, band = shingle[~hot], node[~hot], band[~hot]
            shard = (shingle % np.uint64(shards)).astype(np.int64)
            by = np.lexsort((shingle, shard))
            shingle, node, band, shard = shingle[by], node[by], band[by], shard[by]
            out = [(s, None, None, None, press_sorted(shingle[i:j]), press(node[i:j]), press(band[i:j])) for s, i, j in runs(shard)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        held, n = [], 0
        for part in slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(part.column("text"), size)
            lengths = np.array([len(s) for s in sets], np.int64)
            counts = np.split(order.count(np.concatenate(sets)), np.cumsum(lengths)[:-1])
            for node, s, c in zip(part.column("key").to_pylist(), sets, counts, strict=True):
                if not len(s):
                    continue
                # Within a level the sorted hashes keep their order.
                first = np.argsort((4 * np.log2(c + 1)).astype(np.int16), kind="stable")[: prefix_length(len(s), percent)]
                held.append((s[first], np.full(len(first), node), np.full(len(first), size_band(len(s), percent)), c[first]))
                n += len(first)
            if n >= SHARD_SHINGLES:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return rows.mapInArrow(run, "shard long, shingle long, node long, band long, x binary, y binary, z binary")


def size_band(n: int, percent: int) -> int:
    """Whole powers of 100 / percent in n: sizes within the threshold's ratio differ by one band at most."""
    return int(np.log(n) / (np.log(100 / percent) + 1e-12) + 1e-9)


def _edges(packed: DataFrame) -> DataFrame:
    """pivot, node: every document with the pivots (smallest nodes) of its buckets."""

    def run(t: pa.Table) -> pa.Table:
        give_back()
        shingle = np.concatenate([expand_sorted(x) for x in t["x"].to_pylist()])
        node, band = (np.concatenate([expand(x) for x in t[c].to_pylist()]).astype(np.int64) for c in "yz")
        # A node stands in its own band and, as a guest, in the next one; a bucket without an own node has no pairs of its own.
        shingle, node, band, guest = np.tile(shingle, 2), np.tile(node, 2), np.r_[band, band + 1], np.repeat([0, 1], len(node))
        order = np.lexsort((node, guest, band, shingle))
        shingle, node, band, guest = shingle[order], node[order], band[order], guest[order]
        first = np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (band[1:] != band[:-1])])
        sizes = np.diff(np.r_[first, len(node)])
        pivot = np.repeat(np.minimum.reduceat(node, first), sizes)
        kept = np.repeat(guest[first] == 0, sizes) & (pivot != node)
        pairs = np.unique(np.stack([pivot[kept], node[kept]], axis=1), axis=0)
        return pa.table({"pivot": pa.array(pairs[:, 0], pa.int64()), "node": pa.array(pairs[:, 1], pa.int64())})

    cold = packed.where("shard >= 0").groupBy("shard").applyInArrow(run, "pivot long, node long")
    rows = packed.where("shard < 0").select("shingle", "node", "band")
    if rows.isEmpty():
        return cold.distinct()
    rows = rows.withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") + F.col("guest"))
    buckets = rows.groupBy("shingle", "band").agg(F.min("node").alias("pivot"), F.count("*").alias("k"), F.min("guest").alias("own")).where("k > 1 AND own = 0").select("shingle", "band", "pivot")
    hot = rows.join(small(buckets), ["shingle", "band"]).where("node <> pivot").select("pivot", "node")
    return cold.unionByName(hot).distinct()


def _sets(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """node and its set as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text", SLICE_BYTES):
            sets = [s.tobytes() for s in shingle_sets(part.column("__text"), size)]
            yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return df.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text")).mapInArrow(run, "node long, shingles binary")


# --- exact joins inside a region ---------------------------------------------


def links_at(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[bool, float]:
    """Whether two sets link, and their Jaccard distance."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return 100 * common >= percent * union, 1 - common / union if union else 0.0


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


LEAF, PIVOTS = 24, 8


def join_region(sets: list[np.ndarray], percent: int, may_pair=None) -> list[tuple[int, int]]:
    """A forest of the links among ``sets``: every linked pair is connected by returned links.

    ``may_pair(i, j)`` may rule out pairs that are compared elsewhere.
    """
    eps, out, forest = 1 - percent / 100 + 1e-9, [], Forest(len(sets))

    def compare(i: int, j: int) -> None:
        small, large = sorted((len(sets[i]), len(sets[j])))
        if 100 * small >= percent * large and forest.find(i) != forest.find(j) and (may_pair is None or may_pair(i, j)) and links_at(sets[i], sets[j], percent)[0]:
            forest.join(i, j)
            out.append((i, j))

    def by_prefix(members: list[int]) -> None:
        seen: dict[int, list[int]] = {}
        for i in sorted(members, key=lambda m: len(sets[m])):
            prefix = sets[i][: prefix_length(len(sets[i]), percent)].tolist()
            for j in dict.fromkeys(j for s in prefix for j in seen.get(s, ())):
                compare(i, j)
            for s in prefix:
                seen.setdefault(s, []).append(i)

    def cells(members: list[int]) -> None:
        if len(members) <= LEAF:
            for at, i in enumerate(members):
                for j in members[:at]:
                    compare(i, j)
            return
        pivots = members[:: -(-len(members) // PIVOTS)]
        d = np.array([[links_at(sets[i], sets[p], percent)[1] for p in pivots] for i in members])
        home = d.argmin(axis=1)
        # x of the cell and y within eps: y's distance to the cell's pivot exceeds that to its own by 2 eps at most.
        inside = d - d.min(axis=1, keepdims=True) <= 2 * eps
        parts = [np.flatnonzero(inside[:, k]) for k in range(len(pivots)) if (home == k).any()]
        if max(map(len, parts)) > 0.7 * len(members):
            by_prefix(members)  # the pivots don't tell these apart
        else:
            for part in parts:
                cells([members[k] for k in part.tolist()])

    cells(list(range(len(sets))))
    return out


# --- the join ------------------------------------------------------------------


def _first_round(own: DataFrame, edges: DataFrame, size: int, percent: int) -> DataFrame:
    """pivot, node, n, d, linked of every member of a region.

    Sets are made from the texts and sent to their regions.  A region is
    streamed: its pivot comes first and only the pivot is held.  Large regions
    are salted, with a copy of the pivot for each salt.
    """
    salts = F.ceil(F.col("k") / SALT_ROWS)
    sizes = edges.groupBy("pivot").agg(F.count("*").alias("k"))
    members = edges.join(sizes, "pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), salts).cast("long").alias("salt"), F.lit(1).alias("own"))
    pivots = sizes.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("own"))
    places = staged(members.unionByName(pivots).groupBy("node").agg(F.collect_list(F.struct("pivot", "salt", "own")).alias("places")), "places")
    held = places.agg(F.sum(32 + 24 * F.size("places"))).first()[0] or 0
    side = F.broadcast(places) if held <= BROADCAST_BYTES else places
    placed = own.join(side.withColumnRenamed("node", "key"), "key")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            sets = [s.tobytes() for s in shingle_sets(part.column("text"), size)]
            rows = [(p["pivot"], p["salt"], p["own"], k, s) for k, s, ps in zip(part.column("key").to_pylist(), sets, part.column("places").to_pylist(), strict=True) for p in ps]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1000], strict=True), types, strict=True)], names=["pivot", "salt", "own", "node", "shingles"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        region, pivot_sets = None, []
        for batch in batches:
            rows = []
            for pivot, salt, own, node, s in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (pivot, salt) != region:
                    region, pivot_sets = (pivot, salt), []
                shingles = np.frombuffer(s, np.uint64)
                if not own:
                    pivot_sets.append(shingles)
                    continue
                found = [links_at(shingles, p, percent) for p in pivot_sets]
                rows.append((pivot, node, len(shingles), min(d for _, d in found), any(x for x, _ in found)))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["pivot", "node", "n", "d", "linked"])

    sent = placed.mapInArrow(send, "pivot long, salt long, own int, node long, shingles binary")
    return sent.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "own").mapInArrow(meet, "pivot long, node long, n long, d double, linked boolean")


def _second_round(own: DataFrame, first: DataFrame, size: int, percent: int, small_region: int = 64) -> DataFrame:
    """Links (a, b) among the members that are not linked to their pivot, and with those in the window.

    Regions of more than ``small_region`` such members are cut into windows of
    the distance from the pivot and of the set's size (its distance from the
    empty set); neighbouring windows overlap by one, and a pair is compared in
    the higher one of its two.  A window of more than ``GROUP_SHINGLES`` is dealt
    to parts, and every two parts meet in a cell of their own, so no task holds
    more than two parts and every pair is still compared.
    """
    eps = 1 - percent / 100
    open_ = first.where(~F.col("linked")).groupBy("pivot").agg(F.min("d").alias("nearest"))
    members = first.join(small(open_), "pivot").where(~F.col("linked") | (F.col("d") >= F.col("nearest") - eps - 1e-9))
    sizes = members.groupBy("pivot").agg(F.count("*").alias("k")).where("k > 1")
    members = staged(members.join(small(sizes), "pivot"), "open-members")
    sets = _sets(_near(own, members.select("node").distinct(), "key"), "key", "text", size)
    wide = F.col("k") > small_region
    ring = F.when(wide, F.floor(F.col("d") / (eps + 1e-9))).otherwise(0)
    band = F.when(wide, F.floor(F.log("n") / float(np.log(100 / percent) + 1e-12))).otherwise(0)
    steps = F.when(wide, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    placed = members.select("pivot", "node", "n", "linked", ring.cast("int").alias("ring"), band.cast("int").alias("band"), steps.alias("steps"))
    placed = placed.withColumn("up", F.explode("steps")).withColumn("over", F.explode("steps"))
    window = ["pivot", "at_ring", "at_band"]
    placed = placed.select("pivot", "node", "n", "linked", "ring", "band", (F.col("ring") + F.col("up")).alias("at_ring"), (F.col("band") + F.col("over")).alias("at_band"))
    loads = placed.groupBy(*window).agg(F.ceil(F.sum("n") / GROUP_SHINGLES).alias("parts")).where("parts > 1")
    placed = placed.join(small(loads), window, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    placed = placed.select("pivot", "node", "linked", "ring", "band", "at_ring", "at_band", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).join(sets, "node")

    def run(t: pa.Table) -> pa.Table:
        node, linked, ring, band, part = (t[c].to_pylist() for c in ("node", "linked", "ring", "band", "part"))
        at = tuple(t[c][0].as_py() for c in ("at_ring", "at_band", "low", "high"))

        def here(i: int, j: int) -> bool:
            return not (linked[i] and linked[j]) and (max(ring[i], ring[j]), max(band[i], band[j]), min(part[i], part[j]), max(part[i], part[j])) == at

        found = join_region([np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()], percent, here)
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.int64()), "b": pa.array([node[j] for _, j in found], pa.int64())})

    return placed.groupBy(*window, "low", "high").applyInArrow(run, "a long, b long")


def small(side: DataFrame) -> DataFrame:
    """Broadcast after a look at its size: rows of a few numbers."""
    return F.broadcast(side) if side.count() <= BROADCAST_NODES else side


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node in ``links`` (a, b): alternating large and small stars."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = staged(small.where("u <> v").distinct(), "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(edges)
        edges = after
        if seen == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = seen


def _near(left: DataFrame, nodes: DataFrame, on: str) -> DataFrame:
    """Rows of ``left`` whose ``on`` is in ``nodes``; broadcast after a look at its size."""
    return left.join(small(nodes.select(F.col("node").alias(on))), on, "left_semi")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Members (key, n, node: the smallest key with the same set) and links (a, b) between nodes.

    The links connect all nodes that are linked, directly or through others;
    pairs that others connect already are not repeated.
    """
    docs = staged(_summaries(df, key, text, size), "sets")
    classes = staged(docs.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("key").alias("node")), "classes")
    nodes = staged(classes.where("node IS NOT NULL").select("node").distinct(), "nodes")
    sums = classes.agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).alias("prefix")).first()
    own = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = _near(own, nodes, "key")
    order = _frequent(rows, size, int(sums["n"] or 0))
    packed = staged(_packed(rows, size, percent, order, max(4, -(-int(sums["prefix"] or 0) // SHARD_SHINGLES))), "prefixes")
    edges = staged(_edges(packed), "edges")
    first = staged(_first_round(own, edges, size, percent), "first-round")
    links = first.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")).unionByName(_second_round(own, first, size, percent))
    links = staged(links, "links")
    members = docs.join(classes.select("s1", "s2", "node"), ["s1", "s2"], "left").select("key", "n", F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("key")).alias("node"))
    for table in (packed, edges, first):
        forget(table)
    return members, links


def classify(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of every row."""
    members, links = join(df, key, text, size, percent)
    found = components(links)
    return members.join(found, "node", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
