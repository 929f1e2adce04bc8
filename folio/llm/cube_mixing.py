"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's target is a share of ``total_percent`` of all words by weight,
stopped at ``most_repeats`` times the source's size with the excess reshared.
A document of a source with ratio r = target / size is taken floor(r) times,
and once more with inclusion probability frac(r).  Those extra takes are drawn
by the cube method: probabilities move through the null space of the
constraints (words and documents) until they are 0 or 1, so that both totals of
each block stay at their expectation.

A step moves the largest open document, and others by their size to keep the
totals, so large documents balance one another and are settled first, and what
stays open is small.

Blocks are hash buckets of one source, so a hot source has more blocks, never a
larger one.  Each block leaves two open documents at most; these meet in blocks
of the next level (one in ``FAN_IN`` of the rows), until one block per source is
left.  Its landing suppresses the constraints one by one, documents before
words, and moves on, so that every document keeps its inclusion probability; a
source's words miss their target by one or two of its smallest documents.  All
random numbers come from a hash of the row, so reruns and retried tasks agree.

Defined cases: a null text has size 0; null sources form one source that comes
last; documents of size 0 count in the document totals only; a source of total
size 0 has target 0 and is not taken; repeated rows are separate documents; an
empty table gives an empty result.  Rows without a key are told apart by their
text.  Rows that share key and text are dealt to blocks by their places in the
input where they are more than ``MOST_EQUAL``, so they cost what others do; under
another split of the input such rows may exchange their copies with other rows
of their source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD_PATTERN, staged

SEED = 20_240_601
BLOCK_ROWS = 512
FAN_IN = 256
TINY = 1e-9
#: Equal rows up to which they go to one block.
MOST_EQUAL = 64
#: Source tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...], total_percent: int, most_repeats: int) -> DataFrame:
    """One row per source: size, documents, weight, target and ratio.

    The target is min(most_repeats * size, level * weight); the level is found
    from running sums over sources in the order in which they reach their cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("n_documents"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * most_repeats)
        .withColumn("reach", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * total_percent / 100.0)
    )
    by_reach = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = by_reach.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_reach.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("place", "level"))).over(everything)
    rows = rows.withColumn("place", F.row_number().over(by_reach)).withColumn("level", first["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return rows.withColumn("target", target).withColumn("ratio", ratio).select("source", "source_size", "n_documents", "weight", "target", "ratio")


def _direction(rules: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray | None:
    """Move 1 for document k and the least weighted moves of the others that keep all totals; None if there are none."""
    weight = weight.copy()
    weight[k] = 0.0
    spread = rules * weight
    gram, owed = spread @ rules.T, -rules[:, k]
    if len(rules) == 2:
        (x, y), (_, z) = gram.tolist()
        det = x * z - y * y
        if det <= 1e-12 * x * z:
            factors = np.linalg.lstsq(gram, owed, rcond=1e-9)[0]
        else:
            factors = np.array([z * owed[0] - y * owed[1], x * owed[1] - y * owed[0]]) / det
    else:
        factors = np.linalg.lstsq(gram, owed, rcond=1e-9)[0]
    move = factors @ spread
    move[k] = 1.0
    return move if np.abs(rules @ move).max(initial=0.0) < 1e-9 else None


def flight(chance: np.ndarray, size: np.ndarray, draws: np.random.Generator, constraints: int = 2) -> np.ndarray:
    """Move probabilities through the null space of the first ``constraints`` of (size, 1) until it has no direction left."""
    p = np.where(chance < TINY, 0.0, np.where(chance > 1 - TINY, 1.0, chance))
    scaled = size / max(1.0, float(size.max(initial=0)))
    rules = np.stack([scaled, np.ones(len(p))])[:constraints]
    open_ = np.flatnonzero((p > 0) & (p < 1))
    open_ = open_[np.argsort(-size[open_], kind="stable")]
    while len(open_):
        # Others move by their size, so that small documents wait until they are needed.
        tries = (_direction(rules[:, open_], scaled[open_] + TINY, k) for k in range(min(len(open_), constraints + 1)))
        move = next((m for m in tries if m is not None), None)
        if move is None:
            break
        move[np.abs(move) < 1e-12] = 0.0
        own = p[open_]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(move > 0, (1 - own) / move, np.where(move < 0, own / -move, np.inf)).min()
            down = np.where(move > 0, own / move, np.where(move < 0, (1 - own) / -move, np.inf)).min()
        own = own + (up if draws.uniform() * (up + down) < down else -down) * move
        own[own < TINY] = 0.0
        own[own > 1 - TINY] = 1.0
        if ((own > 0) & (own < 1)).all():  # rounding left all open: close the nearest
            k = int(np.minimum(own, 1 - own).argmin())
            own[k] = round(own[k])
        p[open_] = own
        open_ = open_[(own > 0) & (own < 1)]
    return p


def land(chance: np.ndarray, size: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Settle what the flight leaves: the document total goes first, then the words."""
    for constraints in (1, 0):
        chance = flight(chance, size, draws, constraints)
    return chance


def _balance(df: DataFrame, fan_in: int, last: bool) -> DataFrame:
    """One level: the cube's flight in each (source, block), with the landing at the last level."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort((t["size"].to_numpy(), t["__hash"].to_numpy()))))
        size = t["size"].to_numpy()
        draws = np.random.default_rng(t["__hash"].to_numpy()[:4].view(np.uint64))
        p = flight(t["__chance"].to_numpy(), size, draws)
        if last:
            p = land(p, size, draws)
        return t.set_column(t.schema.get_field_index("__chance"), "__chance", pa.array(p, pa.float64()))

    block = F.pmod(F.floor(F.col("__block") / fan_in), F.lit(1 << 62))
    return df.withColumn("__block", block.cast("long")).groupBy("source", "__block").applyInArrow(run, df.schema)


def mix(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    keep: tuple[str, ...] = ("doc_id",),
    weights: tuple[int, ...] = (5, 2, 1),
    total_percent: int = 150,
    most_repeats: int = 2,
    key: str = "doc_id",
    copies: str = "copies",
) -> DataFrame:
    """``keep`` columns, size, source, source_size, target, ratio and ``copies`` of every row.

    A ``keep`` column of the same name as one of these stands instead of it.

    Sources weigh ``weights``, repeating, by code point of their name, null last.
    """
    row = F.xxhash64(F.lit(SEED), F.col(key), F.col(text))
    # Rows that are equal and many would share a block; their places tell them apart, and only theirs.
    often = staged(df.groupBy(row.alias("__often")).agg(F.count("*").alias("__n")).where(F.col("__n") > MOST_EQUAL).select("__often"), "mix-often")
    base = df.select(*(F.col(k).alias(f"k_{k}") for k in keep), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), row.alias("__hash"), F.monotonically_increasing_id().alias("__at"))
    per_source = staged(targets(base, weights, total_percent, most_repeats), "mix-targets")
    sized = base.join(F.broadcast(often) if often.count() <= BROADCAST_SOURCES else often, F.col("__hash") == F.col("__often"), "left")
    sized = sized.withColumn("__salt", F.when(F.col("__often").isNotNull(), F.col("__at")).otherwise(F.lit(0))).drop("__often", "__at")
    seen = per_source.agg(F.count("*").alias("n"), F.max("n_documents").alias("most")).first()
    small = F.broadcast(per_source) if seen["n"] <= BROADCAST_SOURCES else per_source
    per = small.withColumn("__blocks", F.ceil(F.col("n_documents") / BLOCK_ROWS)).withColumnRenamed("source", "__source").drop("weight", "n_documents")
    rows = sized.join(per, sized["source"].eqNullSafe(per["__source"]), "left").drop("__source")
    chance = F.col("ratio") - F.floor("ratio")
    rows = rows.withColumn("__block", F.pmod(F.xxhash64("__hash", "__salt"), F.col("__blocks"))).withColumn("__chance", chance).drop("__salt")
    blocks = -(-(seen["most"] or 0) // BLOCK_ROWS)
    done = None
    level = _balance(rows, 1, blocks <= 1)
    while blocks > 1:
        level = staged(level, "mix-level")
        closed = level.where(F.col("__chance").isin(0.0, 1.0))
        done = closed if done is None else done.unionByName(closed)
        blocks = -(-blocks // FAN_IN)
        level = _balance(level.where(~F.col("__chance").isin(0.0, 1.0)), FAN_IN, blocks <= 1)
    done = level if done is None else done.unionByName(level)
    made = {"size": F.col("size"), "source": F.col("source"), "source_size": F.col("source_size"), "target": F.col("target"), "ratio": F.col("ratio"), copies: (F.floor("ratio") + F.col("__chance")).cast("long")}
    return done.select(*(F.col(f"k_{k}").alias(k) for k in keep), *(c.alias(name) for name, c in made.items() if name not in keep))
