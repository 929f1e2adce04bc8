"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate.  Its spread is the number of
distinct sites of the documents that hold it, estimated by a HyperLogLog sketch
per line hash; sketches merge in the aggregation, so a line that fills a third
of all rows costs one sketch per task.  Where the estimate lies within the
sketch's error of the threshold, the distinct sites are counted exactly.  Lines
at or over the threshold are removed everywhere but at their first place (the
smallest id, null last, then the smallest text hash, then the smallest position).

With ``spare_copies`` a document that is as a whole a near copy of an earlier
one stays as it is, for a stage that removes copies: the lines whose first place
is in one earlier document make up 8/9 or more of its characters and of that
document's, so that the two share 80% of their characters or more.

Up to ``BROADCAST_LINES`` boilerplate lines are sent to all tasks, bounded in
bytes by their number, and texts are cut where they stand: only arrays of line
hashes go to a vectorised function.  Beyond that, hashes are joined and texts
meet the list of positions to cut by a shuffle.

Defined cases: a null text stays null with 0 lines; blank lines are neither
counted nor removed; a null site is no site; equal lines in one document count
one site; rows that share an id, or have none, but not a text are documents of
their own, and rows that repeat both are treated alike; an input column named as
one of the counts is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import staged

LG_K = 12
#: Relative band of the exact count: four standard errors of a sketch of 2**12 registers.
BAND = 4 * 1.04 / 2 ** (LG_K / 2)
BROADCAST_LINES = 100_000
HAS_WORD = "[^\\x20\\x09-\\x0D]"


#: A copy shares so much of both texts' characters that their similarity is 0.8 or more.
COPY_SHARE = 8 / 9


def _lines(df: DataFrame, key: str, text: str, site: str) -> DataFrame:
    lines = df.select(F.col(key).alias("__key"), F.col(site).cast("string").alias("__site"), F.xxhash64(text).alias("__text"), F.length(text).alias("__length"), F.posexplode(F.split(F.col(text), "\n")).alias("__pos", "__line"))
    return lines.where(F.col("__line").rlike(HAS_WORD)).select("__key", "__site", "__text", "__length", "__pos", F.length("__line").alias("__chars"), F.xxhash64("__line").alias("__h1"), F.xxhash64(F.lit(7), "__line").alias("__h2"))


def boilerplate(df: DataFrame, least_sites: int, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """Staged hashes of the lines on ``least_sites`` or more sites, with their first place."""
    lines = _lines(df, key, text, site)
    sketched = staged(
        lines.groupBy("__h1", "__h2")
        .agg(F.hll_sketch_agg("__site", LG_K).alias("sketch"), F.min(F.struct(F.col("__key").isNull().alias("none"), "__key", "__text", "__pos", "__length")).alias("first"), F.count("*").alias("n"))
        .where(F.col("n") >= least_sites)
        .select("__h1", "__h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= least_sites * (1 - BAND) - 1),
        "line-sketches",
    )
    sure = F.col("sites") > least_sites * (1 + BAND) + 1
    near = sketched.where(~sure)
    counted = lines.join(_small(near.select("__h1", "__h2")), ["__h1", "__h2"], "left_semi").select("__h1", "__h2", "__site").distinct().groupBy("__h1", "__h2").agg(F.count("__site").alias("exact")).where(F.col("exact") >= least_sites)
    exact = near.join(counted, ["__h1", "__h2"], "left_semi")
    return staged(sketched.where(sure).unionByName(exact).select("__h1", "__h2", "first"), "line-boilerplate")


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= BROADCAST_LINES else side


def _cut(text: Column, cuts: Column) -> Column:
    """``text`` without the lines at the sorted places ``cuts``, in time linear in both."""
    kept = F.transform(cuts, lambda c, i: F.concat(F.array_repeat(F.lit(True), c - F.when(i > 0, F.get(cuts, i - 1)).otherwise(-1) - 1), F.array(F.lit(False))))
    # Lines behind the last cut have no partner, and null lines are not joined.
    return F.array_join(F.zip_with(F.split(text, "\n"), F.flatten(kept), lambda line, k: F.when(F.coalesce(k, F.lit(True)), line)), "\n")


def _cuts_in_place(df: DataFrame, found: DataFrame, spare_copies: bool, key: str, text: str) -> DataFrame:
    """``df`` with ``__cuts``, from a map of the boilerplate lines that every task has."""
    rows = found.select("__h1", "__h2", F.col("first.__key").cast("string").alias("key"), F.col("first.__text").alias("text"), F.col("first.__pos").alias("pos"), F.col("first.__length").alias("length")).collect()  # BROADCAST_LINES at most
    known = {(r["__h1"], r["__h2"]): ((r["key"], r["text"]), r["pos"], r["length"]) for r in rows}
    shared = df.sparkSession.sparkContext.broadcast((np.sort(np.array([h for h, _ in known], np.int64)), known))

    def cuts(keys: pd.Series, texts: pd.Series, lengths: pd.Series, h1: pd.Series, h2: pd.Series, chars: pd.Series) -> pd.Series:
        firsts, held = shared.value
        out = [None] * len(keys)
        some = [i for i, x in enumerate(h1) if x is not None]
        if not some or not len(firsts):
            return pd.Series(out, dtype=object)
        counts = np.array([len(h1[i]) for i in some])
        flat = np.concatenate([h1[i] for i in some])
        hit = firsts[np.minimum(np.searchsorted(firsts, flat), len(firsts) - 1)] == flat
        for i, where in zip(some, np.split(hit, np.cumsum(counts)[:-1]), strict=True):
            own, shared_with = [], {}
            for pos in np.flatnonzero(where).tolist():
                place, n = held.get((int(h1[i][pos]), int(h2[i][pos]))), int(chars[i][pos])
                if place is not None and n and place[:2] != ((keys[i], texts[i]), pos):
                    own.append(pos)
                    shared_with[place[0], place[2]] = shared_with.get((place[0], place[2]), 0) + n
            copied = spare_copies and any(n >= COPY_SHARE * max(lengths[i], other) for (_, other), n in shared_with.items())
            out[i] = own if own and not copied else None
        return pd.Series(out, dtype=object)

    lines = F.split(F.col(text), "\n")
    each = (F.transform(lines, lambda x: F.xxhash64(x)), F.transform(lines, lambda x: F.xxhash64(F.lit(7), x)), F.transform(lines, lambda x: F.when(x.rlike(HAS_WORD), F.length(x)).otherwise(0)))
    return df.withColumn("__cuts", F.pandas_udf(cuts, "array<int>")(F.col(key).cast("string"), F.xxhash64(text), F.length(text), *each))


def _cuts_joined(df: DataFrame, found: DataFrame, spare_copies: bool, key: str, text: str, site: str) -> DataFrame:
    """``df`` with ``__cuts``, by joins on line hashes and on the texts' hashes."""
    hits = _lines(df, key, text, site).join(found, ["__h1", "__h2"])
    hits = hits.where(~F.struct("__key", "__text", "__pos").eqNullSafe(F.struct("first.__key", "first.__text", "first.__pos")))
    # Rows that repeat an id and a text give each position several times.
    by_first = hits.groupBy("__key", "__text", "__length", F.col("first.__key").alias("__f_key"), F.col("first.__text").alias("__f_text"), F.col("first.__length").alias("__f_length")).agg(F.collect_set(F.struct("__pos", "__chars")).alias("__own"))
    chars = F.aggregate("__own", F.lit(0), lambda n, x: n + x["__chars"])
    copied = chars >= COPY_SHARE * F.greatest("__length", "__f_length")
    cuts = by_first.select("__key", "__text", F.transform("__own", lambda x: x["__pos"]).alias("__some"), copied.alias("__copied"))
    cuts = cuts.groupBy("__key", "__text").agg(F.array_sort(F.flatten(F.collect_list("__some"))).alias("__cuts"), F.max("__copied").alias("__copied"))
    if spare_copies:
        cuts = cuts.where("NOT __copied")
    rows = df.withColumn("__own", F.xxhash64(text))
    cuts = cuts.select(F.col("__key").alias("__of"), F.col("__text").alias("__of_text"), "__cuts")
    return rows.join(cuts, rows[key].eqNullSafe(cuts["__of"]) & (rows["__own"] == cuts["__of_text"]), "left")


def remove(df: DataFrame, found: DataFrame, spare_copies: bool = False, key: str = "doc_id", text: str = "text", site: str = "source", counts: tuple[str, str] = ("n_lines", "n_removed"), broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``df`` with the boilerplate lines cut from ``text``, and its numbers of lines and of removed lines under the names in ``counts``."""
    if found.count() <= broadcast_lines:
        rows = _cuts_in_place(df, found, spare_copies, key, text)
    else:
        rows = _cuts_joined(df, found, spare_copies, key, text, site)
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(HAS_WORD))))
    kept = F.when(F.col("__cuts").isNotNull(), _cut(F.col(text), F.col("__cuts"))).otherwise(F.col(text))
    return rows.select(
        *(kept.alias(text) if c == text else F.col(c) for c in df.columns if c not in counts),
        n_lines.cast("long").alias(counts[0]),
        F.coalesce(F.size("__cuts"), F.lit(0)).cast("long").alias(counts[1]),
    )


def dedup(df: DataFrame, least_sites: int = 10, spare_copies: bool = False, key: str = "doc_id", text: str = "text", site: str = "source", counts: tuple[str, str] = ("n_lines", "n_removed"), broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    return remove(df, boilerplate(df, least_sites, key, text, site), spare_copies, key, text, site, counts, broadcast_lines)


def digest(text: Column) -> Column:
    return F.md5(text)
