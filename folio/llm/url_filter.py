"""URL filters: rules first, then a list of canonical URLs behind a blocked Bloom filter.

A URL is looked up under every suffix of its host (whole labels) and every
prefix of its path that ends in ``/`` or is the whole path.  For the lookups
only, the URL is made canonical: user info, port and trailing dots of the host
are dropped, escapes of unreserved characters are decoded, and ``.`` and ``..``
segments are resolved.  The list's longest key bounds what is looked up.  The
lookups probe a blocked Bloom filter, in one pass over the pages; only possible
hits go on to an exact hash join with the list, which removes false positives.
The filter is one array of 512-bit blocks,
eight 64-bit words each, one bit per word and key; its size follows the list up
to ``most_bytes``, the proven bound of what is broadcast.  Beyond that bound the
filter passes more rows to the exact join, and verdicts stay the same.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is allowed; repeated rows each get the same verdict; an empty
list allows everything that no rule blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ._common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(rest, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
ESCAPE = re.compile("%([0-9A-Fa-f]{2})")


def canonical(host: str, path: str) -> tuple[str, str]:
    """Host and path as lists write them; used for lookups, never shown."""
    host = host.rpartition("@")[2]
    name, colon, port = host.rpartition(":")
    host = (name if colon and port.isdigit() or colon and not port else host).rstrip(".")
    if "%" in path:
        path = ESCAPE.sub(lambda m: chr(int(m[1], 16)) if chr(int(m[1], 16)) in UNRESERVED else m[0].upper(), path)
    if "/." in path:
        kept: list[str] = []
        parts = path.split("/")
        for part in parts:
            if part == ".." and len(kept) > 1:
                kept.pop()
            elif part not in (".", ".."):
                kept.append(part)
        path = "/".join(kept) + ("/" if parts[-1] in (".", "..") and kept[-1:] != [""] else "")
    return host, path if path.startswith("/") else "/" + path


def lookups(host: str, path: str, most_labels: int, most_path: int) -> list[str]:
    """The canonical URLs under which a URL may be listed, given the list's longest host (labels) and path (characters)."""
    host, path = canonical(host, path)
    labels = host.split(".")[-most_labels:] if host else [""]
    hosts, tail = [labels[-1]], labels[-1]
    for label in labels[-2::-1]:
        tail = f"{label}.{tail}"
        hosts.append(tail)
    # No key is longer than the list's longest, so the work is bounded for any URL.
    paths = [path[: m.end()] for m in re.finditer("/", path[:most_path])]
    if len(path) <= most_path and not path.endswith("/"):
        paths.append(path)
    return [h + p for h in hosts for p in paths]


class BlockedBloom:
    """Eight bits per key in one 512-bit block."""

    def __init__(self, words: np.ndarray):
        self.words = words.reshape(-1, 8)

    @staticmethod
    def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and eight word masks of each 64-bit hash."""
        h = hashes.astype(np.uint64)
        block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bits = (mixed[:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(6) + np.uint64(16))) & np.uint64(63)
        return block.astype(np.int64), np.uint64(1) << bits

    def might_contain(self, hashes: np.ndarray) -> np.ndarray:
        block, masks = self.places(hashes, len(self.words))
        return ((self.words[block] & masks) == masks).all(axis=1)


def build_bloom(hashes: DataFrame, n_keys: int, bits_per_key: int = 12, most_bytes: int = 8 << 20) -> BlockedBloom:
    """A filter of the single int64 column of ``hashes``; parts merge by OR, block by block."""
    blocks = int(min(max(1, -(-n_keys * bits_per_key // 512)), most_bytes // 64))
    column = hashes.columns[0]

    def part(batches):
        words = np.zeros((blocks, 8), np.uint64)
        for batch in batches:
            block, masks = BlockedBloom.places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), blocks)
            for k in range(8):
                np.bitwise_or.at(words[:, k], block, masks[:, k])
        used = np.flatnonzero(words.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(words[used, k].view(np.int64), pa.int64()) for k in range(8))], names=["block", *(f"w{k}" for k in range(8))])

    parts = hashes.where(F.col(column).isNotNull()).mapInArrow(part, "block long, " + ", ".join(f"w{k} long" for k in range(8)))
    merged = parts.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)))
    words = np.zeros((blocks, 8), np.int64)
    found = merged.toPandas()  # at most most_bytes // 64 rows
    if len(found):
        words[found["block"].to_numpy()] = found[[f"w{k}" for k in range(8)]].to_numpy()
    return BlockedBloom(words.view(np.uint64))


def key_hashes(keys: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def _hashed(keys: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(key_hashes(batch.column(0).to_pylist()).view(np.int64))], names=["h"])

    return keys.mapInArrow(run, "h long")


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",), most_bytes: int = 8 << 20) -> DataFrame:
    """``keep`` columns, host, path, rule and verdict of every row of ``pages``.

    ``listed`` has one string column of canonical URLs (host and path); nulls
    and repeats in it are ignored.
    """
    spark = pages.sparkSession
    keys = listed.select(F.col(listed.columns[0]).alias("__key")).where(F.col("__key").isNotNull()).distinct()
    host_labels, path_chars = F.size(F.split(F.split_part("__key", F.lit("/"), F.lit(1)), "\\.")), F.length("__key") - F.length(F.split_part("__key", F.lit("/"), F.lit(1)))
    found = keys.agg(F.count("*").alias("n"), F.max(host_labels).alias("labels"), F.max(path_chars).alias("chars")).first()
    n, labels, chars = found["n"], found["labels"] or 0, found["chars"] or 0
    shared = spark.sparkContext.broadcast(build_bloom(_hashed(keys), n, most_bytes=most_bytes).words)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the keys of the list that a URL without a rule may match: null for nearly all."""
        held = BlockedBloom(shared.value)
        for batch in batches:
            free = batch.column(batch.num_columns - 1).to_pylist()
            asked = [lookups(h, p, labels, chars) if f and n else [] for h, p, f in zip(*(batch.column(c).to_pylist() for c in ("host", "path")), free, strict=True)]
            flat = [k for ks in asked for k in ks]
            hits = iter(held.might_contain(key_hashes(flat)).tolist() if flat else [])
            maybe = [[k for k in ks if next(hits)] or None for ks in asked]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(maybe, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "__maybe"])

    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    named = named.select(*keep, "host", "path", name.alias("rule"), verdict.alias("__ruled"), verdict.isNull().alias("__free"))
    schema = named.select(*keep, "host", "path", "rule", "__ruled").schema.add("__maybe", ArrayType(StringType()))
    probed = staged(named.mapInArrow(probe, schema), "url-probed")
    # One row per distinct key goes to the exact join, so a hot URL costs one lookup.
    hits = probed.select(F.explode("__maybe").alias("__key")).distinct().join(keys, "__key", "left_semi")
    ways = probed.where("__maybe IS NOT NULL").select("__maybe").distinct()
    sure = ways.select("__maybe", F.explode("__maybe").alias("__key")).join(hits, "__key", "left_semi").select(F.col("__maybe").alias("__way")).distinct().withColumn("__listed", F.lit(True))
    judged = probed.join(sure, probed["__maybe"] == sure["__way"], "left")
    return judged.select(*keep, "host", "path", "rule", F.coalesce("__ruled", F.when(F.col("__listed"), "block").otherwise("allow")).alias("verdict"))
