"""Language-model scoring with a sharded Elias-Fano n-gram trie.

P(w | u v) = a + b * P(w), where a and b come from the trie: trigrams with
absolute discounting, over bigrams that leave ``lean`` of a word's count to it,
over the add-0.1 unigrams.  All counts of all training tokens are in the model.
It grows with the corpus, so it is never
gathered: it lives in shards by the middle word v, each an Elias-Fano trie file
in the shared folder that its task memory-maps.

1. Texts become blocks of word numbers with the block's distinct words.
2. Each block sends its distinct words to the word shards, which count them over
   all training texts, number them, and reply.
3. Each block sends its distinct (v, u, w) with training counts to the trie
   shards.  A shard sums them, builds and writes its trie, maps it, and answers
   every (v, u, w) it was sent by successor search.
4. Each block scores its texts from the replies.

Requests and replies are packed arrays, one row per block and shard, distinct
within the block, so a very common word or pair costs one entry per block.

A word v of more than ``shard_tokens`` training tokens is split over many
shards: its trigrams by (v, u), and its bigrams by (v, w).  What a bigram leaves
to the unigram depends on v's count alone, so no part needs to know another.

Defined cases: a null or empty text has one token, the end; a null id is kept
and trains; rows that repeat are separate texts; with no training text every
word is unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import forget, give_back, slices, stage_path, staged
from ._planes import expand, expand_sorted, press, press_sorted, runs
from ._words import MULTIPLY, finish, text_hash, word_hashes
from .elias_fano import Trie
from .zip_warc import file_system

#: Bytes of text in a block; tokens for which one shard is made.
BLOCK, SHARD_TOKENS = 8 << 20, 1_000_000
DISCOUNT = 0.75
#: What bigrams leave to the unigrams after a word seen once, and how that falls with the word's count.
LEAN, FALL = 0.9, 0.1
ADD = 0.1
#: No word can hold a space, so these are no words.
END = b" end"
BOS, RESERVED = 1, 2


def held_out(key: Column, parts: int = 10) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % parts == 0, F.lit(False))


BLOCKS = "block long, keys array<long>, held array<boolean>, n_tokens array<int>, tokens binary, words binary, ranks binary, counts binary, part int"


def _blocks(df: DataFrame, key: str, text: str, held: Column) -> DataFrame:
    """Two rows for each block of texts: word numbers of all tokens (part 0); its distinct words' hashes in order, numbers and training counts (part 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        end = text_hash(END)
        for part in slices(batches, "text", BLOCK):
            hashes, lengths = word_hashes(part.column("text"))
            hashes, lengths = np.insert(hashes, np.cumsum(lengths), end), lengths + 1
            words, tokens, times = np.unique(hashes, return_inverse=True, return_counts=True)
            # Common words get small numbers, which pack well; the words themselves stay sorted.
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-times, kind="stable")] = np.arange(len(words))
            held_out = part.column("held").to_pylist()
            counts = np.bincount(tokens, np.repeat(~np.array(held_out, bool), lengths), len(words)).astype(np.int64)
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 4, pa.int32())
            texts = (made, part.column("key").to_pylist(), held_out, lengths.tolist(), press(rank[tokens]), None, None, None, 0)
            vocabulary = (made, None, None, None, None, press_sorted(words), press(rank), press(counts), 1)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(texts, vocabulary, strict=True), types, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])
            made += 1

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), held.alias("held"))
    return rows.mapInArrow(run, BLOCKS)


class Block:
    """A block's tokens, as numbers of its words by frequency, with their training flags.

    ``ids`` and ``counts`` are its words' numbers in the tries (0: none) and
    training counts.  Within the block, words go by codes: their ids' ranks.
    """

    def __init__(self, row: dict, ids: np.ndarray, counts: np.ndarray, shards: int, shard_tokens: int):
        self.row, self.ids, self.counts, self.shards = row, ids, counts, shards
        self.lengths = np.array(row["n_tokens"], np.int64)
        self.held = np.array(row["held"], bool)
        self.tokens = expand(row["tokens"]).astype(np.int64)
        self.trains = np.repeat(~self.held, self.lengths)
        # 0 and BOS are the least ids, so they are codes too.
        self.names, code = np.unique(np.r_[0, BOS, ids], return_inverse=True)
        code = code[2:].astype(np.int32)
        self.times = np.zeros(len(self.names), np.int64)
        self.times[code[ids > 0]] = counts[ids > 0]
        # Into how many parts each word is split as a middle word.
        self.parts = -(-self.times // shard_tokens)
        w = code[self.tokens]
        firsts = np.cumsum(self.lengths) - self.lengths
        v, u = np.zeros_like(w), np.zeros_like(w)
        v[1:], u[2:] = w[:-1], w[:-2]
        v[firsts] = BOS
        u[firsts] = BOS
        u[firsts[self.lengths > 1] + 1] = BOS
        #: Tokens after a known word, and their v, u and w.
        self.asked = np.flatnonzero(v > 0)
        self.v, self.u, self.w = v[self.asked], u[self.asked], w[self.asked]

    def requests(self) -> tuple[np.ndarray, ...]:
        """Distinct (v, u, w) by shard with training counts; the request of each token (-1: none)."""
        v, u, w, n, where = self._distinct(self.asked, self.v, self.u, self.w)
        name = self.names
        split = shard_of(name[v], self.shards, name[u], self.parts[v]) + self.shards
        return self._by_shard(np.where(self.parts[v] > 1, split, shard_of(name[v], self.shards)), name[v], name[u], name[w], n, where)

    def split_requests(self) -> tuple[np.ndarray, ...]:
        """The same for the (v, w) of split words, with v's training count in place of u."""
        own = (self.parts[self.v] > 1) & (self.w > 0)
        v, _, w, n, where = self._distinct(self.asked[own], self.v[own], np.zeros_like(self.v[own]), self.w[own])
        name = self.names
        return self._by_shard(2 * self.shards + shard_of(name[v], self.shards, name[w], self.parts[v]), name[v], self.times[v], name[w], n, where)

    def _distinct(self, asked: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        order = in_order(v, u, w)
        v, u, w = v[order], u[order], w[order]
        fresh = changes(v, u, w)
        place = np.cumsum(fresh) - 1
        n = np.bincount(place, self.trains[asked][order], int(fresh.sum())).astype(np.int64)
        where = np.full(len(self.tokens), -1)
        where[asked[order]] = place
        return v[fresh], u[fresh], w[fresh], n, where

    @staticmethod
    def _by_shard(shard: np.ndarray, *rows: np.ndarray) -> tuple[np.ndarray, ...]:
        by = np.argsort(shard, kind="stable")
        back = np.empty(len(by) + 1, np.int64)
        back[by], back[-1] = np.arange(len(by)), -1
        return shard[by], *(x[by] for x in rows[:-1]), back[rows[-1]]


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the one before it."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = False
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return fresh


def in_order(*keys: np.ndarray) -> np.ndarray:
    """The rows' order by the keys, the first one leading; by one number where they fit into it."""
    widths = [int(k.max()).bit_length() if len(k) else 0 for k in keys]
    if sum(widths) > 64:
        return np.lexsort(keys[::-1])
    one = keys[0].astype(np.uint64)
    for k, width in zip(keys[1:], widths[1:], strict=True):
        one = one << np.uint64(width) | k.astype(np.uint64)
    return np.argsort(one)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in half the memory, where they fit."""
    return x.astype(np.int32) if not len(x) or x.max() < 1 << 31 else x.astype(np.int64)


def shard_of(v: np.ndarray, shards: int, other: np.ndarray | None = None, parts: np.ndarray | None = None) -> np.ndarray:
    """The shard of each word, or of that of its parts which holds ``other``."""
    h = v.astype(np.uint64) * MULTIPLY
    if other is not None:
        h = finish(h) + finish(other.astype(np.uint64) * MULTIPLY) % np.maximum(parts, 1).astype(np.uint64)
    return (finish(h) % np.uint64(shards)).astype(np.int64)


def press_inner(v: np.ndarray, u: np.ndarray) -> bytes:
    """``u``, sorted within equal ``v``: steps that begin anew with each v."""
    steps = np.diff(u.astype(np.int64), prepend=0)
    heads = np.flatnonzero(changes(v))
    steps[heads] = u[heads]
    return press(steps)


def expand_inner(v: np.ndarray, data: bytes) -> np.ndarray:
    steps = expand(data).astype(np.int64)
    upto = np.cumsum(steps)
    heads = np.flatnonzero(changes(v))
    return upto - np.repeat(upto[heads] - steps[heads], np.diff(np.r_[heads, len(v)]))


CHUNK = "kind int, shard long, block long, x binary, y binary, z binary, n binary"
_NAMES = [x.split()[0] for x in CHUNK.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _chunks(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _word_requests(words: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, ranks, n = expand_sorted(row["words"]), expand(row["ranks"]), expand(row["counts"])
                # Hashes are sorted, and shards are ranges of hashes.
                shard = ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                rows = [(0, s, row["block"], press_sorted(words[i:j]), press(ranks[i:j]), None, press(n[i:j])) for s, i, j in runs(shard)]
                yield from _chunks(rows).to_batches()

    return words.mapInArrow(run, CHUNK)


def _count_words(requests: DataFrame, shards: int) -> DataFrame:
    """Replies with count and number of each word asked for; one row per shard (kind 9) with its tokens and words."""

    def run(t: pa.Table) -> pa.Table:
        give_back()
        shard = t["shard"][0].as_py()
        asked = [expand_sorted(x) for x in t["x"].to_pylist()]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, np.concatenate([expand(x) for x in t["n"].to_pylist()])).astype(np.int64)
        seen = total > 0
        # Training words are numbered densely; common ones get small numbers, which pack well.
        used = int(seen.sum())
        number = np.zeros(len(words), np.int64)
        number[np.argsort(-total, kind="stable")[:used]] = np.arange(used) * shards + shard + RESERVED
        rows, p = [], 0
        for block, a, ranks in zip(t["block"].to_pylist(), asked, t["y"].to_pylist(), strict=True):
            own = at[p : p + len(a)]
            rows.append((1, shard, block, press(number[own]), ranks, None, press(total[own])))
            p += len(a)
        rows.append((9, shard, int(total.sum()), None, None, None, press(np.array([seen.sum()]))))
        return _chunks(rows)

    return requests.groupBy("shard").applyInArrow(run, CHUNK)


def _of_kind(rows: list[dict], kind: int) -> list[dict]:
    return sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["shard"])


def _joined(rows: list[dict], column: str) -> np.ndarray:
    return np.concatenate([expand(r[column]) for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)


def _word_table(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Number in the tries and training count of each of a block's words."""
    at = _joined(rows, "y")
    ids, counts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    ids[at], counts[at] = _joined(rows, "x"), _joined(rows, "n")
    return ids, counts


def lean(n: np.ndarray) -> np.ndarray:
    return LEAN * np.maximum(n, 1.0) ** -FALL


def _told(t: pa.Table, shards: int, shard_tokens: int) -> list[Block]:
    """The blocks of a group (one) with the numbers and counts of their words."""
    rows = t.to_pylist()
    ids, counts = _word_table(_of_kind(rows, 1))
    return [Block(r, ids, counts, shards, shard_tokens) for r in rows if r["kind"] is None]


def _trie_requests(told: DataFrame, shards: int, shard_tokens: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        give_back()
        rows = []
        for block in _told(t, shards, shard_tokens):
            for shard, v, u, w, n, _ in (block.requests(), block.split_requests()):
                rows += [(2, s, block.row["block"], press_sorted(v[i:j]), press_inner(v[i:j], u[i:j]), press(w[i:j]), press(n[i:j])) for s, i, j in runs(shard)]
        return _chunks(rows)

    return told.groupBy("block").applyInArrow(run, CHUNK)


def open_trie(path: str) -> Trie:
    """A shard's trie: memory-mapped where the store is a mounted folder, else read once."""
    fs, place = file_system(path)
    if fs.type_name == "local":
        return Trie(np.memmap(place, np.uint8, "r"))
    with fs.open_input_file(place) as file:
        return Trie(file.read())


class Asked:
    """The requests of one shard, those of all blocks in one order."""

    def __init__(self, t: pa.Table):
        self.blocks = t["block"].to_pylist()
        each = [expand_sorted(x) for x in t["x"].to_pylist()]
        self.stops = np.cumsum([len(x) for x in each])
        self.own_v = narrow(np.concatenate(each))
        self.own_u = narrow(np.concatenate([expand_inner(x, y) for x, y in zip(each, t["y"].to_pylist(), strict=True)]))
        del each
        w, n = (narrow(np.concatenate([expand(x) for x in t[c].to_pylist()])) for c in "zn")
        order = in_order(np.unique(self.own_v, return_inverse=True)[1], self.own_u, w)
        v, u, w = self.own_v[order], self.own_u[order], w[order]
        fresh = changes(v, u, w)
        self.count = np.add.reduceat(n[order], np.flatnonzero(fresh), dtype=np.int64)
        self.v, self.u, self.w = v[fresh], u[fresh], w[fresh]
        self.place = np.empty(len(v), np.int64)
        self.place[order] = np.cumsum(fresh) - 1

    def by_block(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each block with the places of its requests, and of the first ones of its contexts."""
        for block, i, j in zip(self.blocks, np.r_[0, self.stops[:-1]], self.stops, strict=True):
            own = self.place[i:j]
            yield block, own, own[changes(self.own_v[i:j], self.own_u[i:j])]


def written(folder: str, name: str, data: bytes) -> Trie:
    """The trie of ``data``, written and mapped.  A retried or second attempt writes the same bytes; the move into place is whole or not at all."""
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    temporary = f"{base}/{name}-{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, f"{base}/{name}.trie")
    return open_trie(f"{folder}/{name}.trie")


def _answer(requests: DataFrame, folder: str, shards: int) -> DataFrame:
    """Build, write and map each shard's trie; reply with the codes of a to every request and of b to every context (kind 3).

    The second range of shards has trigrams of split words, the third their
    bigrams, to which the reply is a alone (kind 5).
    """

    def run(t: pa.Table) -> pa.Table:
        give_back()
        shard, asked = t["shard"][0].as_py(), Asked(t)
        known, pairs = asked.count > 0, shard >= 2 * shards
        v, u, w, n = (x[known] for x in (asked.v, asked.u, asked.w, asked.count))
        # The word's training count stands in u's place in requests of bigrams.
        none = np.zeros_like(asked.u)
        data = Trie.pack(v, none[known] if pairs else u, w, n.astype(float), DISCOUNT, lean, whole=not shards <= shard < 2 * shards, total=u.astype(float) if pairs else None)
        a, b = map(encode, written(folder, f"{shard:08d}", data).query(asked.v, none if pairs else asked.u, asked.w))
        if pairs:
            return _chunks([(5, shard, block, press(a[own]), None, None, None) for block, own, _ in asked.by_block()])
        return _chunks([(3, shard, block, press(a[own]), press(b[heads]), None, None) for block, own, heads in asked.by_block()])

    return requests.groupBy("shard").applyInArrow(run, CHUNK)


#: Steps of a reply's code in one bit.
STEPS = 32


def encode(x: np.ndarray) -> np.ndarray:
    """Codes of numbers from 2**-64 to 1, even steps of their logarithm apart; 0 for 0."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.clip(np.round((np.log2(x) + 64) * STEPS), 1, 64 * STEPS), 0).astype("<u2")


def decode(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2(codes / STEPS - 64), 0.0)


SCORED = "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(told: DataFrame, answers: DataFrame, shards: int, shard_tokens: int, n_all: int, n_words: int) -> DataFrame:
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        give_back()
        out = []
        found = found.to_pylist()
        tries, pairs = _of_kind(found, 3), _of_kind(found, 5)
        a, b, p2 = decode(_joined(tries, "x")), decode(_joined(tries, "y")), decode(_joined(pairs, "x"))
        for block in _told(own, shards, shard_tokens):
            counts = block.counts[block.tokens]
            base = (counts + ADD) / (n_all + ADD * (n_words + 1))
            p = base.copy()
            after = block.parts[block.v] > 1
            p[block.asked[after]] *= lean(block.times[block.v[after]])
            where = block.split_requests()[-1]
            asked = where >= 0
            p[asked] += p2[where[asked]]
            _, v, u, _, _, where = block.requests()
            asked = where >= 0
            context = np.cumsum(changes(v, u)) - 1
            p[asked] = a[where[asked]] + b[context[where[asked]]] * p[asked]
            firsts = np.cumsum(block.lengths) - block.lengths
            sums = [np.add.reduceat(x, firsts) for x in (counts > 0, np.log10(base), np.log10(p))]
            out.append(pa.table([
                pa.array(block.row["keys"], pa.int64()), pa.array(block.held), pa.array(block.lengths), pa.array(sums[0].astype(np.int64)),
                pa.array(np.full(len(firsts), n_all)), pa.array(sums[1]), pa.array(sums[2]),
            ], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)

    return told.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORED)


def score(df: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every text.

    The trie's shards stay in the shared folder under the returned frame's ``model_path``.
    """
    spark = df.sparkSession
    both = staged(_blocks(df, key, text, held_out(F.col(key)) if held is None else held), "lm-blocks", "part")
    blocks = both.where("part = 0").select("block", "keys", "held", "n_tokens", "tokens")
    vocabulary = both.where("part = 1").select("block", "words", "ranks", "counts")
    tokens = blocks.agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    shards = max(4, -(-tokens // shard_tokens))
    words = staged(_count_words(_word_requests(vocabulary, shards), shards), "lm-words")
    forget(both, "part=1")
    n_all, n_words = 0, 0
    for row in words.where("kind = 9").select("block", "n").toLocalIterator():  # one small row per shard
        n_all, n_words = n_all + row["block"], n_words + int(expand(bytes(row["n"]))[0])
    # Blocks and the replies to them are shuffled once, for the requests and for the scores.
    told = blocks.unionByName(words.where("kind = 1").select("kind", "shard", "block", "x", "y", "n"), allowMissingColumns=True)
    folder = stage_path(spark, "lm-trie")
    # Not staged: replies go straight on to the blocks, and the requests' shuffle is their only other copy.
    answers = _answer(_trie_requests(told, shards, shard_tokens), folder, shards)
    out = _score(told, answers, shards, shard_tokens, n_all, n_words).withColumnRenamed("key", key)
    out.model_path = folder
    return out
