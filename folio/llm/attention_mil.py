"""Quality by attention over passages: multiple-instance learning from document labels.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Labels say what a
document is worth, not which passage makes it so; the model learns that:

* each passage is encoded, from counts of kinds of bytes, figures of its words
  and hashed words, by one hidden layer;
* gated attention, ``w . (tanh(V h) * sigmoid(U h))``, gives each passage a
  weight, a softmax over the document's passages;
* the document is the weighted sum of its encoded passages, and a logistic unit
  scores that.

All of it is learnt together by gradient descent on the log loss of labelled
documents.  Fitting reads a sample: the labels of ``sample_rows`` keys or so
(those whose hash is under the matching share; all keys where there are fewer),
and of a very long document ``TRAIN_PASSAGES`` passages evenly spaced.  So the
driver holds sample_rows x TRAIN_PASSAGES vectors at most, whatever the input.
Scoring encodes every passage of every whole text in one narrow map.

Defined cases: a null or empty text, or one without a word, is one passage of
zeros; a null label or key is not learnt from; of several labels of a key the
average counts, from one half on as 1; of several texts under one key the
smallest is learnt from; with no label, or one class alone, every score is the
share of label 1 (one half without labels); repeated rows get equal scores (to
six digits, at which they are rounded); columns that aren't kept play no part; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slices
from ._words import IN_WORD, word_hashes

PASSAGE_WORDS = 32
SAMPLE_ROWS = 8_000
TRAIN_PASSAGES = 64
HASHED = 64
HIDDEN, ATTENTION = 32, 16
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 128, 0.005, 1e-3, 12
#: Hashed words count this much beside the figures, which hold for words never seen.
HASHED_WEIGHT = 0.3

#: Kinds of bytes; what is named in none of them is the last kind.
KINDS = (b" ", b"\t\n\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:", b"!?", b"#*$%&|<>", b"'\"()[]{}-_/\\@=+~^`", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)))
LOWER, UPPER, SYMBOL = 2, 3, 7
#: Kinds, then: words, bytes a word, equal neighbours, distinct words, words of capitals, words with an inner or final symbol.
FIGURES = len(KINDS) + 7
FEATURES = FIGURES + HASHED


def _kind_table() -> np.ndarray:
    table = np.full(256, len(KINDS), np.int64)
    for k, letters in enumerate(KINDS):
        table[list(letters)] = k
    return table


KIND = _kind_table()


def passages(column: pa.Array, words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Feature vectors of all passages of a string column, and the number of passages of each row (one at least)."""
    flat = column.cast(pa.large_binary())
    hashes, counts = word_hashes(column)
    n_rows = len(flat)
    per_row = np.maximum(1, -(-counts // words))
    first_passage = np.cumsum(per_row) - per_row
    out = np.zeros((int(per_row.sum()), FEATURES), np.float32)
    if not len(hashes):
        return out, per_row
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + n_rows + 1]
    data = np.frombuffer(flat.buffers()[2], np.uint8)[int(offsets[0]) : int(offsets[-1])]
    inside = IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = (offsets[:-1] - offsets[0])[offsets[:-1] < offsets[-1]]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    # The passage of each word; a byte belongs to the passage of the last word that began, or to its row's first.
    row = np.repeat(np.arange(n_rows), counts)
    nth = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first_passage[row] + nth // words
    kind = KIND[data]
    n, width = len(out), len(KINDS) + 1
    own = np.repeat(np.r_[0, at], np.diff(np.r_[0, starts, len(data)]))
    own = np.maximum(own, np.repeat(first_passage, np.diff(offsets)))
    shares = np.bincount(own * width + kind, minlength=n * width).reshape(n, -1).astype(np.float32)
    shares[first_passage[counts == 0]] = 0
    size = shares.sum(axis=1)
    out[:, :width] = shares / np.maximum(size, 1)[:, None]
    total = np.bincount(at, minlength=n).astype(np.float32)
    some = np.maximum(total, 1)
    out[:, width] = total / words
    out[:, width + 1] = size / some / 16
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])]
    out[:, width + 2] = np.bincount(at[same], minlength=n) / some
    ordered = np.sort((at.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.r_[True, ordered[1:] != ordered[:-1]]
    out[:, width + 3] = np.bincount((ordered[fresh] >> np.uint64(40)).astype(np.int64), minlength=n) / some
    # By word: its capitals, its other letters and its symbols.
    capital, lower, symbol = (np.add.reduceat((kind == k).astype(np.int32), starts) for k in (UPPER, LOWER, SYMBOL))
    out[:, width + 4] = np.bincount(at[(capital > 1) & (lower == 0)], minlength=n) / some
    out[:, width + 5] = np.bincount(at[symbol > 0], minlength=n) / some
    bucket = (hashes >> np.uint64(13)) % np.uint64(HASHED)
    out[:, FIGURES:] = np.bincount(at * HASHED + bucket.astype(np.int64), minlength=n * HASHED).reshape(n, HASHED) / some[:, None]
    return out, per_row


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """``weights`` is empty where there was nothing to tell apart; then ``base`` is every score."""

    weights: dict[str, np.ndarray]
    base: float
    mean: np.ndarray
    scale: np.ndarray

    def _forward(self, x: np.ndarray, firsts: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"] + w["v"]), _squash(h @ w["U"] + w["u"])
        raw = (t * g) @ w["a"]
        raw = np.exp(raw - np.maximum.reduceat(raw, firsts)[bags])
        weight = raw / np.add.reduceat(raw, firsts)[bags]
        z = np.add.reduceat(weight[:, None] * h, firsts)
        return h, t, g, weight, z, _squash(z @ w["c"] + w["d"])

    def score(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the bags, and the attention weight of each passage."""
        firsts, bags = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        if not self.weights:
            return np.full(len(sizes), self.base), (1 / sizes)[bags]
        *_, weight, _, score = self._forward((x - self.mean) / self.scale, firsts, bags)
        return score.astype(np.float64).round(6), weight.astype(np.float64)

    def gradients(self, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; ``x`` is scaled already."""
        w = self.weights
        firsts, bags = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        h, t, g, weight, z, score = self._forward(x, firsts, bags)
        top = ((score - labels) / len(labels)).astype(x.dtype)
        dz = (top[:, None] * w["c"])[bags]
        pull = (dz * h).sum(axis=1)
        draw = weight * (pull - np.add.reduceat(weight * pull, firsts)[bags])
        dt, dg = draw[:, None] * w["a"] * g * (1 - t * t), draw[:, None] * w["a"] * t * g * (1 - g)
        dh = (weight[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {
            "W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "v": dt.sum(axis=0), "U": h.T @ dg, "u": dg.sum(axis=0),
            "a": (t * g).T @ draw, "c": z.T @ top, "d": top.sum(keepdims=True),
        }


def blank(features: int = FEATURES, seed: int = SEED) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    part = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    zeros = lambda n: np.zeros(n, np.float32)
    return {
        "W": part(features, HIDDEN), "b": zeros(HIDDEN), "V": part(HIDDEN, ATTENTION), "v": zeros(ATTENTION),
        "U": part(HIDDEN, ATTENTION), "u": zeros(ATTENTION), "a": part(ATTENTION), "c": part(HIDDEN), "d": zeros(1),
    }


def learn(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adam over mini-batches of bags; the same input gives the same model."""
    base = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or labels.min() == labels.max():
        return Model({}, base, np.zeros(FEATURES), np.ones(FEATURES))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    scale[FIGURES:] /= HASHED_WEIGHT
    model = Model(blank(x.shape[1]), base, mean, scale)
    x = (x - mean) / scale
    firsts = np.cumsum(sizes) - sizes
    first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    draw, step = np.random.default_rng(SEED), 0
    for _ in range(epochs):
        order = draw.permutation(len(sizes))
        for at in range(0, len(order), BATCH):
            bags, step = order[at : at + BATCH], step + 1
            rows = np.concatenate([np.arange(firsts[b], firsts[b] + sizes[b]) for b in bags.tolist()])
            for name, slope in model.gradients(x[rows], sizes[bags], labels[bags]).items():
                weight = model.weights[name]
                slope = slope + DECAY * weight
                first[name] += 0.1 * (slope - first[name])
                second[name] += 0.001 * (slope * slope - second[name])
                weight -= RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return model


def _spread(n: int, most: int) -> np.ndarray:
    return np.arange(n) if n <= most else np.arange(most) * n // most


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the documents whose keys ``labels`` names, ``sample_rows`` keys or so where there are more."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    known = known.select(F.col(key).alias("__key"), "__label")
    total = known.count()
    if total > sample_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(12), "__key"), F.lit(1 << 30)) < int(sample_rows / total * (1 << 30)))
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(known), "__key")
    rows = rows.groupBy("__key").agg(F.min("__text").alias("__text"), F.first("__label").alias("__label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            x, sizes = passages(part.column("__text"))
            ends = np.cumsum(sizes)
            packed = [x[end - n + _spread(n, TRAIN_PASSAGES)].tobytes() for end, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("__key").cast(pa.string()), part.column("__label"), pa.array(packed, pa.binary())], names=["k", "label", "x"])

    # A bounded number of rows of bounded length.
    found = rows.select("__key", "__label", "__text").mapInArrow(run, "k string, label int, x binary").toPandas().sort_values("k")
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in found["x"]]
    sizes = np.array([len(b) for b in bags], np.int64)
    x = np.vstack(bags) if bags else np.zeros((0, FEATURES), np.float32)
    return learn(x, sizes, found["label"].to_numpy(np.float32))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score, n_passages and the greatest attention weight (its passage, from 0) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            x, sizes = passages(part.column("__text"))
            scores, weights = shared.value.score(x, sizes)
            firsts = np.cumsum(sizes) - sizes
            most = np.maximum.reduceat(weights, firsts)
            top = np.flatnonzero(weights == np.repeat(most, sizes))
            bag = np.searchsorted(firsts, top, side="right") - 1
            leading = top[np.r_[True, bag[1:] != bag[:-1]]] - firsts
            names = [*keep, "score", "n_passages", "leading_passage", "leading_weight"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(scores), pa.array(sizes), pa.array(leading), pa.array(most)], names=names)

    schema = docs.select(*keep).schema.add("score", "double").add("n_passages", "long").add("leading_passage", "long").add("leading_weight", "double")
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """True where crc32 of the key as text leaves 1 by three; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))
