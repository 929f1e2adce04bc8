"""Language ID by unigram piece models summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary.
The likelihood of a word is the sum over all ways to cut it into pieces (the
forward algorithm), so no single segmentation decides.  A text's score is the
sum of its words' log-likelihoods and the language's prior; words are runs of
letters in lower case, and each worker scores a distinct word once.

Fitting counts the pieces of a sample of labelled rows: all of them up to
``sample_rows``, beyond that the rows whose hash falls under the matching
share.  The model has one row per piece that occurs and one column per
language; its size does not grow with the rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text if no row is labelled; ties go to the language first by code
point; repeated rows get equal answers; very long words are rescaled on the way.
"""

from __future__ import annotations

import functools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slices

UNDETERMINED = "und"
SAMPLE_ROWS = 40_000
MOST_WORDS = 200_000
SMOOTHING = 0.05
#: Probability of a letter that is no piece, the same in every language.
UNKNOWN = 1e-9
LETTERS = regex.compile(r"\p{L}+")


@functools.lru_cache(2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_pieces(df: DataFrame, text: str, lang: str, vocabulary: str) -> DataFrame:
    """lang, piece, n over the rows of ``df``: the pieces of the vocabulary's own segmentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(vocabulary)
        pieces: defaultdict[str, Counter] = defaultdict(Counter)
        for part in slices(batches, "__text", 8 << 20):
            words: defaultdict[str, Counter] = defaultdict(Counter)
            for name, t in zip(part.column("__lang").to_pylist(), part.column("__text").to_pylist(), strict=True):
                words[name].update(LETTERS.findall(t.lower()))
            for name, counts in words.items():
                total = pieces[name]
                for ids, n in zip(processor.encode(list(counts), num_threads=1), counts.values(), strict=True):
                    for i in ids:
                        total[i] += n
        for name, total in pieces.items():
            found = {processor.id_to_piece(i): n for i, n in total.items() if not processor.is_byte(i)}
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "piece", "n"])

    rows = df.select(F.col(lang).alias("__lang"), F.col(text).alias("__text")).where(F.col("__lang").isNotNull() & F.col("__text").isNotNull())
    return rows.mapInArrow(run, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    pieces: dict[str, int]
    chance: np.ndarray
    longest: int

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """log of the summed probability of all segmentations, by word and language."""
        out = np.empty((len(words), len(self.languages)))
        by_length: defaultdict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for at in by_length.values():
            for k in range(0, len(at), 4096):
                out[at[k : k + 4096]] = self._forward([words[i] for i in at[k : k + 4096]])
        return out

    def _forward(self, words: list[str]) -> np.ndarray:
        marked = ["▁" + w for w in words]
        n, most, get = len(marked[0]), self.longest, self.pieces.get
        # A word of letters keeps its own row for "no such piece" (all zero) and for an unknown letter.
        none, unknown = len(self.chance) - 2, len(self.chance) - 1
        forward = np.zeros((len(words), n + 1, len(self.languages)))
        forward[:, 0] = 1.0
        offset = np.zeros((len(words), 1))
        for end in range(1, n + 1):
            total = forward[:, end]
            for start in range(max(0, end - most), end):
                rows = [get(w[start:end], none) for w in marked]
                if end - start == 1:
                    rows = [unknown if r == none else r for r in rows]
                elif all(r == none for r in rows):
                    continue
                total += forward[:, start] * self.chance[rows]
            low = total.max(axis=1) < 1e-200
            if low.any():
                forward[low] *= 1e200
                offset[low] -= 200 * np.log(10)
                forward[:, : max(0, end + 1 - most)] = 0
        return np.log(np.maximum(forward[:, n], 1e-300)) + offset


def fit(df: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled rows of ``df``, ``sample_rows`` of them or so where there are more."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    by_lang = {r[0]: r[1] for r in labelled.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    total = sum(by_lang.values())
    if total > sample_rows:
        share = int(sample_rows / total * (1 << 30))
        labelled = labelled.where(F.coalesce(F.pmod(F.xxhash64(F.lit(8), F.col(key)), F.lit(1 << 30)), F.lit(0)) < share)
    counts = count_pieces(labelled, text, lang, vocabulary).toPandas()  # at most pieces of the vocabulary x languages
    languages = sorted(by_lang, key=lambda x: [ord(c) for c in x])
    names = sorted(set(counts["piece"]))
    place, column = {p: i for i, p in enumerate(names)}, {x: i for i, x in enumerate(languages)}
    table = np.full((len(names), len(languages)), SMOOTHING)
    table[[place[p] for p in counts["piece"]], [column[x] for x in counts["lang"]]] += counts["n"].to_numpy()
    chance = np.vstack([table / table.sum(axis=0), np.zeros(len(languages)), np.full(len(languages), UNKNOWN)])
    prior = np.log(np.array([by_lang[x] for x in languages], float) / max(1, total))
    return Model(languages, prior, place, chance, max(map(len, names), default=1))


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, lang_pred and score (the posterior of the language named) of every row, or these two under other ``names``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    # A kept text is read from its own column rather than sent twice.
    read = text if text in keep else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        k = len(held.languages)
        seen: dict[str, int] = {}
        scores = np.empty((0, k))
        for part in slices(batches, read):
            rows = [LETTERS.findall((x or "").lower()) for x in part.column(read).to_pylist()]
            if len(seen) > MOST_WORDS:
                seen, scores = {}, np.empty((0, k))
            new = list({w for r in rows for w in r if w not in seen})
            if new and k:
                seen.update(zip(new, range(len(seen), len(seen) + len(new)), strict=True))
                scores = np.vstack([scores, held.likelihoods(new)])
            named, best = [], []
            for r in rows:
                if not r or not k:
                    named.append(UNDETERMINED)
                    best.append(0.0)
                    continue
                total = scores[np.fromiter(map(seen.__getitem__, r), np.int64, len(r))].sum(axis=0) + held.prior
                top = int(total.argmax())
                named.append(held.languages[top])
                best.append(float(1 / np.exp(total - total[top]).sum()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(named, pa.string()), pa.array(best, pa.float64())], names=[*keep, *names])

    schema = df.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    return df.select(*keep, *([] if text in keep else [df[text].alias("__text")])).mapInArrow(run, schema)


def held_out(key: Column, parts: int = 5) -> Column:
    """True where crc32 of the key as text is divisible by ``parts``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == 0, F.lit(False))
