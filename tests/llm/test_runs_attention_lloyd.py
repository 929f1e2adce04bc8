"""Periodic runs, attention over passages and weighted Lloyd rounds against plain versions."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import attention_mil, periodic_runs, weighted_lloyd
from folio.llm._words import ngram_hashes
from folio.llm.queries import QUERIES, periodic_tail


def plain_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, length, q) for (i, length), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(draw):
    n, letters = draw.randrange(90), draw.choice([1, 2, 3, 4])
    words = [draw.randrange(letters) for _ in range(n)]
    for _ in range(draw.choice([0, 3])):
        if n > 4:
            a = draw.randrange(n)
            p, b = draw.randint(1, max(1, (n - a) // 2)), draw.randint(a, n)
            words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
    return words


def test_runs_are_those_of_every_period():
    draw = random.Random(1)
    for _ in range(1500):
        words, least = some_words(draw), draw.choice([12, 12, 2, 5, 7])
        assert periodic_runs.runs_of(words, least) == plain_runs(words, least)


def test_stretches_hold_every_run():
    draw = random.Random(2)
    for _ in range(1500):
        words, least = some_words(draw), draw.choice([12, 5])
        size = -(-least // 2)
        if len(words) >= least:
            hashes = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)
            spans = periodic_runs.stretches(ngram_hashes(hashes, size), size)
            found = [(i + a, length, q) for i, j in spans for a, length, q in periodic_runs.runs_of(words[i:j], least)]
            assert sorted(found, key=lambda r: (r[0], r[2])) == plain_runs(words, least)


def test_ordered_sets_tell_neighbours():
    draw = random.Random(3)
    numbers = draw.sample(range(10_000), 5000)
    held = periodic_runs.Ends(numbers[0])
    seen = numbers[:1]
    for x in numbers[1:]:
        below, above = [y for y in seen[-50:] if y < x], [y for y in seen[-50:] if y > x]
        before, after = held.add(x)
        assert before is None or all(y <= before for y in below)
        assert after is None or all(y >= after for y in above)
        seen.append(x)
    assert list(held) == sorted(numbers) and len(held) == len(numbers)


def test_a_long_text_of_one_word_is_one_run():
    assert periodic_runs.runs_of([0] * 60_000) == [(0, 60_000, 1)]


def test_run_rows(spark):
    texts = [
        (1, "a b c " * 5 + "end"),
        (2, None),
        (3, ""),
        (4, "x\ty\nz"),
        (4, "A a " * 6),  # case tells words apart
        (None, "w " * 12),
        (None, "w " * 12),
        (7, "w " * 11),
        (8, "p q r s t u v " * 2 + "p"),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, runs string")
    rows = periodic_runs.find_runs(df).collect()
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in rows), key=repr)
    assert got == sorted(
        [
            (1, [(0, 15, 3)], "a b c end", 16),
            (2, [], "", 0),
            (3, [], "", 0),
            (4, [], "x y z", 3),
            (4, [(0, 12, 2)], "A a", 12),
            (0, [(0, 12, 1)], "w", 12),
            (0, [(0, 12, 1)], "w", 12),
            (7, [], " ".join("w" * 11), 11),
            (8, [(0, 15, 7)], "p q r s t u v", 15),
        ],
        key=repr,
    )
    assert periodic_runs.find_runs(df.limit(0)).count() == 0


def test_longest_run_and_listing(spark):
    df = spark.sql("SELECT array(named_struct('start', 5L, 'length', 20L, 'period', 9L), named_struct('start', 2L, 'length', 20L, 'period', 10L)) AS runs UNION ALL SELECT array()")
    rows = df.select(periodic_runs.longest(F.col("runs")).alias("best"), periodic_runs.listing(F.col("runs")).alias("all")).collect()
    assert {(tuple(r.best) if r.best else None, r.all) for r in rows} == {((2, 20, 10), "5,20,9\n2,20,10\n"), (None, "")}


def test_periodic_tail_follows_its_rule(spark):
    import zlib

    texts = {i: " ".join(f"w{k}" for k in range(i % 37)) for i in range(200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in df.select("doc_id", periodic_tail(F.col("text"), F.col("doc_id")).alias("t")).collect():
        words = texts[r.doc_id].split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert (r.t or "").split() == words


# --- attention ---------------------------------------------------------------------------------


def test_gradients_match_differences():
    draw = np.random.default_rng(0)
    x, sizes, labels = draw.standard_normal((9, 7)), np.array([4, 1, 4]), np.array([1.0, 0.0, 1.0])
    weights = {k: v.astype(np.float64) + 0.1 for k, v in attention_mil.blank(7).items()}
    model = attention_mil.Model(weights, 0.5, np.zeros(7), np.ones(7))

    def loss():
        firsts, bags = np.cumsum(sizes) - sizes, np.repeat(np.arange(3), sizes)
        s = model._forward(x, firsts, bags)[-1]
        return -(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean()

    for name, slope in model.gradients(x, sizes, labels).items():
        flat, held = weights[name].reshape(-1), slope.reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 5)):
            flat[k] += 1e-6
            up = loss()
            flat[k] -= 2e-6
            down = loss()
            flat[k] += 1e-6
            assert math.isclose((up - down) / 2e-6, held[k], rel_tol=1e-3, abs_tol=1e-7)


def test_passages_cover_whole_texts():
    texts = ["one two three " * 40, None, "", " \n ", "word", "AB! " * 33, "é ü " * 31]
    x, sizes = attention_mil.passages(pa.array(texts))
    assert sizes.tolist() == [4, 1, 1, 1, 1, 2, 2]
    words = np.add.reduceat(x[:, len(attention_mil.KINDS) + 1] * attention_mil.PASSAGE_WORDS, np.cumsum(sizes) - sizes)
    assert np.allclose(words, [120, 0, 0, 0, 1, 33, 62])
    # A row's figures don't depend on its neighbours.
    for k, t in enumerate(texts):
        alone, _ = attention_mil.passages(pa.array([t]))
        at = int(sizes[:k].sum())
        assert np.allclose(alone, x[at : at + sizes[k]], atol=1e-6)


def test_attention_finds_the_bad_passage(spark):
    draw = random.Random(4)
    prose = lambda n: " ".join("".join(draw.choice("etaoinsr") for _ in range(draw.randint(2, 8))) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        parts = [prose(32) for _ in range(4)]
        if i % 3 == 0:
            parts[i % 4] = " ".join("$$$%%%" for _ in range(32))
        docs.append((i, " ".join(parts)))
        labels.append((i, int(i % 3 > 0)))
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = attention_mil.fit(frame, known.where(~attention_mil.held_out(F.col("doc_id"))))
    rows = attention_mil.score(frame, model).collect()
    right = [(r.score >= 0.5) == (r.doc_id % 3 > 0) for r in rows]
    assert sum(right) >= 297
    bad = [r for r in rows if r.doc_id % 3 == 0]
    assert sum(r.leading_passage == r.doc_id % 4 for r in bad) > 0.9 * len(bad)


def test_attention_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "text " * 100, "x"), (2, "text " * 100, "x"), (2, "text " * 100, "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in attention_mil.score(docs, attention_mil.fit(docs, none)).collect()} == {0.5}
    known = spark.createDataFrame([(2, 1), (1, 0), (None, 0), (2, None), (2, 1), (9, 0)], "doc_id long, quality int")
    rows = attention_mil.score(docs, attention_mil.fit(docs, known)).collect()
    scores = {r.n_passages: r.score for r in rows}
    assert len(rows) == 5 and len({(r.n_passages, r.score) for r in rows}) == 2 and scores[4] > scores[1]
    assert attention_mil.score(docs.limit(0), attention_mil.fit(docs, known)).count() == 0


def test_attention_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op12_attention_mil"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.97


# --- weighted Lloyd ----------------------------------------------------------------------------


def plain_lloyd(rows, k, rounds, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    put = lambda: [min(range(len(centroids)), key=lambda c: (apart(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        own = put()
        for c in range(len(centroids)):
            if members := [v for (_, v), o in zip(kept, own, strict=True) if o == c]:
                centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = put()
    far = [apart(v, centroids[c]) for (_, v), c in zip(kept, own, strict=True)]
    return sorted((i, c, d, sum(x for x, o in zip(far, own, strict=True) if o == c), sum(far), tuple(centroids[c])) for (i, _), c, d in zip(kept, own, far, strict=True))


def as_rows(df):
    return sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_lloyd_with_copies_and_hot_vectors(spark, kind):
    draw = np.random.default_rng(5)
    some = draw.normal(0, 0.3, (60, 5)).astype(np.float32)
    rows = [(i, some[0 if i % 3 == 0 else i % 60].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    assert as_rows(weighted_lloyd.cluster(df, k=6, dims=5)) == plain_lloyd(rows, 6, 3)


def test_lloyd_defined_cases(spark):
    good = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [3.0, 1.0])]
    bad = [(4, None), (5, [1.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (10, [])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in good + bad], "vec_id long, embedding array<double>, q string, cluster int")
    assert as_rows(weighted_lloyd.cluster(df, k=16, dims=2)) == plain_lloyd(good, 16, 3)
    assert weighted_lloyd.cluster(df.where("vec_id > 3"), dims=2).count() == 0
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    rows = weighted_lloyd.cluster(far, k=1, dims=2).collect()
    assert len(rows) == 3 and all(r.distance >= 0 for r in rows)
