"""Suffix-array repetition, cube mixing, line spread."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import cube_mixing as C
from folio.llm import line_spread as L
from folio.llm import suffix_repetition as S


def brute(words, least):
    n, most = len(words), [0] * len(words)
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[j + k] == words[i + k]:
                k += 1
            most[i], most[j] = max(most[i], k), max(most[j], k)
    spans = {i + k for i in range(n) if most[i] >= least for k in range(most[i])}
    return len(spans), max([m for m in most if m >= least], default=0)


@pytest.mark.parametrize("least, window", [(3, 8), (5, 8), (8, 8), (9, 4), (1, 2)])
def test_repeats_by_brute_force(least, window):
    rng = random.Random(least)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(60))] for _ in range(40)] + [[], [b"a"] * 50, [b"x"]]
    for words, r in zip(texts, S.repeats(texts, least, window), strict=True):
        assert (r.covered, r.longest) == brute(words, least)
        assert r.base_repeats == brute(words, window)[0]
        assert sum(b - a for a, b in r.spans) == r.covered and r.n_words == len(words)


def test_judge(spark):
    prose = " ".join(f"w{i}" for i in range(200))
    rows = [(1, prose), (2, None), (3, ""), (4, "a b c"), (5, "buy this now please today " * 20), (6, "x # $\nx # $\n \nüx"), (7, prose + "\n" + prose), (None, prose), (9, "long " * 100_000)]
    got = {r["doc_id"]: r for r in S.judge(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))).collect()}
    assert [got[k]["kept"] for k in (1, 2, 3, 4, 5, 7, None, 9)] == [True, False, False, False, False, False, True, False]
    r = got[6]
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (7, 8, 4, 1, 0)
    assert got[7]["longest_repeat"] == 200 and got[7]["spans"] == [(0, 400)] and got[7]["n_repeat_words"] == 400
    assert S.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def documents(spark, sizes):
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def water(sizes, weights, total):
    """Targets by repeated resharing, as the rule is worded."""
    targets, open_, rest = {}, set(sizes), total
    while open_:
        share = {s: rest * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return targets | share
        for s in over:
            targets[s] = 2 * sizes[s]
            rest -= targets[s]
        open_ -= over
    return targets


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    sizes = [(rng.randrange(0, 200), rng.choice(["a", "a", "a", "b", "c", "é", None])) for _ in range(6000)] + [(0, "z")]
    df = documents(spark, sizes).withColumn("size", F.lit("clash"))
    got = C.mix(df, keep=("doc_id", "source")).collect()
    again = {r["doc_id"]: r["copies"] for r in C.mix(df.repartition(7)).collect()}
    assert {r["doc_id"]: r["copies"] for r in got} == again and len(got) == len(sizes)
    total = {}
    for n, s in sizes:
        total[s] = total.get(s, 0) + n
    names = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    expected = water(total, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(total.values()))
    for s in total:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(expected[s]) and own[0]["source_size"] == total[s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - expected[s]) <= 20
    assert max(r["copies"] for r in got) <= 2


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(0)
    size, chance = rng.integers(1, 100, 40), rng.uniform(0.1, 0.9, 40)
    runs = np.array([C.flight(chance, size, np.random.default_rng(k)) for k in range(1500)])
    assert np.allclose(runs @ size, chance @ size) and np.allclose(runs.sum(axis=1), chance.sum())
    assert ((runs > 1e-9) & (runs < 1 - 1e-9)).sum(axis=1).max() <= 2
    assert np.abs(runs.mean(axis=0) - chance).max() < 0.06


def test_landing_keeps_probabilities_and_leaves_little():
    rng = np.random.default_rng(2)
    size, chance = np.r_[rng.integers(1, 30, 40), rng.integers(100, 1000, 60), 0], rng.uniform(0.1, 0.9, 101)
    runs = []
    for k in range(1500):
        draws = np.random.default_rng(k)
        runs.append(C.land(C.flight(chance, size, draws), size, draws))
    runs = np.array(runs)
    assert set(np.unique(runs)) == {0.0, 1.0} and np.abs(runs.mean(axis=0) - chance).max() < 0.06
    owed = np.abs(runs @ size - chance @ size)  # of about 17,000 words
    assert np.median(owed) <= 10 and np.quantile(owed, 0.9) <= 120 and np.abs(runs.sum(axis=1) - chance.sum()).max() < 2
    # Equal sizes, all empty, nothing open.
    for sizes in (np.full(9, 7), np.zeros(9, np.int64)):
        draws = np.random.default_rng(1)
        assert set(np.unique(C.land(C.flight(np.full(9, 0.4), sizes, draws), sizes, draws))) <= {0.0, 1.0}
    assert C.flight(np.array([0.0, 1.0]), np.array([3, 4]), np.random.default_rng(0)).tolist() == [0.0, 1.0]


def test_mixing_spreads_rows_without_key(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    got = C.mix(df).collect()
    assert len(got) == 3000 and abs(sum(r["size"] * r["copies"] for r in got) - 1.5 * 9000) <= 6


def test_mixing_agrees_under_another_split(spark):
    rows = [(None if i % 3 else i % 5, " ".join("w" * (1 + i * 7 % 40)) + f" t{i}", f"s{i % 2}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    takes = lambda found: sorted((r["text"], r["copies"]) for r in found.collect())
    assert takes(C.mix(df, keep=("text",))) == takes(C.mix(df.repartition(7), keep=("text",)))


def test_many_equal_rows_cost_what_others_do(spark):
    import time

    def seconds(text):
        df = spark.range(20_000).coalesce(2).select(F.lit(1).alias("doc_id"), text.alias("text"), F.lit("s").alias("source"))
        began = time.time()
        taken = sum(r["size"] * r["copies"] for r in C.mix(df, keep=("doc_id",)).collect())
        assert abs(taken - 90_000) <= 6
        return time.time() - began

    seconds(F.concat(F.lit("a b c"), F.lit("")))
    distinct, equal = seconds(F.concat(F.lit("a b c"), "id")), seconds(F.lit("a b c"))
    assert equal <= 2 * distinct + 2


def test_mixing_edges(spark):
    assert C.mix(documents(spark, [])).collect() == []
    empty = C.mix(spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in empty] == [(0, 0.0, 0)] * 3


def test_line_spread(spark):
    boiler, rare = "Cookies make this site better", "seen on two"
    rows = [(i, f"own {i} text\n{boiler}\n\nmore own words {i} here", f"s{i % 12}") for i in range(24)]
    rows += [(100, f"{rare}\nx y", "s1"), (101, f"{rare}\nz", "s2"), (102, boiler, "s3"), (103, None, "s1"), (104, "", None), (105, f"{boiler} and a tail that differs\n{boiler}\n" + "word " * 50, None), (None, f"null id\n{boiler}", "s4"), (1, f"own 1 text\n{boiler}\n\nmore own words 1 here", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("sites", F.lit(1))
    for most in (1000, 0):  # both ways to the same cuts
        found = L.dedup(df, least_sites=10, broadcast_lines=most).collect()
        got = {r["doc_id"]: r for r in found}
        assert len(found) == len(rows) and boiler in got[0]["text"] and got[0]["n_removed"] == 0
        for i in range(1, 24):
            assert got[i]["text"] == f"own {i} text\n\nmore own words {i} here" and (got[i]["n_lines"], got[i]["n_removed"]) == (3, 1)
        assert [r["n_removed"] for r in found if r["doc_id"] == 1] == [1, 1] and got[None]["text"] == "null id"
        assert got[100]["text"].startswith(rare) and (got[102]["text"], got[102]["n_removed"]) == ("", 1)
        assert (got[103]["text"], got[103]["n_lines"], got[104]["text"]) == (None, 0, "")
        assert got[105]["n_removed"] == 1 and "and a tail" in got[105]["text"]
        assert L.dedup(df.limit(0), least_sites=10, broadcast_lines=most).collect() == []
    exact = df.where("doc_id < 22").where("source <> 's0' AND source <> 's1' AND source <> 's2'")  # nine sites: close to the threshold, counted exactly
    assert sum(r["n_removed"] for r in L.dedup(exact, least_sites=10).collect()) == 0 and sum(r["n_removed"] for r in L.dedup(exact, least_sites=9).collect()) > 0


def test_line_spread_spares_copies(spark):
    body = [f"line {k} of a text that is copied as a whole" for k in range(20)]
    near = lambda i: "\n".join([*body[:-1], f"last line {i}"])
    rows = [(i, near(i), f"s{i}") for i in range(12)] + [(50, "\n".join(body[:15] + [f"own {k} words, not shared" for k in range(12)]), "s1"), (60, body[3], "s2"), (61, "\n".join(body[:8]), "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most in (1000, 0):
        got = {r["doc_id"]: r["n_removed"] for r in L.dedup(df, 10, spare_copies=True, broadcast_lines=most).collect()}
        # Copies of the first text stay; pages with shared lines, and parts of it, lose them.
        assert got == {**dict.fromkeys(range(12), 0), 50: 15, 60: 1, 61: 8}
        assert {r["doc_id"]: r["n_removed"] for r in L.dedup(df, 10, broadcast_lines=most).collect()} == {0: 0, **dict.fromkeys(range(1, 12), 19), 50: 15, 60: 1, 61: 8}


def test_first_places_without_or_with_shared_ids(spark):
    line = "This very line stands at the head of all of them."
    for key in (None, 7):
        df = spark.createDataFrame([(key, f"{line}\nown text number {i}", f"s{i}", 5) for i in range(8)], "doc_id long, text string, source string, n_lines int")
        for most in (100, 0):
            found = L.dedup(df, 5, broadcast_lines=most)
            assert found.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
            rows = found.collect()
            assert sum(r["n_removed"] for r in rows) == 7 and sum(line in r["text"] for r in rows) == 1 and {r["n_lines"] for r in rows} == {2}


def test_many_cuts_in_one_text_take_linear_time(spark):
    import time

    shared = [f"line number {i}" for i in range(30_000)]
    df = spark.createDataFrame([(i, "\n".join([f"own {i}", *shared, "", f"end {i}"]), f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    began = time.time()
    rows = sorted(L.dedup(df, 5).collect(), key=lambda r: r["doc_id"])
    assert time.time() - began < 30
    assert [r["n_removed"] for r in rows] == [0] + [30_000] * 5 and rows[3]["text"] == "own 3\n\nend 3" and rows[0]["text"].count("\n") == 30_002
