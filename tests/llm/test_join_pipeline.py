"""The Jaccard join and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import metric_join as J
from folio.llm import queries
from folio.llm import unigram_langid
from folio.llm._words import shingle_sets, text_hash, word_hashes


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    sets = {k: shingles(t, size) for k, t in rows}
    up = {k: k for k in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def corpus(seed=0):
    """Prose, exact copies, near copies on both sides of the threshold, a passage in many texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(40))
    texts = []
    for _ in range(60):
        texts.append(" ".join(word() for _ in range(rng.randrange(1, 160))))
    for base in [*texts[:12], passage]:
        for _ in range(rng.randrange(1, 14)):
            words = base.split()
            for _ in range(rng.randrange(0, 1 + len(words) // 20)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    texts += [texts[0], texts[0].upper(), "", None, " \n", "a", "A", "a b", "b a", "word " * 3000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (1, 50)])
def test_components_by_brute_force(spark, size, percent):
    rows = corpus(size)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.classify(df, size=size, percent=percent).collect()}
    assert got == brute(rows, size, percent)


def test_hot_shingles_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT", 3)
    monkeypatch.setattr(J, "SALT_ROWS", 2)
    monkeypatch.setattr(J, "BROADCAST_NODES", 5)
    monkeypatch.setattr(J, "BROADCAST_BYTES", 5)
    rows = corpus(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 85)


@pytest.mark.parametrize("known, shingles", [(40, 100), (0, 1500)])
def test_open_members_in_parts_and_few_known_shingles(spark, monkeypatch, known, shingles):
    monkeypatch.setattr(J, "KNOWN", known)
    monkeypatch.setattr(J, "GROUP_SHINGLES", shingles)
    rows = corpus(9)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.classify(spark.createDataFrame(rows, "doc_id long, text string"), percent=60).collect()}
    assert got == brute(rows, 4, 60)


def test_known_shingles_are_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(J, "KNOWN", 30)
    rows = [(i, " ".join(f"w{k}" for k in range(40) if i % (k + 1) == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, text string")
    order = J._frequent(df, 1, 200 * 40)
    counts = sorted((sum(i % (k + 1) == 0 for i in range(200)) for k in range(40)), reverse=True)
    assert 0 < len(order.counts) <= 30 and sorted(order.counts.tolist(), reverse=True) == counts[: len(order.counts)]


def test_edges(spark):
    assert J.classify(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d e"), (5, "a b c d e"), (None, "solo text here now"), (7, "x y"), (7, "p q r s t u v w")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in J.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (None, None), (7, 7), (7, 7)], key=str)


def test_region_join_connects_all_links():
    rng = np.random.default_rng(0)
    for percent in (85, 60):
        base = [np.sort(rng.choice(10_000, 60, replace=False)).astype(np.uint64) for _ in range(12)]
        sets = [np.unique(np.where(rng.uniform(size=60) < 0.06, rng.integers(0, 10_000, 60), b)).astype(np.uint64) for b in base for _ in range(12)]
        up = J.Forest(len(sets))
        for i, j in J.join_region(sets, percent):
            assert J.links_at(sets[i], sets[j], percent)[0]
            up.join(i, j)
        for i in range(len(sets)):
            for j in range(i):
                if J.links_at(sets[i], sets[j], percent)[0]:
                    assert up.find(i) == up.find(j)


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_bounds(percent):
    for n in range(1, 400):
        least = -(-n * percent // 100)
        assert J.prefix_length(n, percent) == n - least + 1
        for m in range(least, n + 1):
            if 100 * m >= percent * n:
                assert J.size_band(n, percent) - J.size_band(m, percent) in (0, 1) if percent < 100 else True


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98)], "a long, b long")
    got = {r["node"]: r["component"] for r in J.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 99: 98, 100: 98}


def test_word_hashes():
    import pyarrow as pa

    rows = ["The the  THE", None, "", "\x0bé\x00 É\n", "a" * 5000]
    hashes, counts = word_hashes(pa.array(rows))
    assert counts.tolist() == [3, 0, 0, 2, 1] and len(set(hashes[:3].tolist())) == 1 and hashes[0] == text_hash(b"the") and hashes[3] != hashes[4]
    assert [len(s) for s in shingle_sets(pa.array(rows), 4)] == [1, 0, 0, 1, 1]


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    stock = {"en": "the and thing of that water house with some other words".split(), "de": "der und nicht schule straße über wasser haus mit anderen".split()}
    text = lambda x, n: " ".join(rng.choice(stock[x]) + rng.choice(["", "s", "en"]) for _ in range(n))
    rows = [(i, "\n".join(text(x, 12) for _ in range(6)) + "\nRead our cookie notice on this page", x, f"s{i % 12}", 0) for i in range(120) for x in [("en", "de")[i % 2]]]
    rows += [(200 + i, rows[0][1], "en", "s1", 0) for i in range(3)] + [(300, None, "en", "s1", 0), (301, "", "en", "s1", 0), (302, "123 456", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    docs, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"{k}"))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "line_dedup":
            assert docs.where(F.col("text").contains("cookie notice")).count() <= 4 and docs.where("n_chars <> 0 AND n_chars <> length(text)").count() == 0
        if name == "near_duplicates":
            assert {r[0] for r in docs.select("doc_id").collect()} == {k for k, (_, c) in brute([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80).items() if k == c}
    assert counts[0] == 123 and counts[1] == 123 and counts[2] == 120
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]


@pytest.fixture
def odd(spark):
    """Null and repeated ids, repeated rows, null, empty and very long texts, extra columns."""
    t, u, r = ("\n".join(f"{x} word{k} and the thing of that water {x}" for k in range(9)) for x in "tur")
    rows = [(1, t, "a"), (None, t, "b"), (None, u, None), (7, r, "a"), (7, r, "a"), (8, "p q r s t u v", "b"), (8, "other words under the same number", "b"), (9, None, "a"), (None, None, None), (10, "", "b"), (11, "long " * 60_000, "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).withColumn("__nth", F.lit("clash"))


def texts(df):
    return sorted(((r["doc_id"], r["text"] and r["text"][:6]) for r in df.collect()), key=str)


def test_near_duplicates_keep_rows_of_null_and_repeated_ids(spark, odd):
    out = corpus_pipeline.near_duplicates(spark, odd, "")
    assert out.columns == odd.columns
    assert texts(out) == texts(odd.where("NOT (doc_id IS NULL AND source <=> 'b')").distinct())


def test_stages_take_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, "")
            if name != "packing":
                assert out.columns == odd.columns
            if docs is not odd:
                assert out.count() == 0
    assert corpus_pipeline.line_dedup(spark, odd, "").count() == 11
    packed = corpus_pipeline.packing(spark, odd, "").collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed) and sum(r["piece"] == 0 for r in packed) == 11


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
    assert unigram_langid.UNDETERMINED == "und"
