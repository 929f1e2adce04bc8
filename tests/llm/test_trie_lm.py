"""The trie model against counts in dictionaries."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm.elias_fano import Bits, EliasFano, Level, Trie
from folio.llm import trie_lm


@pytest.mark.parametrize("n, top", [(0, 5), (1, 0), (5, 3), (1000, 10**9), (1000, 20), (20000, 10**6), (70000, 10**12)])
def test_sequence_round_trip(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n))
    packed = EliasFano(EliasFano.pack(values))
    assert (packed.get(np.arange(n)) == values).all()
    some = rng.integers(0, max(n, 1), 50) if n else np.zeros(0, np.int64)
    assert (packed.get(some) == values[some]).all()
    queries = np.r_[rng.integers(0, top + 2, 300), values[some]]
    first, stop = np.sort(rng.integers(0, n + 1, (2, len(queries))), axis=0)
    at, equal = packed.successor(queries, first, stop)
    for x, i, j, k, e in zip(queries.tolist(), first.tolist(), stop.tolist(), at.tolist(), equal.tolist(), strict=True):
        expected = i + np.searchsorted(values[i:j], x)
        assert e == (expected < j and values[expected] == x) and (not e or k == expected)


def test_search_decodes_no_whole_sequence():
    """A lookup in a mapped sequence touches a few stretches, not all of it."""
    values = np.cumsum(np.random.default_rng(1).integers(0, 1000, 500_000))
    packed = EliasFano(EliasFano.pack(values))
    touched = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            touched.append(np.size(np.asarray(at)))
            return np.asarray(super().__getitem__(at))

    packed.low, packed.high.words = packed.low.view(Watched), packed.high.words.view(Watched)
    at, equal = packed.successor(values[[5, 400_000]], np.array([0, 399_000]), np.array([500_000, 401_000]))
    assert at.tolist() == [5, 400_000] and equal.all()
    assert sum(touched) < 100


def test_bits_rank():
    bits = (np.random.default_rng(3).random(3000) < 0.3).astype(np.uint8)
    own = Bits(Bits.pack(bits))
    here, before = own.rank(np.arange(3000))
    assert (here == bits).all() and (before == np.cumsum(bits) - bits).all()


def test_level_finds_values_of_the_group_only():
    groups, values = np.array([0, 0, 2, 2, 2]), np.array([3, 9, 0, 1, 9])
    level = Level(Level.pack(groups, values, 4))
    at, inside = level.find(np.array([0, 0, 1, 2, 2, 3, -1]), np.array([9, 4, 3, 0, 9, 0, 3]))
    assert at.tolist() == [1, -1, -1, 2, 4, -1, -1] and inside.tolist() == [1, -1, -1, 0, 2, -1, -1]


def test_trie_matches_dictionaries():
    rng, d = np.random.default_rng(0), 0.7
    counts = Counter(zip((rng.zipf(1.6, 6000) % 20 + 1).tolist(), (rng.zipf(1.5, 6000) % 15).tolist(), (rng.zipf(1.4, 6000) % 39 + 1).tolist(), strict=True))
    keys = sorted(counts)
    v, u, w = (np.array(x, np.int64) for x in zip(*keys, strict=True))
    trie = Trie(Trie.pack(v, u, w, np.array([counts[k] for k in keys], float), d, trie_lm.lean))
    pairs, total2, total3 = Counter(), Counter(), Counter()
    for (a, b, c), n in counts.items():
        pairs[a, c] += n
        total2[a] += n
        total3[a, b] += n
    used3 = defaultdict(float)
    for (a, b, c), n in counts.items():
        if b:
            used3[a, b] += (n - d) / total3[a, b]
    qv, qu, qw = rng.integers(0, 24, 4000), rng.integers(0, 17, 4000), rng.integers(0, 42, 4000)
    got_a, got_b = trie.query(qv, qu, qw)
    for a, b, c, x, y in zip(qv.tolist(), qu.tolist(), qw.tolist(), got_a, got_b, strict=True):
        left = trie_lm.lean(total2[a]) if a in total2 else 1
        one = (1 - left) * pairs[a, c] / total2[a] if a in total2 else 0
        if (a, b) in used3:
            n, rest = counts.get((a, b, c), 0), 1 - used3[a, b]
            one, left = ((n - d) / total3[a, b] if n else 0) + rest * one, rest * left
        assert x == pytest.approx(one, rel=0.03, abs=1e-6) and y == pytest.approx(left, rel=0.03)


def test_codes():
    x = np.array([0.0, 1.0, 0.5, 1e-9])
    assert trie_lm.decode(trie_lm.encode(x)) == pytest.approx(x, rel=1.2e-2)
    assert (trie_lm.decode(trie_lm.encode(x))[0]) == 0


def _brute(rows):
    """Base figures of (key, text, held) rows."""
    split = {k: (t or "").encode().lower().split() + [None] for k, t, _ in rows}
    counts = Counter(w for k, _, held in rows if not held for w in split[k])
    total = sum(counts.values())
    return {k: (len(ws), sum(counts[w] > 0 for w in ws), total, sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in ws)) for k, ws in split.items()}


def test_scores(spark):
    import zlib

    rng = np.random.default_rng(5)
    words = [f"W{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 50), p=np.arange(60, 0, -1) / 1830))) for i in range(200)] + [(900, None), (901, ""), (902, " \n\t"), (903, "x " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({})
    got = {r["doc_id"]: r for r in trie_lm.score(df).collect()}
    expected = _brute([(k, t, zlib.crc32(str(k).encode()) % 10 == 0) for k, t in rows])
    assert got.keys() == expected.keys()
    for k, (n, known, total, base) in expected.items():
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base)
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 10 == 0)
        assert r["score"] < 0
    # Probabilities after one context sum to one at most: the score of a text can't beat certainty.
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def _model(rows):
    """log10 scores of (key, text, held) rows by dictionaries."""
    d, split = trie_lm.DISCOUNT, {k: ["<s>", "<s>", *(t or "").lower().split(), "</s>"] for k, t, _ in rows}
    one, two, three = Counter(), defaultdict(Counter), defaultdict(Counter)
    for k, _, held in rows:
        for u, v, w in zip(split[k], split[k][1:], split[k][2:], strict=False):
            if not held:
                one[w] += 1
                two[v][w] += 1
                three[u, v][w] += 1
    total = sum(one.values())

    def p(u, v, w):
        x = (one[w] + trie_lm.ADD) / (total + trie_lm.ADD * (len(one) + 1))
        if v in two:
            n = sum(two[v].values())
            left = trie_lm.LEAN * n**-trie_lm.FALL
            x = (1 - left) * two[v][w] / n + left * x
        if (u, v) in three:
            found = three[u, v]
            n = sum(found.values())
            x = max(found[w] - d, 0) / n + d * len(found) / n * x
        return x

    return {k: sum(np.log10(p(*t)) for t in zip(s, s[1:], s[2:], strict=False)) for k, s in split.items()}


@pytest.mark.parametrize("shard_tokens", [10**6, 400, 60])
def test_scores_by_dictionaries(spark, shard_tokens):
    """The last two split common words over many shards, by their words before and by their successors."""
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(200)])
    chance = 1 / np.arange(1, 201)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=chance / chance.sum())), i % 5 == 0) for i in range(200)] + [(300, None, False), (301, "unseen w0 unseen2", True)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["score"] for r in trie_lm.score(df, held=F.col("doc_id").isin([k for k, _, held in rows if held]), shard_tokens=shard_tokens).collect()}
    expected = _model(rows)
    assert got.keys() == expected.keys()
    for k, x in expected.items():
        assert got[k] == pytest.approx(x, rel=0.01)


def test_rare_words_are_contexts_and_successors(spark):
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join([*rng.choice(common, 20), f"once{i}", f"alone{i}"]), False) for i in range(100)]
    # A passage of names that stands in three training texts and one held-out text.
    names = " ".join(f"name{i}" for i in range(12))
    rows += [(200 + i, f"{names} {rng.choice(common)}", i == 3) for i in range(4)]
    got = trie_lm.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), held=F.col("doc_id") == 203)
    expected = _model(rows)
    for r in got.collect():
        assert r["score"] == pytest.approx(expected[r["doc_id"]], rel=0.02)


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert trie_lm.score(empty).collect() == []
    from pyspark.sql import functions as F

    row = trie_lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), held=F.lit(True)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
