"""The search rules against worked examples."""

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import search as S

RECORD = "record_id string, doc_id long, page int, block_id string, text string, role_confidence double, needs_review boolean"


def records(spark, rows):
    return spark.createDataFrame([(i, d, p, b, t, c, False) for i, d, p, b, t, c in rows], RECORD)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_query_tokens_drop_stop_words(spark):
    got = one(spark, "financial2 문서를 기반으로 KMW 기업 분석 보고서 작성해줘", T.query_tokens)
    assert "financial2" in got and "kmw" in got and "문서를" not in got and "작성해줘" not in got


def test_entities_are_codes_and_numbers(spark):
    assert one(spark, "케이엠더블유 KMW 032500 50,000원 분석", T.entity_candidates) == ["KMW", "032500", "50,000원"]


def test_lexical_query_dedupes(spark):
    df = spark.createDataFrame([(["KMW", "032500"], ["kmw", "재무", "정보"])], "e array<string>, t array<string>")
    assert df.select(T.lexical_query(F.col("e"), F.col("t"))).first()[0] == "KMW 032500 재무 정보"


def test_dedupe_keeps_order_and_limit(spark):
    df = spark.createDataFrame([([" a ", "A", "", "b", "a", "C"],)], "v array<string>")
    assert df.select(T.dedupe_texts(F.col("v"), 2)).first()[0] == ["a", "b"]


def test_bm25_golden(spark):
    rows = records(spark, [("r1", 1, 0, "b1", "KMW 032500 목표주가 재무 지표", 0.0), ("r2", 2, 0, "b2", "다른 기업 소개", 0.0)])
    hits = S.bm25(rows, spark.createDataFrame([("q", "KMW 재무")], "query_id string, query string")).collect()
    assert [(h["record_id"], h["matched"]) for h in hits] == [("r1", ["kmw", "재무"])]
    assert hits[0]["score"] == pytest.approx(1.2461072908942836, abs=1e-9)


def test_bm25_statistics_ignore_the_document_filter(spark):
    rows = records(spark, [(f"r{i}", i, 0, "b", "x y" if i else "x", 0.0) for i in range(5)])
    q = spark.createDataFrame([("q", "y")], "query_id string, query string")
    score = {h["record_id"]: h["score"] for h in S.bm25(rows, q).collect()}
    assert {h["record_id"]: h["score"] for h in S.bm25(rows, q, doc_ids=[1, 2]).collect()} == {k: score[k] for k in ("r1", "r2")}
    assert S.bm25(rows, q, top=0).collect() == []


def corpus_search(spark, rows, query, hits=(), expansion=None):
    recs = records(spark, rows)
    profile = S.profile(spark.createDataFrame([("q", query, expansion)], "query_id string, query string, expansion string"))
    scores = spark.createDataFrame([("q", r, d) for r, d in hits], "query_id string, record_id string, distance double")
    p = S.expand(profile)
    lexical = p.select("query_id", F.explode("lexical_queries").alias("query"))
    entities = p.select("query_id", F.explode("entities").alias("entity"))
    return S.order(S.merge(scores, S.bm25(recs, lexical), S.entity_scores(recs, entities)), recs).orderBy("rank").collect()


def test_common_entity_is_ignored_and_rare_one_counts(spark):
    rows = [(f"r{i}", 1, 0, f"block-{i}", f"트럼프 관련 일반 기사 {i}", 0.0) for i in range(1, 15)] + [("strong", 1, 0, "block-strong", "트럼프 미국 대통령 핵심 정책 발표", 0.6)]
    recs = records(spark, rows)
    entities = spark.createDataFrame([("q", "트럼프"), ("q", "미국"), ("q", "없음")], "query_id string, entity string")
    got = {r["entity"]: (r["match_count"], r["factor"], r["is_common"]) for r in S.ground_entities(recs, entities).collect()}
    assert got == {"트럼프": (15, 0.0, True), "미국": (1, 1.0, False), "없음": (0, 1.0, False)}
    assert [(r["record_id"], r["score"]) for r in S.entity_scores(recs, entities).collect()] == [("strong", 1.0)]


def test_half_strength_at_seven_of_thirty(spark):
    recs = records(spark, [(f"r{i}", 1, 0, f"b{i}", "트럼프 일반 문맥" if i < 7 else "다른 문맥", 0.0) for i in range(30)])
    row = S.ground_entities(recs, spark.createDataFrame([("q", "트럼프")], "query_id string, entity string")).first()
    assert (row["match_count"], row["factor"], row["is_common"]) == (7, 0.5, True)


def test_entity_only_fills_the_tail(spark):
    rows = [("b1", 1, 0, "block-1", "KMW 정책 핵심 발표", 0.4), ("b2", 1, 1, "block-2", "KMW 관련 보조 기사", 0.0), ("b3", 1, 2, "block-3", "다른 보조 기사", 0.0)]
    rows += [(f"b{i}", 1, i, f"block-{i}", f"무관한 문맥 {i}", 0.0) for i in range(4, 11)]
    got = corpus_search(spark, rows, "트럼프 정책", [("b1", 0.10)], '{"entities": ["KMW"]}')
    assert [g["record_id"] for g in got] == ["b1", "b2"]
    assert got[0]["score"] == pytest.approx(0.45 * 0.9 + 0.35 + 0.05 * 0.5 + 0.04) and got[1]["score"] == pytest.approx(0.10)


def test_broken_expansion_changes_nothing(spark):
    p = S.profile(spark.createDataFrame([("q", "KMW 재무 정보", "not-json")], "query_id string, query string, expansion string"))
    row, same = S.expand(p).first(), p.first()
    assert (row["semantic_queries"], row["lexical_queries"], row["entities"]) == (same["semantic_queries"], same["lexical_queries"], same["entities"])


def test_search_without_vectors(spark):
    recs = records(spark, [("r1", 1, 0, "b1", "KMW 재무", 0.0), ("r2", 1, 0, "b2", "기타", 0.0)])
    p = S.expand(S.profile(spark.createDataFrame([("q", "KMW 재무", None)], "query_id string, query string, expansion string")))
    found = S.search(recs, p).collect()
    assert [f["record_id"] for f in found] == ["r1"] and "semantic" not in found[0]["channels"]


def test_preview_cuts_long_text(spark):
    text = one(spark, "<p>" + "word " * 100 + "</p>", S.preview)
    assert len(text) <= 240 and text.endswith("...") and "<" not in text


def test_nearest_by_vector(spark):
    rng = __import__("random").Random(2)
    vectors = [(f"r{i}", [rng.random() for _ in range(3)]) for i in range(40)] + [("null", None), ("empty", []), ("other", [0.1, 0.2])]
    queries = [("q", 0, vectors[0][1]), ("q", 1, vectors[7][1]), ("p", 0, vectors[0][1]), ("p", 1, None)]
    own = spark.createDataFrame(vectors, "record_id string, embedding array<float>").repartition(5)
    found = S.nearest(own, spark.createDataFrame(queries, "query_id string, nth int, vector array<float>"), top=6).collect()
    got = {}
    for r in found:
        got.setdefault((r["query_id"], r["nth"]), {})[r["rank"]] = r["record_id"]
    f = lambda v: [__import__("struct").unpack("f", __import__("struct").pack("f", x))[0] for x in v]
    for name, nth, q in queries[:3]:
        best = sorted((round(sum((a - b) ** 2 for a, b in zip(f(v), f(q), strict=True)), 9), k) for k, v in vectors[:40])[:6]
        assert [got[name, nth][i + 1] for i in range(6)] == [k for _, k in best]
    assert set(got) == {("q", 0), ("q", 1), ("p", 0)}


def test_records_of_both_kinds(spark):
    pages = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True)], "doc_id long, page int, is_semantic boolean")
    blocks = spark.createDataFrame([(1, 1, 1, "parsed"), (1, 1, 2, "unused"), (1, 2, 1, "plain"), (1, 2, 2, " "), (2, 1, 1, "never")], "doc_id long, page int, block_index int, content string")
    semantic = spark.createDataFrame([(1, 1, 1, "told", "body", None, None, "thesis", 0.5, None), (1, 1, 3, "no block", None, None, None, None, None, True), (1, 2, 1, "not covered", None, None, None, None, 0.9, None)], "doc_id long, page int, block_index int, text string, generic_role string, domain_role string, generated_role_name string, section_purpose string, role_confidence double, needs_review boolean")
    got = {r["record_id"]: r for r in S.build_records(pages, blocks, semantic).collect()}
    assert set(got) == {"semantic:1:1:1", "semantic:1:1:3", "fallback:1:2:1"}  # a semantic page without blocks has no records
    assert (got["semantic:1:1:1"]["display"], got["semantic:1:1:3"]["display"], got["fallback:1:2:1"]["text"]) == ("parsed", "", "plain")
    assert (got["semantic:1:1:1"]["role_confidence"], got["semantic:1:1:3"]["needs_review"], got["fallback:1:2:1"]["role_confidence"]) == (0.5, True, 0.0)
    assert "generic_role: body" in got["semantic:1:1:1"]["embedding_text"] and "generic_role: unknown" in got["fallback:1:2:1"]["embedding_text"]
    meta = {r["record_id"]: r for r in S.metadata(S.build_records(pages, blocks, semantic)).collect()}
    assert meta["fallback:1:2:1"]["domain_role"] == "unknown" and meta["semantic:1:1:1"]["section_purpose"] == "thesis"


def test_words_in_texts_by_automaton(spark):
    import random

    draw = random.Random(0)
    word = lambda n: "".join(draw.choice("abü") for _ in range(draw.randint(0, n)))
    texts, words = [word(60) for _ in range(80)] + ["", None], [word(6) for _ in range(60)] + [None, "ü", "zzz", ""]
    records_ = spark.createDataFrame([(f"r{i}", t, "x") for i, t in enumerate(texts)], "record_id string, text string, word string")
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted((f"r{i}", w) for i, t in enumerate(texts) if t is not None for w in set(words) if w is not None and w in t)
    for most in (S.AUTOMATON_BYTES, 20):  # one automaton, and several passes
        assert sorted(map(tuple, S.contained(records_, asked, most_bytes=most).collect())) == want
    assert S.contained(records_.limit(0), asked).count() == 0 and S.contained(records_, asked.limit(0)).count() == 0
