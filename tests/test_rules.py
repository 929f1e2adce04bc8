"""Text, layout, role, evidence, style and log rules on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.functions import text as T
from folio.operators import blocks as B
from folio.operators import catalog as C
from folio.operators import evidence as E
from folio.operators import layout as L
from folio.operators import roles as R
from folio.operators import style as Y
from folio.sources import files
from folio.streaming import trace as X


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_text_measures(spark):
    v = F.col("v")
    got = values(spark, ["a a a a b b b b b c c", "aaab  bbbbb", ""], T.repeated_share(v), T.longest_run(v), T.text_quality(v))
    assert got[0][:2] == (3.0, 1) and got[1][:2] == (0.0, 5) and got[2] == (0.0, 1, 0.0)


def test_clean_text(spark):
    assert values(spark, [" a\r\nb \t c\n\n\n\nd  ", None, " "], T.clean_text(F.col("v"))) == [("a\nb c\n\nd",), ("",), ("",)]


def test_language_and_scripts(spark):
    v = F.col("v")
    scripts = T.script_counts(v)
    assert values(spark, ["한글 text 1", "漢字かな!", ""], *scripts, T.language_of(*scripts[:3])) == [(2, 5, 0, 0, "en"), (0, 0, 4, 1, "unknown"), (0, 0, 0, 0, "ko")]


def test_names(spark):
    v = F.col("v")
    assert values(spark, [" Key Data! ", "7", "", "a"], T.role_name(v), T.safe_name(v)) == [("key_data", "Key_Data"), ("role_7", "7"), (None, "call"), ("a_block", "a")]
    assert values(spark, ["1"], T.stable_hash(F.col("v"), F.col("v"))) == [("37824dbee1fa",)]


BLOCK = "doc_id long, page int, block_index int, raw_label string, content string, x1 int, y1 int, x2 int, y2 int, width int, height int"


def page(spark, rows):
    return L.classify_pages(L.page_metrics(B.canonical(spark.createDataFrame(rows, BLOCK))))


def test_archetypes(spark):
    table = lambda d, i, y: (d, 1, i, "table", "t", 0, y, 1000, y + 200, 1000, 1000)
    text = lambda d, i, y, t="words " * 12, x=400: (d, 1, i, "text", t, x, y, 1000, y + 300, 1000, 1000)
    rows = [table(1, i, 200 * i) for i in range(1, 4)] + [text(2, 1, 0)]
    rows += [(3, 1, 1, "list", "Compliance Notice", 0, 700, 900, 800, 1000, 1000)]
    rows += [text(4, 1, 0), (4, 1, 2, "text", "BUY", 0, 0, 300, 100, 1000, 1000), (4, 1, 3, "text", "목표주가", 0, 200, 300, 300, 1000, 1000)]
    rows += [(5, 1, 1, "image", "", 0, 0, 10, 10, 1000, 1000)]
    got = {r["doc_id"]: r["archetype"] for r in page(spark, rows).collect()}
    assert got == {1: "evidence_table", 2: "body_narrative", 3: "compliance", 4: "cover_summary", 5: "unknown"}


def test_columns_and_order(spark):
    rows = [(1, 1, i + 1, "text", "some words that are long enough", x, 100, x + 100, 200, 1000, 1000) for i, x in enumerate((700, 0, 350))]
    assert page(spark, rows).first()["columns"] == 3
    assert B.canonical(spark.createDataFrame(rows, BLOCK)).orderBy("reading_order").first()["x1"] == 700


def test_parsed_pages(spark):
    pages = spark.createDataFrame([(1, 1, '{"parsing_res_list": [{"block_bbox": [1, 2, 3, 4], "block_label": "text", "block_content": "x", "block_order": 5}, {}]}')], "doc_id long, page int, json string")
    got = [tuple(r) for r in B.from_parsed_pages(pages).orderBy("block_index").collect()]
    assert got == [(1, 1, 1, "text", "x", 1, 2, 3, 4, 1, 1, 5), (1, 1, 2, "unknown", "", 0, 0, 0, 0, 1, 1, None)]


def test_role_gate(spark):
    rows = [
        ("a", 0.9, True, None, "body", "supporting_argument", 0.9), ("b", 0.9, True, None, "body", "report_title", 0.9), ("c", 0.9, True, None, "body", "supporting_argument", 0.6),
        ("d", 0.9, True, None, "body", None, 0.5), ("e", 0.4, True, None, "body", None, 0.9), ("f", 0.9, False, None, "body", None, 0.9), ("g", 0.9, True, "invalid_json", None, None, None), ("h", 0.9, True, None, "odd", None, 0.9),
    ]
    df = spark.createDataFrame(rows, "block_id string, quality double, eligible boolean, error string, generic_role string, domain_role string, confidence double")
    got = {r["block_id"]: (r["source"], r["fallback_reason"], r["domain_role"], r["needs_review"]) for r in R.gate(df).collect()}
    assert got == {
        "a": ("model", None, "supporting_argument", False), "b": ("model", None, None, False), "c": ("model", None, None, True), "d": ("fallback", "low_role_confidence", None, True),
        "e": ("fallback", "low_page_quality", None, True), "f": ("fallback", "ineligible_block", None, True), "g": ("fallback", "invalid_json", None, True), "h": ("fallback", "schema_mismatch", None, True),
    }
    row = R.summary(R.gate(df)).first()
    assert (row["attempted"], row["accepted"], row["fallbacks"]) == (6, 3, 4)


def test_policy(spark):
    df = spark.createDataFrame([("evidence", "key_data_box"), ("section_heading", "key_data_box"), ("body", None), ("metadata", None), ("summary", None), ("unknown", None)], "g string, d string")
    used, purpose = R.policy(F.col("g"), F.col("d"), F.lit(None).cast("string"))
    assert [tuple(r) for r in df.select(used, purpose).collect()] == [(False, "evidence_panel"), (True, "evidence_panel"), (True, "supporting_argument"), (False, None), (True, "investment_summary"), (False, None)]


def test_json_answers(spark):
    v = F.col("v")
    rows = ['<think>x {</think> ```json\n{"a": 1}\n```', 'so {"a": {"b": 2}} end', "none", None]
    assert values(spark, rows[1:], M.json_object(v), M.json_object(v, whole=True), M.json_text(v)) == [('{"a": {"b": 2}}', None, '{"a": {"b": 2}}'), (None, None, None), (None, None, None)]


def test_document_block(spark):
    rows = ['x <document id="o"><page/></document> y', '{"output": "<document>z</document>"}', "a <page>1</page> b <page>2</page>", "nothing"]
    assert values(spark, rows, M.document_block(F.col("v"))) == [('<document id="o"><page/></document>',), ("<document>z</document>",), ('<document id="output">\n<page>1</page>\n<page>2</page>\n</document>',), (None,)]


def test_matched_via_and_unsupported(spark):
    payload = '{"evidence": [{"document_id": "n", "block_id": "b", "page_id": 1, "matched_via": "entity"}, {"document_id": "n", "block_id": "c", "page_id": 2, "matched_via": ["semantic", "bm25", "entity", "bm25"]}], "unsupported_blocks": [{"block_id": "target-page-1-block-11", "support_status": "partially_supported", "required_action": "empty_cells", "unsupported_selectors": {"columns": ["2026F"]}}, {"block_id": "not-a-block"}, {"block_id": "output-page-2-block-3", "support_status": "bad", "required_action": "bad"}]}'
    df = spark.createDataFrame([(1, payload)], "id long, payload string")
    assert [r["matched_via"] for r in E.evidence(df).orderBy("at").collect()] == ["entity", "semantic,bm25,entity"]
    got = [(r["block_id"], r["support_status"], r["required_action"], r["columns"]) for r in E.unsupported(df).orderBy("at").collect()]
    assert got == [("output-page-1-block-11", "partially_supported", "empty_cells", ["2026F"]), ("output-page-2-block-3", "unsupported", "empty_block", [])]


@pytest.mark.parametrize(
    "action, columns, rows, found",
    [
        ("empty_table_values", [], "<tr><td>지표</td><td>2025P</td></tr><tr><td>PER</td><td>10.7</td></tr>", "<tr><td>지표</td><td>2025P</td></tr><tr><td>PER</td><td>-</td></tr>"),
        ("empty_cells", ["3/24F"], "<tr><td>구분</td><td>3/23</td><td>3/24F</td></tr><tr><td>상황</td><td>유예</td><td>계속</td></tr>", "<tr><td>구분</td><td>3/23</td><td>3/24F</td></tr><tr><td>상황</td><td>유예</td><td>-</td></tr>"),
    ],
)
def test_emptied_tables(spark, action, columns, rows, found):
    wrap = '<div id="output-page-1-block-1"><table>{}</table></div>'
    df = spark.createDataFrame([(wrap.format(rows), action, columns)], "html string, required_action string, columns array<string>")
    first = E.sanitize(df)
    assert [(r["sanitized"], r["violates"]) for r in first.collect()] == [(wrap.format(found), True)]
    assert E.sanitize(first.select(F.col("sanitized").alias("html"), "required_action", "columns")).first()["violates"] is False


def test_emptied_paragraph():
    assert E._emptied('<div id="a"><p>text 50%</p></div>', "empty_paragraph", []) == '<div id="a"><p></p></div>'


def plain_slice(source, found):
    """The whole table of distances, with where each slice begins; of equal ways a substitution before a letter left out before one too many."""
    n, m = len(source), len(found)
    if not n or not m:
        return 0, 0
    row = [(0, j) for j in range(n + 1)]
    for i in range(1, m + 1):
        made = [(i, 0)]
        for j in range(1, n + 1):
            ways = [(row[j - 1][0] + (found[i - 1] != source[j - 1]), 0, row[j - 1][1]), (row[j][0] + 1, 1, row[j][1]), (made[j - 1][0] + 1, 2, made[j - 1][1])]
            cost, _, start = min(ways)
            made.append((cost, start))
        row = made
    _, length, end = min((cost, j - start, j) for j, (cost, start) in enumerate(row))
    return end - length, end


def test_edit_slices_equal_the_whole_table():
    rng = np.random.default_rng(0)
    sources, founds = [], []
    for _ in range(400):
        letters = list("abcdefg"[: rng.integers(2, 8)])
        sources.append("".join(rng.choice(letters, rng.integers(0, 40))))
        founds.append("".join(rng.choice([*letters, "\U0001f600"], rng.integers(0, 15))))
    long = "".join(rng.choice(list("abcde "), 900))
    for size in (40, 63, 64, 90):
        at = int(rng.integers(0, 700))
        sources.append(long)
        founds.append((long[at : at + 9] + "zz" + long[at + 12 : at + size + 9])[:size])
    want = [plain_slice(s, f) for s, f in zip(sources, founds, strict=True)]
    assert Y._best_slices(sources, founds) == want
    assert [Y._best_slice(s, f) for s, f in zip(sources, founds, strict=True)] == want


def test_altered_pieces_are_found_again(spark):
    from folio.plans import catalogue

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalogue.QUERIES["edit_slice_altered"](spark, sf).collect()
    assert len(rows) == len(texts)
    near = [r for r in rows if len(texts[r.doc_id] or "") > 200]
    assert sum(texts[r.doc_id][r.first : r.stop] == texts[r.doc_id][r.first :][: r.stop - r.first] and abs(r.stop - r.first - 40) <= 8 for r in near) >= 0.95 * len(near)
    for r in sorted(rows, key=lambda r: len(texts[r.doc_id] or ""))[:60:3]:
        t = texts[r.doc_id] or ""
        piece = t[r.at - 1 : r.at + 39]
        found = piece[:15].translate(str.maketrans("eo", "xy")) + "q" + piece[16:46]
        assert (r.first, r.stop) == plain_slice(t, found)


def test_lines_grow(spark):
    rows = [(1, 1, "a", 50, 0, 10), (1, 1, "b", 0, 4, 14), (1, 1, "c", 20, 9, 18), (1, 1, "d", 0, 40, 50)]
    got = {r["box_id"]: (r["line"], r["place"]) for r in Y.group_lines(spark.createDataFrame(rows, "doc_id long, page int, box_id string, x1 int, y1 int, y2 int")).collect()}
    assert got == {"b": (0, 0), "c": (0, 1), "a": (0, 2), "d": (1, 0)}


def test_characters_and_ink(spark):
    rows = [("b", "ab", 0, 10, "a"), ("b", "ab", 0, 8, "a"), ("b", "ab", 9, 20, "b"), ("b", "ab", 4, 15, "b")]
    got = [(r["xmin"], r["xmax"]) for r in Y.align_characters(spark.createDataFrame(rows, "block_id string, text string, xmin int, xmax int, char string")).orderBy("place").collect()]
    assert got == [(0, 8), (9, 20)]
    # Letters without a box are passed over; boxes that touch don't follow one another; a box may hold several letters.
    assert Y.best_chain("xabc", [(0, 5, "a"), (6, 9, "b"), (10, 15, "c")]) == [(0, 5, "a"), (6, 9, "b"), (10, 15, "c")]
    assert Y.best_chain("ab", [(0, 5, "a"), (5, 9, "b")]) == [(0, 5, "a")] and Y.best_chain("abcd", [(0, 5, "a"), (7, 9, "cd"), (6, 6, "b")]) == [(0, 5, "a"), (6, 6, "b"), (7, 9, "cd")]
    assert Y.best_chain("", [(0, 1, "a")]) == [] and Y.best_chain("abc", []) == [] and Y.best_chain("abc", [(0, 1, "z")]) == []


def test_message_groups(spark):
    rows = [(1, i, d, "") for i, d in enumerate((10, 60, 70, 50, 60))]
    got = C.message_groups(spark.createDataFrame(rows, "chat_id long, message_id long, depth int, content_text string")).orderBy("first_id").collect()
    assert [(r["first_id"], r["n_messages"], r["is_log"]) for r in got] == [(0, 1, False), (1, 2, True), (3, 1, False), (4, 1, True)]


def test_upsert_and_validity(spark):
    old, new = (spark.createDataFrame(r, "doc_id long, artifact_name string, content_json string") for r in ([(1, "a", '{"k": 1}'), (2, "a", "{")], [(1, "a", '{"k": 2}')]))
    rows = C.upsert(old, new, ["doc_id", "artifact_name"])
    valid, invalid = C.split_valid(rows, "k int")
    assert [(r["doc_id"], r["parsed"]["k"]) for r in valid.collect()] == [(1, 2)] and [r["doc_id"] for r in invalid.collect()] == [2]


def test_run_status(spark):
    df = spark.createDataFrame([("run_completed", None), ("step", None), (None, None), ("step", "failed")], "e string, s string")
    assert [r[0] for r in df.select(X.status_of(F.col("e"), F.col("s"))).collect()] == ["completed", "running", "not_started", "failed"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"event": "a"}\n\n[1]\nbroken\n{"event": "b"}\n')
    assert [r["event"] for r in X.read_lines(spark, str(tmp_path), "event string").collect()] == ["a", "b"]


def test_files(spark, tmp_path):
    for name in ("b.PDF", "a.pdf", "c.txt", "d.xyz", "e"):
        (tmp_path / name).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in files.pdf_files(spark, str(tmp_path)).collect()] == ["a.pdf", "b.PDF"]
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["reject_reason"] is None) for r in files.uploads(spark, str(tmp_path)).collect()}
    assert got == {"b.PDF": ("pdf", True), "a.pdf": ("pdf", True), "c.txt": ("text", False), "d.xyz": (None, False), "e": (None, False)}
    assert files.safe_path("/r", "a/b") == "/r/a/b"
    for bad in ("/a", "../a", "a/../../b", ""):
        with pytest.raises(ValueError):
            files.safe_path("/r", bad)


def _chains(text, boxes):
    """Most letters that any chain of boxes spells, by trying all."""
    best = 0
    for k in range(1 << len(boxes)):
        chain = [b for i, b in enumerate(boxes) if k >> i & 1]
        if all(a[1] < b[0] for a, b in zip(chain, chain[1:], strict=False)):
            at = 0
            for c in "".join(b[2] for b in chain):
                at = text.find(c, at) + 1
                if not at:
                    break
            else:
                best = max(best, sum(len(b[2]) for b in chain))
    return best


def test_best_chain_by_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(6)))
        boxes = sorted(((x := rng.randrange(12), x + rng.randrange(4), rng.choice(["a", "b", "c", "ab"])) for _ in range(rng.randrange(7))), key=lambda b: (b[1], b[0], b[2]))
        chain = Y.best_chain(text, boxes)
        assert sum(len(b[2]) for b in chain) == _chains(text, boxes) and all(a[1] < b[0] for a, b in zip(chain, chain[1:], strict=False))
