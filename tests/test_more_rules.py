"""Ingest, decisions, templates, exports and images."""

import json

import pytest
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.operators import blocks as B
from folio.operators import catalog as C
from folio.operators import ingest as I
from folio.operators import layout as L
from folio.operators import roles as R
from folio.operators import search as S
from folio.operators import style as Y
from folio.streaming import trace as X


def test_ingest(spark):
    files = spark.createDataFrame([("a.pdf", "pdf", None, b"2"), ("b.png", "image", None, b"img"), ("c.pdf", "pdf", None, b"x"), ("d.txt", "text", "no", b"1")], "path string, kind string, reject_reason string, content binary")
    images = I.page_images(files, lambda content, dpi: [(dpi, dpi, b"p")] * int(content))
    assert sorted((r["path"], r["display_order"], r["width"]) for r in images.collect()) == [("a.pdf", 1, 300), ("a.pdf", 2, 300), ("b.png", 1, 0)]
    pages = images.select(F.lit(1).cast("long").alias("doc_id"), F.col("display_order").alias("page"), "image")
    parsed = I.parse_pages(pages, lambda: lambda png: '{"parsing_res_list": [{"block_content": "hi"}]}')
    assert {r["content"] for r in B.from_parsed_pages(parsed).collect()} == {"hi"}
    box = I.centre_boxes(spark.createDataFrame([(0, 10, 50, 30, 100, 100)], "x1 int, y1 int, x2 int, y2 int, width int, height int")).first()
    assert (box["cx"], box["cy"], box["w"], box["h"]) == (0.25, 0.2, 0.5, 0.2)


def test_decisions(spark):
    good = {"block_id": "b", "generic_role": "body", "role_confidence": 0.9, "reason": "one\ntwo"}
    rows = [json.dumps(good), f"```json\n{json.dumps(good)}\n```", "nothing", json.dumps(good | {"more": 1}), json.dumps(good | {"generic_role": "x"}), json.dumps(good | {"block_id": "c"}), json.dumps(good | {"role_confidence": 2})]
    df = spark.createDataFrame([(i, "b", r) for i, r in enumerate(rows)], "i int, block_id string, answer string")
    got = R.parse_decision(df).orderBy("i").collect()
    assert [r["error"] for r in got] == [None, None, "invalid_json"] + ["schema_mismatch"] * 4
    assert (got[0]["generic_role"], got[0]["confidence"], got[0]["reason"]) == ("body", 0.9, "one")


def test_template_and_context(spark):
    docs = spark.createDataFrame([(1, "Title here\n" + "\n".join("some words of a line that is long enough " * 2 for _ in range(14)))], "doc_id long, text string")
    blocks = B.canonical(B.derived(docs))
    pages = L.classify_pages(L.page_metrics(blocks))
    row = L.template(blocks, pages).first()
    made = json.loads(row["template"])
    assert row["template_id"].startswith("template-") and [p["page"] for p in made["pages"]] == [1, 2] and made["family"] in ("article", "report")
    payloads = [json.loads(r["payload"]) for r in R.context(blocks).collect()]
    assert len(payloads) == 15 and max(len(p.get("neighbours", [])) for p in payloads) <= 6


def test_catalog_helpers(spark):
    artifacts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id long, artifact_name string")
    assert C.clear(artifacts, 1).count() == 1 and C.clear(artifacts, names=["a"]).count() == 1 and C.clear(artifacts).count() == 0
    config = spark.createDataFrame([("schema_version", "6")], "key string, value string")
    C.check_version(config, 6)
    with pytest.raises(ValueError):
        C.check_version(config, 7)
    pages = spark.createDataFrame([(1, 1, "<p>1</p>"), (1, 2, "<p>2</p>")], "doc_id long, page int, html string")
    asked = spark.createDataFrame([(1, 2), (1, 3), (9, 1)], "doc_id long, page int")
    assert {(r["doc_id"], r["page"]): r["answer"] for r in C.fetch_page(pages, asked).collect()} == {(1, 2): "<p>2</p>", (1, 3): "page must be between 1 and 2", (9, 1): "document 9 does not exist"}
    trace, text = C.export_chat(spark.createDataFrame([(1, 1, 10, "hi"), (1, 2, 70, "{}")], "chat_id long, message_id long, depth int, content_text string"))
    assert [r["value"] for r in trace.collect()] == ["{}"] and text.first()["markdown"].startswith("## 1 (10)\n\nhi")
    listed = C.chat_list(spark.createDataFrame([(1, "a", None), (2, "b", "f")], "chat_id long, display_name string, rendered_file_id string")).collect()
    assert [(r["chat_id"], r["has_render"]) for r in listed] == [(2, True), (1, False)]


def test_search_trace(spark):
    recs = spark.createDataFrame([("r1", 1, 0, "b1", "KMW 재무", 0.0, False)], "record_id string, doc_id long, page int, block_id string, text string, role_confidence double, needs_review boolean")
    p = S.expand(S.profile(spark.createDataFrame([("q", "KMW 재무", None)], "query_id string, query string, expansion string")))
    events = S.trace_events(p, S.search(recs, p)).orderBy("at").collect()
    assert [e["event"] for e in events][0] == "query_preprocessed" and json.loads(events[-1]["payload"])["n"] == 1


def test_rendered_pages(spark):
    row = Y.rendered(spark.createDataFrame([(1, 1, 1, 0, 0, 10, 20, "<p/>", None, None, 2), (1, 1, 2, 0, 0, 1, 1, None, None, None, 1)], "doc_id long, page int, block_index int, x1 int, y1 int, x2 int, y2 int, html string, font_family string, color string, line_count int")).first()
    assert [(e["block_index"], e["css"]) for e in json.loads(row["json"])] == [(1, "font-family: sans-serif; color: #000; line-height: 10.0px;")]


def test_coercions_and_shown_values(spark):
    rows = spark.createDataFrame([(" 1e2 ", '["x", null, " "]', "[1, 2, 3, null]"), ("1d", "[", "[1, 2, 3, -4.9]"), (None, None, None)], "v string, items string, box string")
    got = rows.select(M.as_float(F.col("v")), M.as_list(F.col("items")), M.as_box(F.col("box"))).collect()
    assert [tuple(r) for r in got] == [(100.0, ["x"], None), (0.0, [], [1, 2, 3, -4]), (0.0, [], None)]
    typed = spark.createDataFrame([(100.0, True, [1, 2], {"k": "é"}, "x"), (0.12344, False, [], None, ""), (None, None, None, None, None)], "a double, b boolean, c array<int>, d map<string,string>, e string")
    shown = typed.select(*(M.shown(F.col(c), kind) for c, kind in typed.dtypes)).collect()
    assert [tuple(r) for r in shown] == [("100", "Yes", "1, 2", '{"k":"é"}', "x"), ("0.1234", "No", "-", "-", "-"), ("-",) * 5]


def test_log_rows_and_utc_times_in_any_zone(spark):
    messages = [(None, "null"), ('{"event": "a", "type": "b", "duration_ms": 2}', "whole"), ('{"broken', "broken"), ("{}", "empty")]
    rows = spark.createDataFrame(messages, "message string, run_id string").withColumn("at", F.timestamp_micros(F.lit(-1)))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r["run_id"]: r for r in X.recorded(rows).collect()}
        assert spark.range(1).select(X.run_name(F.timestamp_micros(F.lit(1_600_000_000_000_000)))).first()[0] == "20200913T122640000000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {r["time"] for r in got.values()} == {"1969-12-31T23:59:59.999999+00:00"} and got["null"]["ts"] == -1e-6
    assert [(got[k]["event"], got[k]["component"], got[k]["duration_ms"], got[k]["payload"]) for k in ("null", "whole", "broken", "empty")] == [
        ("message", "trace", None, "{}"), ("a", "trace", 2.0, None), ("message", "trace", None, '{"message":"{\\"broken"}'), ("trace", "trace", None, None),
    ]
