"""Model calls under a bound, the two-phase file sink, fonts, and documents at depth."""

import json
import os
import struct
import time

import pytest
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.operators import model_calls
from folio.sources import blobs


def good(block_id, **more):
    return json.dumps({"block_id": block_id, "generic_role": "body", "domain_role": None, "role_confidence": 0.9, "reason": "r"} | more)


def make_call(folder):
    """A model that fails, repeats, delays; it notes every call and how many were open."""

    def call(payload, attempt):
        import os
        import threading
        import time

        held = json.loads(payload)
        k = held["k"]
        state = call.__dict__
        lock = state.setdefault("lock", threading.Lock())
        with lock:
            state["open"] = state.get("open", 0) + 1
            with open(f"{folder}/{os.getpid()}", "a") as f:
                f.write(f"{k} {attempt} {state['open']}\n")
        try:
            time.sleep(0.002 * (k % 7))
            if k % 10 == 0:
                raise OSError("down")
            if k % 10 == 1 or (k % 10 == 2 and attempt == 0):
                return "no JSON"
            return good(held["block_id"], **({"oddity": 1} if k % 10 == 3 else {}))
        finally:
            with lock:
                state["open"] -= 1

    return call


def test_calls_are_bounded_in_order_and_fail_alone(spark, tmp_path):
    rows = spark.range(300).coalesce(2).select(F.col("id").alias("k"), F.concat(F.lit("b"), "id").alias("block_id"), F.lit("x").alias("answer"))
    rows = rows.withColumn("payload", F.when(F.col("k") != 299, F.to_json(F.struct("k", "block_id"))))
    found = model_calls.ask(rows, make_call(str(tmp_path)), most_open=8).withColumn("place", F.monotonically_increasing_id()).orderBy("place").collect()
    assert [r.k for r in found] == sorted(r.k for r in found) and len(found) == 300
    by_kind = {0: ("backend_error", 1), 1: ("invalid_json", 2), 2: (None, 2), 3: ("schema_mismatch", 2)}
    for r in found[:-1]:
        assert (r.call_error, r.attempts) == by_kind.get(r.k % 10, (None, 1))
        assert (json.loads(r.answer)["block_id"] == r.block_id) if r.call_error is None else True
    assert (found[-1].answer, found[-1].call_error, found[-1].attempts) == (None, None, 0)
    noted = [tuple(map(int, line.split())) for name in os.listdir(tmp_path) for line in open(tmp_path / name)]
    assert max(n for *_, n in noted) <= 8 and {k: max(a for j, a, _ in noted if j == k) for k, _, _ in noted} == {r.k: r.attempts - 1 for r in found[:-1]}


def test_checks_are_those_of_the_parser(spark):
    from folio.operators import roles

    answers = [
        good("b"), good("c"), good("b", role_confidence=1.5), good("b", generic_role="x"), good("b", domain_role="x"), good("b", more=1), good("b", generated_role_level=" Block "), good("b", generated_role_level="x"),
        "```json\n" + good("b") + "\n```", "<think>{</think>" + good("b"), "text " + good("b"), "[1]", "", "{", good("b", role_confidence=None),
    ]
    df = spark.createDataFrame([(i, "b", a) for i, a in enumerate(answers)], "i int, block_id string, answer string")
    parsed = {r.i: r.error for r in roles.parse_decision(df).collect()}
    assert {i: model_calls.check_decision('{"block_id": "b"}', a) for i, a in enumerate(answers)} == parsed


def test_blocks_that_are_not_due_are_not_asked(spark):
    df = spark.createDataFrame([("b1", "{}", True, 0.9), ("b2", "{}", False, 0.9), ("b3", "{}", True, 0.1)], "block_id string, payload string, eligible boolean, quality double")

    def call(payload, attempt):
        return good("b1")

    # The payload names no block, so that its answer is about another one.
    got = {r.block_id: (r.source, r.fallback_reason, r.attempts) for r in model_calls.decide(df, call).collect()}
    assert got == {"b1": ("fallback", "schema_mismatch", 2), "b2": ("fallback", "ineligible_block", 0), "b3": ("fallback", "low_page_quality", 0)}
    assert model_calls.decide(df.limit(0), call).count() == 0


def left(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_files_are_there_all_or_none(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a.txt", b"one"), ("deep/b.bin", bytes(range(256))), ("c", None)], "name string, content binary").repartition(3)
    blobs.write_blobs(rows, path)
    blobs.write_blobs(spark.createDataFrame([("d", bytearray(b"four"))], "name string, content binary"), path)
    got = {r.name: bytes(r.content) for r in blobs.read_blobs(spark, path).collect()}
    assert got == {"a.txt": b"one", "deep/b.bin": bytes(range(256)), "d": b"four"}
    before = left(path)
    assert any(n.endswith("/c") for n in before)
    many = spark.range(100).repartition(4).select(F.concat(F.lit("x"), "id").alias("name"), F.encode(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise("y"), "UTF-8").alias("content"))
    with pytest.raises(Exception, match="lost"):
        blobs.write_blobs(many, path)
    for name in ("../up", "/root", ""):
        with pytest.raises(Exception, match="not a path"):
            blobs.write_blobs(spark.createDataFrame([("ok", b"1"), (name, b"2")], "name string, content binary"), path)
    for _ in range(50):  # tasks that outlive the abort
        if not any(n.startswith("_pending") for n in os.listdir(path)):
            break
        time.sleep(0.2)
    assert [n for n in left(path) if not n.startswith("_aborted/")] == before and not [n for n in os.listdir(path) if n.startswith("_pending")]


def font(records, texts, tables=1):
    names = struct.pack(">HHH", 0, len(records), 6 + 12 * len(records)) + b"".join(struct.pack(">6H", *r) for r in records) + texts
    return struct.pack(">IHHHH", 0x10000, tables, 0, 0, 0) + b"name" + struct.pack(">III", 0, 28, len(names)) + names


def test_font_names(spark, tmp_path):
    wide = "Grünes Gras".encode("utf-16-be")
    files = {
        "wide.ttf": (font([(3, 1, 1033, 1, 4, 0), (3, 1, 1033, 4, len(wide), 0)], wide), "Grünes Gras"),
        "mac.ttf": (font([(1, 0, 0, 4, 6, 0)], "Grün.x".encode("mac_roman")), "Grün.x"),
        "first.ttf": (font([(1, 0, 0, 4, 1, 0), (3, 1, 0, 4, 2, 1)], b"A\0B"), "A"),
        "none.ttf": (font([(3, 1, 0, 1, 2, 0)], b"\0B"), None),
        "cut.ttf": (font([(3, 1, 0, 4, 200, 0)], b"\0B"), None),
        "text.ttf": (b"hello", None),
        "short.ttf": (b"\0", None),
    }
    path = str(tmp_path)
    blobs.write_blobs(spark.createDataFrame([(n, c) for n, (c, _) in files.items()] + [("other.otf", b"x")], "name string, content binary"), path)
    assert {r.name: r.font for r in blobs.fonts(spark, path).collect()} == {n: f for n, (_, f) in files.items()}


def test_documents_at_depth(spark):
    doc = '<document id="o">\n<page>x</page></document>'
    shut = lambda key, text: json.dumps({"a": 1, key: text}).replace("</", "<\\/")
    cases = {
        doc: doc,
        "x " + shut("content", "y " + shut("html", shut("output", doc))): doc,
        shut("html", "nothing"): None,
        json.dumps({"output": 3, "html": "<page a='1'>p</page>"}).replace("</", "<\\/"): "<document id=\"output\">\n<page a='1'>p</page>\n</document>",
        "so <DOCUMENT x='1'>open <page>": "<DOCUMENT x='1'>open <page></document>",
        "<page>1</page> and <PAGE>2</PAGE>": '<document id="output">\n<page>1</page>\n<PAGE>2</PAGE>\n</document>',
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string")
    got = {r.t: r.d for r in df.select("t", M.document_block(F.col("t")).alias("d")).collect()}
    assert got == cases | {None: None}
