"""MPEG streams and URL rules."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from folio.llm import mpeg_audio as A
from folio.llm import url_filter as U


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 1152, 1344, 1345, 100_000])
def test_stream_round_trip(n):
    payload = random.Random(n).randbytes(n)
    s = A.parse(A.encode(payload))
    assert s.payload == A.padded(payload) and len(s.payload) % 192 == 0
    assert (s.crc_errors, s.lost_bytes, s.vbr_frames, s.tags["unpadded_bytes"]) == (0, 0, len(s.offsets), str(n))
    assert s.duration_us == len(s.offsets) * 1152 * 1_000_000 // 32000


def test_resynchronises_and_reports_crc():
    data = bytearray(A.encode(random.Random(1).randbytes(20_000)))
    whole = A.parse(bytes(data))
    data[whole.offsets[3]] = 0
    data[whole.offsets[6] + 8] ^= 1
    damaged = A.parse(bytes(data))
    assert len(damaged.offsets) == len(whole.offsets) - 1 and damaged.lost_bytes == whole.lengths[3] and damaged.crc_errors == 1
    assert A.parse(b"").offsets == [] and A.parse(b"\xff" * 5000).offsets == [] and A.parse(b"no audio").duration_us == 0


def test_tags_on_both_ends():
    s = A.parse(A.encode(b"x") + b"TAG" + b"title".ljust(125, b"\0"))
    assert s.tags["TIT1"] == "title" and len(s.offsets) == 1


def test_crc_by_hand():
    crc = 0xFFFF
    for byte in b"123456789":
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    import numpy as np

    assert A.crc16(np.frombuffer(b"123456789", np.uint8)[None, :])[0] == crc


def test_media_columns(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "héllo"), (None, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = A.probe(A.store(df, "text", keep=("doc_id",)), keep=("doc_id",)).collect()
    for (key, text), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r["doc_id"], "héllo"))), strict=True):
        full = A.padded((text or "").encode())
        if r["doc_id"] == key:
            assert r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-16:]) and r["n_bytes"] == len((text or "").encode())
    by = {r["doc_id"]: r for r in got}
    assert by[1]["media_sha256"] == by[4]["media_sha256"] and by[2]["feature"] == by[3]["feature"]
    assert A.probe(A.store(df.limit(0), "text", keep=("doc_id",)), keep=("doc_id",)).collect() == []


RULES = [U.Rule("com", "/", "allow"), U.Rule("example.com", "/en/", "block"), U.Rule("www.example.com", "/en/", "allow"), U.Rule("net", "/es/", "block")]


def test_rules_and_list(spark):
    urls = {
        "http://A.Example.COM/en/x?q": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "x://com": ("com", "", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://spam.org/a/b#f": ("spam.org", "/a/b", None, "block"), "http://x.spam.org": ("x.spam.org", "", None, "block"), "http://ok.org/": ("ok.org", "/", None, "allow"),
        "http://part.org/in/side": ("part.org", "/in/side", None, "block"), "http://part.org/inside": ("part.org", "/inside", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://net/es/": ("net", "/es/", "net/es/", "block"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(0, next(iter(urls)), "r")], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("spam.org/",), ("part.org/in/",), (None,), ("spam.org/",)], "u string")
    got = U.judge(pages, listed, RULES).collect()
    assert len(got) == len(urls) + 1
    expected = list(urls.values())
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected[r["page_id"]]
    none = U.judge(pages, listed.limit(0), RULES).where("rule IS NULL AND verdict = 'block'").count()
    assert none == 0 and U.judge(pages.limit(0), listed, RULES).count() == 0


def test_filter_has_no_false_negatives(spark):
    listed = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bloom = U.build_bloom(listed, 5000)
    import numpy as np

    own = np.array([r["h"] for r in listed.collect()], np.int64).view(np.uint64)
    assert bloom.might_contain(own).all()
    other = np.array([r["h"] for r in spark.range(5000, 15000).select(F.xxhash64("id").alias("h")).collect()], np.int64).view(np.uint64)
    assert bloom.might_contain(other).mean() < 0.03
    tiny = U.build_bloom(listed, 5000, most_bytes=64)  # saturated, still no false negative
    assert len(tiny.words) == 1 and tiny.might_contain(own).all()


def test_lookups_are_canonical_and_bounded(spark):
    assert U.canonical("user:pw@spam.org.:8080", "/a/./b/../%7Ex/%2f") == ("spam.org", "/a/~x/%2F")
    assert [U.canonical("h", p)[1] for p in ("", "/..", "/a/..", "/a/b/..", "/a/.", "/../a")] == ["/", "/", "/", "/a/", "/a/", "/a"]
    assert U.lookups("x.spam.org", "/a/b", 2, 3) == ["org/", "org/a/", "spam.org/", "spam.org/a/"]
    urls = ["http://u@x.spam.org.:80/q", "http://part.org/x/../in/side", "http://part.org:/in/", "http://part.org/" + "a/" * 8000, "http://" + "a." * 8000 + "spam.org/", "http://part.org/in/" + "/" * 16000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("spam.org/",), ("part.org/in/",)], "u string")
    from time import monotonic

    began = monotonic()
    got = {r["page_id"]: r["verdict"] for r in U.judge(pages, listed, RULES[1:]).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "block", 5: "block"} and monotonic() - began < 20
