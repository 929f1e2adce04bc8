"""ZIP packages of WARC records."""

import base64
import hashlib
import io

from pyspark.sql import functions as F
import pytest

from folio.llm import zip_warc as Z


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def package(zip64, index=True):
    out = File()
    writer = Z.PackageWriter(out, zip64)
    data = [Z.record(i, f"http://x/{i}", b"p" * i, None if i < 2 else 1)[0] for i in range(4)]
    writer.add("archive/a.warc.gz", b"".join(data))
    if index:
        at, lines = 0, ""
        for d in data:
            lines += f'u 0 {{"filename": "a.warc.gz", "offset": {at}, "length": {len(d)}}}\n'
            at += len(d)
        writer.add("indexes/i.cdxj", lines.encode())
    writer.add("other.txt", b"x")
    writer.close()
    return out, data


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("index", [False, True])
def test_members_and_records(zip64, index):
    out, data = package(zip64, index)
    reader = Z.PackageReader(out)
    assert set(reader.members()) == {"archive/a.warc.gz", "other.txt"} | ({"indexes/i.cdxj"} if index else set())
    raw = out.getvalue()
    assert [raw[at : at + n] for at, n in reader.records()] == data


def test_other_tools_can_read_it():
    import zipfile

    for zip64 in (False, True):
        out, data = package(zip64)
        with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
            assert z.testzip() is None and z.read("archive/a.warc.gz") == b"".join(data)


def test_reads_other_tools_packages():
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("archive/a.warc.gz", Z.record(7, None, b"abc", None)[0])
        z.writestr("packed.txt", b"x" * 1000, zipfile.ZIP_DEFLATED)
    file = File(raw.getvalue())
    assert list(Z.PackageReader(file).members()) == ["archive/a.warc.gz"] and len(Z.PackageReader(file).records()) == 1


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        Z.PackageReader(File(b"not a zip")).members()


def test_round_trip(spark):
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, None), (8, "a\r\nb", ""), (7, "u7", "ünique\0"), (3, "u3", "same"), (None, "n", "same"), (1, "big", "x" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = sorted(Z.read_packages(spark, Z.write_packages(df), payloads=True).collect(), key=lambda r: str(r["page_id"]))
    assert len(got) == len(rows) and all(r["digest_ok"] for r in got)
    want = {k: (h or "").encode() for k, _, h in rows}
    for r in got:
        body = want[r["page_id"]]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = {5: 3, 9: 8, None: 3}.get(r["page_id"])
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if first is not None else ("response", None))
        assert bytes(r["payload"]) == (b"" if first is not None else body)
    least = Z.read_packages(spark, Z.write_packages(df, least_bytes=5)).where("record_type = 'revisit'").count()
    assert least == 0
    assert Z.read_packages(spark, Z.write_packages(df.limit(0))).collect() == []
