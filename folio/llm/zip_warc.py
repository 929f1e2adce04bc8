"""WARC archives packaged in ZIP files: written in parallel, read by ranges without extraction.

A package holds stored (uncompressed) members: ``archive/*.warc.gz`` with one
gzip member per record, and ``indexes/*.cdxj`` with the range of every record.
The reader finds the end record, follows the ZIP64 locator where there is one,
parses the central directory, resolves each stored member's data offset and
reads only the index; records are then fetched by coalesced range reads, spread
over tasks by segments of about ``SEGMENT`` bytes, so one huge package is read
by many tasks.  A package without an index is walked record by record.

Files live in the folder that the cluster shares and are opened by URI, so any
store that has a file system library works.  Each task writes under a name of
its own attempt; the manifest names only the files of attempts that succeeded.

Defined cases: a null payload is empty; a null URL is an empty target; of equal
payloads the record with the smallest id is the response, rows that repeat that
id too; a null id is kept as null and is never the smallest; an empty table
gives no package and no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, stage_path, staged

MEMBER = 16 << 20
PACKAGE = 256 << 20
SEGMENT = 4 << 20
#: Groups of equal payloads are broadcast up to this count, else joined by a shuffle.
BROADCAST_GROUPS = 100_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
U32 = 0xFFFFFFFF


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


# --- records ---------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, first: int | None) -> tuple[bytes, str, str]:
    """A gzip member with one WARC record, its type and its payload digest; ``first`` makes it a revisit."""
    kind = "response" if first is None else "revisit"
    digest = digest_of(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if first is None else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush(), kind, digest


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


def _fields(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in raw.split(b"\r\n")[1:])
    return {k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs if k}


def parse_record(data: bytes) -> Record:
    """One record from its bytes (already unzipped)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _fields(head)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, _fields(http), payload)


# --- packages --------------------------------------------------------------


class PackageWriter:
    """Writes stored members one after another, then the central directory."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.entries, self.at, self.zip64 = out, [], 0, zip64

    def add(self, name: str, data: bytes) -> None:
        crc, n, raw = zlib.crc32(data), len(data), name.encode()
        head = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 20, 1 << 11, 0, 0, 33, crc, n, n, len(raw), 0) + raw
        self.out.write(head)
        self.out.write(data)
        self.entries.append((raw, crc, n, self.at))
        self.at += len(head) + n

    def close(self) -> None:
        directory = b""
        for raw, crc, n, at in self.entries:
            wide = self.zip64 or at >= U32 or n >= U32
            extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
            directory += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if wide else 20, 1 << 11, 0, 0, 33, crc, U32 if wide else n, U32 if wide else n, len(raw), len(extra), 0, 0, 0, 0, U32 if wide else at) + raw + extra
        count, size, start = len(self.entries), len(directory), self.at
        self.out.write(directory)
        if self.zip64 or count >= 0xFFFF or start >= U32 or size >= U32:
            self.out.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, start) + struct.pack("<4sIQI", b"PK\6\7", 0, start + size, 1))
            count, size, start = 0xFFFF, U32, U32
        self.out.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, count, count, size, start, 0))


class PackageReader:
    """Finds the stored members of a package by range reads."""

    def __init__(self, file):
        self.file = file

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def members(self) -> dict[str, tuple[int, int]]:
        """Data offset and length of every stored member, by name."""
        total = self.file.size()
        tail_at = max(0, total - (1 << 16) - 22 - 20)
        tail = self.read(tail_at, total - tail_at)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no end of central directory")
        count, size, start = struct.unpack_from("<HII", tail, end + 10)
        if (count == 0xFFFF or U32 in (size, start)) and tail[end - 20 : end - 16] == b"PK\6\7":
            (wide,) = struct.unpack_from("<Q", tail, end - 20 + 8)
            count, size, start = struct.unpack_from("<QQQ", self.read(wide, 56), 32)
        directory, p, found = self.read(start, size), 0, {}
        for _ in range(count):
            sign, method, packed, full, n, extra, comment, at = struct.unpack_from("<4s6xH8xIIHHH8xI", directory, p)
            if sign != b"PK\1\2":
                raise ValueError("damaged central directory")
            name = directory[p + 46 : p + 46 + n].decode()
            packed, at = self._wide(directory[p + 46 + n : p + 46 + n + extra], packed, full, at)
            if method == 0:
                found[name] = (at, packed)
            p += 46 + n + extra + comment
        return {name: (self._data(at), n) for name, (at, n) in found.items()}

    @staticmethod
    def _wide(extra: bytes, packed: int, full: int, at: int) -> tuple[int, int]:
        p = 0
        while p + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, p)
            if kind == 1:
                q = p + 4
                for name in ("full", "packed", "at"):
                    if {"full": full, "packed": packed, "at": at}[name] == U32:
                        (value,) = struct.unpack_from("<Q", extra, q)
                        q += 8
                        packed, at, full = (value if name == "packed" else packed), (value if name == "at" else at), (value if name == "full" else full)
            p += 4 + n
        return packed, at

    def _data(self, at: int) -> int:
        head = self.read(at, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("damaged local header")
        n, extra = struct.unpack_from("<HH", head, 26)
        return at + 30 + n + extra

    def records(self) -> list[tuple[int, int]]:
        """Absolute offset and length of every record: from the indexes, or by walking the archives without one."""
        members = self.members()
        indexed, out = set(), []
        for name, (at, n) in members.items():
            if name.endswith(".cdxj"):
                for line in self.read(at, n).splitlines():
                    entry = json.loads(line[line.index(b"{") :])
                    base = members[f"archive/{entry['filename']}"][0]
                    indexed.add(f"archive/{entry['filename']}")
                    out.append((base + entry["offset"], entry["length"]))
        for name, (at, n) in members.items():
            if name.endswith(".warc.gz") and name not in indexed:
                out += self._walk(at, n)
        return sorted(out)

    def _walk(self, at: int, n: int) -> Iterator[tuple[int, int]]:
        self.file.seek(at)
        left, held, begin = n, b"", at
        while left or held:
            unzip, used = zlib.decompressobj(31), 0
            while not unzip.eof:
                if not held:
                    held = self.file.read(min(left, 1 << 20))
                    left -= len(held)
                    if not held:
                        raise ValueError("cut record")
                unzip.decompress(held)
                used += len(held) - len(unzip.unused_data)
                held = unzip.unused_data
            yield begin, used
            begin += used


# --- operators -------------------------------------------------------------


def write_packages(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``df``; returns the staged manifest (path, n_records, n_bytes)."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    hashed = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.length("payload"))
    firsts = staged(
        hashed.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.min("key").alias("first"), F.count("*").alias("times")).where("times > 1").select("digest", "first"),
        "warc-firsts",
    )
    n_groups = firsts.count()
    side = F.broadcast(firsts) if n_groups <= BROADCAST_GROUPS else firsts
    joined = hashed.join(side, "digest", "left") if n_groups else hashed.withColumn("first", F.lit(None).cast("long"))
    refers = F.when((F.col("n") >= least_bytes) & ~F.col("first").eqNullSafe(F.col("key")), F.col("first"))
    folder = stage_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        stem = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        made: list[tuple[str, int, int]] = []
        out = package = None
        member, entries, index, total, parts = [], 0, [], 0, 0

        def flush() -> None:
            nonlocal member, parts, size
            if member:
                package.add(f"archive/data-{parts:05d}.warc.gz", b"".join(member))
                member, size, parts = [], 0, parts + 1

        def finish() -> None:
            nonlocal out, package, entries, index, total, parts
            flush()
            package.add("indexes/index.cdxj", "".join(index).encode())
            package.close()
            out.close()
            made.append((f"{folder}/{stem}-{len(made):04d}.zip", entries, package.at))
            out, package, entries, index, total, parts = None, None, 0, [], 0, 0

        size = 0
        for part in slices(batches, "payload"):
            for k, u, body, first in zip(*(part.column(c).to_pylist() for c in ("key", "url", "payload", "first")), strict=True):
                if package is None:
                    out = fs.open_output_stream(f"{base}/{stem}-{len(made):04d}.zip")
                    package = PackageWriter(out)
                data, kind, digest = record(k, u, body, first)
                entry = {"filename": f"data-{parts:05d}.warc.gz", "offset": size, "length": len(data), "digest": f"sha1:{digest}", "mime": "warc/revisit" if kind == "revisit" else "text/html"}
                index.append(f"{(u or '-').split()[0] if (u or '-').split() else '-'} 19700101000000 {json.dumps(entry)}\n")
                member.append(data)
                entries, size, total = entries + 1, size + len(data), total + len(data)
                if size >= MEMBER:
                    flush()
                if total >= PACKAGE:
                    finish()
        if package is not None:
            finish()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "n_records", "n_bytes"])

    packed = joined.select("key", "url", "payload", refers.alias("first")).mapInArrow(run, "path string, n_records long, n_bytes long")
    return staged(packed, "warc-manifest")


def segments(manifest: DataFrame) -> DataFrame:
    """path, offset, lengths: runs of adjacent records of about ``SEGMENT`` bytes, read from the packages' directories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = file_system(path)
                with fs.open_input_file(place) as file:
                    ranges = PackageReader(file).records()
                rows, end = [], None
                for at, n in ranges:
                    if at != end or sum(rows[-1][1]) >= SEGMENT:
                        rows.append((at, []))
                    rows[-1][1].append(n)
                    end = at + n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["path", "offset", "lengths"])

    return manifest.select("path").mapInArrow(run, "path string, offset long, lengths array<long>")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


def read_packages(spark: SparkSession, manifest: DataFrame, payloads: bool = False, tasks: int | None = None) -> DataFrame:
    """Every record of the packages named in ``manifest``; with ``payloads`` also the payload's bytes."""

    def number(x: str | None) -> int | None:
        found = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(found) if found else None

    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * payloads
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, place = file_system(path)
                with fs.open_input_file(place) as file:
                    file.seek(at)
                    data = file.read(sum(lengths))
                rows, p = [], 0
                for n in lengths:
                    r = parse_record(gzip.decompress(data[p : p + n]))
                    p += n
                    stated = r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    whole = r.kind == "response"
                    digest = digest_of(r.payload) if whole else stated
                    size = len(r.payload) if whole else int(r.http.get("content-length", 0))
                    rows.append((number(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), size, digest, r.kind, number(r.headers.get("warc-refers-to")), digest == stated, *([r.payload] * payloads)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    # Ranges, not bytes, are dealt out: a few numbers for each segment.
    dealt = segments(manifest).repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, READ + ", payload binary" * payloads)
