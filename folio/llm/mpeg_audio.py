"""Media columns: MPEG audio Layer III streams as binary columns.

``encode`` stores a payload losslessly in the main-data area of a variable
bitrate stream: an ID3v2.4 tag, a ``Xing`` frame with counts and a seek table,
then CRC-protected mono frames at 32 kHz.  ``parse`` is a general stream
reader: it skips tags, resynchronises on frame headers, reads the variable
bitrate table, verifies each frame's CRC and keeps exact sample counts and
frame offsets.  Both work on one binary value, so the DataFrame operators are
narrow maps: no shuffle, and memory bounded by the longest value of a batch.

Defined cases: a null payload is stored as an empty one; an empty payload
still fills one 192-byte unit; bytes that are no stream give no frames and a
duration of 0; a damaged header loses that frame only, and the reader picks up
at the next pair of agreeing headers.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import as_bytes, slices

UNIT = 192
#: Fixed values of the audio format: kbit/s by bitrate index for MPEG-1 and MPEG-2 Layer III, Hz by index.
BITRATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSION_BITS = {3: 1, 2: 2, 0: 2.5}
SIDE_INFO = {(1, True): 17, (1, False): 32, (2, True): 9, (2, False): 17}
RATE = 32000
SAMPLES = 1152
#: Header, CRC and side information of a protected mono MPEG-1 frame.
OVERHEAD = 4 + 2 + 17


def _smallest(units: int) -> tuple[int, int]:
    """Bitrate index and frame length of the smallest frame that holds so many units."""
    for index, kbit in enumerate(BITRATES[1]):
        length = 144 * kbit * 1000 // RATE
        if length - OVERHEAD >= units * UNIT:
            return index, length
    raise ValueError(units)


#: By number of units: bitrate index and frame length; the most units in one frame.
MOST_UNITS = (144 * 320_000 // RATE - OVERHEAD) // UNIT
FRAMES = [_smallest(n) for n in range(MOST_UNITS + 1)]


def _crc_table() -> np.ndarray:
    """CRC-16 of the format: polynomial 0x8005, most significant bit first."""
    crc = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        crc = np.where(crc & 0x8000, (crc << 1) ^ 0x8005, crc << 1) & 0xFFFF
    return crc


CRC_TABLE = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC of each row of a (frames, bytes) matrix, starting at 0xFFFF."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = ((crc << 8) & 0xFFFF) ^ CRC_TABLE[(crc >> 8) ^ column]
    return crc


def _head(units: int) -> bytes:
    """Header, CRC and side information of a frame with so many units (kept in the private bits)."""
    header = bytes((0xFF, 0xFA, FRAMES[units][0] << 4 | 2 << 2, 0xC0))
    side = bytes((0, units << 2)) + bytes(15)
    crc = int(crc16(np.frombuffer(header[2:] + side, np.uint8)[None, :])[0])
    return header + struct.pack(">H", crc) + side


HEADS = [_head(n) for n in range(MOST_UNITS + 1)]


def _xing_lead() -> bytes:
    """Header, CRC and empty side information of the frame that holds the variable-bitrate table."""
    header = bytes((0xFF, 0xFA, FRAMES[1][0] << 4 | 2 << 2, 0xC0))
    crc = int(crc16(np.frombuffer(header[2:] + bytes(15 + 2), np.uint8)[None, :])[0])
    return header + struct.pack(">H", crc) + bytes(17)


XING_LEAD = _xing_lead()


@functools.lru_cache(4096)
def _units(head: bytes) -> int | None:
    """Units in a frame by its header and side information; None if the CRC differs."""
    crc = int(crc16(np.frombuffer(head[2:4] + head[6:], np.uint8)[None, :])[0])
    return head[7] >> 2 & 31 if crc == int.from_bytes(head[4:6]) else None


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _id3(values: dict[str, str]) -> bytes:
    frames = b""
    for key, value in values.items():
        body = b"\x03" + key.encode() + b"\0" + value.encode()
        frames += b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _synchsafe(len(frames)) + frames


def padded(payload: bytes) -> bytes:
    """The payload with bytes 32 up to a positive multiple of the unit."""
    return payload + b" " * (-len(payload) % UNIT if payload else UNIT)


def encode(payload: bytes) -> bytes:
    """An MPEG audio stream that holds ``payload`` (padded to whole units)."""
    full = padded(payload)
    units, rest = divmod(len(full) // UNIT, MOST_UNITS)
    wide = MOST_UNITS * UNIT
    index, length = FRAMES[MOST_UNITS]
    frames = np.zeros((units, length), np.uint8)
    frames[:, :OVERHEAD] = np.frombuffer(HEADS[MOST_UNITS], np.uint8)
    frames[:, OVERHEAD : OVERHEAD + wide] = np.frombuffer(full, np.uint8, units * wide).reshape(units, wide)
    audio = frames.tobytes()
    if rest:
        audio += (HEADS[rest] + full[units * wide :]).ljust(FRAMES[rest][1], b"\0")
    count = units + bool(rest)
    first = FRAMES[1][1]
    total = first + len(audio)
    starts = first + np.minimum(np.arange(100) * count // 100, units) * length
    toc = bytes(np.minimum(starts * 256 // total, 255).astype(np.uint8))
    xing = b"Xing" + struct.pack(">III", 7, count, total) + toc
    return _id3({"unpadded_bytes": str(len(payload))}) + (XING_LEAD + xing).ljust(first, b"\0") + audio


@dataclass
class Stream:
    """What ``parse`` finds in a stream; offsets count from the first byte."""

    tags: dict[str, str] = field(default_factory=dict)
    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    crc_errors: int = 0
    lost_bytes: int = 0
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes | None = None
    payload: bytes = b""

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


def _header(data: bytes, at: int) -> tuple | None:
    """(version, protected, frame length, rate, mono, samples) of a Layer III header, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b, c, d = data[at + 1], data[at + 2], data[at + 3]
    version, index, rate = VERSION_BITS.get(b >> 3 & 3), c >> 4, c >> 2 & 3
    if version is None or b >> 1 & 3 != 1 or index in (0, 15) or rate == 3:
        return None
    hz, low = RATES[version][rate], version != 1
    length = (72 if low else 144) * BITRATES[2 if low else 1][index] * 1000 // hz + (c >> 1 & 1)
    return version, not b & 1, length, hz, d >> 6 == 3, 576 if low else 1152


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """User text of ID3v2 and the title of ID3v1; where audio begins and ends."""
    tags, at, end = {}, 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = sum((x & 0x7F) << s for x, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        stop, p = min(end, at + 10 + size), at + 10
        while p + 10 <= stop and data[p : p + 4].strip(b"\0"):
            if data[at + 3] >= 4:
                n = sum((x & 0x7F) << s for x, s in zip(data[p + 4 : p + 8], (21, 14, 7, 0), strict=True))
            else:
                n = int.from_bytes(data[p + 4 : p + 8])
            body = data[p + 11 : min(stop, p + 10 + n)].decode("utf-8", "replace")
            key, _, value = body.partition("\0")
            tags[key if data[p : p + 4] == b"TXXX" else data[p : p + 4].decode("latin-1")] = value or key
            p += 10 + n
        at = stop + (10 if data[at + 5] & 0x10 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        tags["TIT1"] = data[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1")
        end -= 128
    return tags, min(at, end), end


def _follows(data: bytes, at: int, end: int, head: tuple) -> bool:
    """True if a frame's end meets an agreeing header or the end of the stream."""
    after = at + head[2]
    if after == end:
        return True
    other = _header(data, after) if after < end else None
    return other is not None and (other[0], other[3]) == (head[0], head[3])


def parse(data: bytes) -> Stream:
    """Walk a stream frame by frame, resynchronising where a header is damaged."""
    out = Stream()
    out.tags, at, end = _tags(data)
    synced, kinds, memo = False, [], {}
    while at < end:
        raw = data[at : at + 4]
        head = memo.get(raw)
        if head is None and (head := _header(data, at)) is not None:
            memo[raw] = head
        if head is None or at + head[2] > end or not (synced or _follows(data, at, end, head)):
            synced = False
            to = data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            out.lost_bytes += to - at
            at = to
            continue
        synced = True
        out.offsets.append(at)
        out.lengths.append(head[2])
        kinds.append(head)
        at += head[2]
    if not out.offsets:
        return out
    out.rate = kinds[0][3]
    side = SIDE_INFO[(1 if kinds[0][0] == 1 else 2, kinds[0][4])]
    lead = out.offsets[0] + 4 + 2 * kinds[0][1] + side
    if data[lead : lead + 4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(data[lead + 4 : lead + 8]), lead + 8
        if flags & 1:
            out.vbr_frames, p = int.from_bytes(data[p : p + 4]), p + 4
        if flags & 2:
            out.vbr_bytes, p = int.from_bytes(data[p : p + 4]), p + 4
        if flags & 4:
            out.toc = data[p : p + 100]
        for x in (out.offsets, out.lengths, kinds):
            x.pop(0)
    out.samples = sum(k[5] for k in kinds)
    if out.offsets and all(k[0] == 1 and k[1] and k[4] for k in (kinds[0], kinds[-1])):
        parts = []
        for o in out.offsets:
            units = _units(data[o : o + OVERHEAD])
            if units is None:
                out.crc_errors += 1
            else:
                parts.append(data[o + OVERHEAD : o + OVERHEAD + units * UNIT])
        out.payload = b"".join(parts)
    return out


def store(df: DataFrame, column: str, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the string (or binary) ``column`` of every row as an MPEG stream in ``media``."""
    kept = df.select(*keep, df[column].alias("__payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__payload"):
            made = [encode(x or b"") for x in as_bytes(part.column("__payload"))]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(made, pa.binary())], names=[*keep, media])

    schema = df.select(*keep).schema.add(media, "binary", False)
    return kept.mapInArrow(run, schema)


PROBED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames int, crc_errors int, lost_bytes long, rate int, samples long, duration_us long, seek_offsets array<long>"


def probe(df: DataFrame, media: str = "media", keep: tuple[str, ...] = (), seek_every: int = 16) -> DataFrame:
    """``keep`` columns and what :func:`parse` reads from each stored stream.

    ``seek_offsets`` has the byte offset of every ``seek_every``-th frame.
    """

    def row(data: bytes) -> tuple:
        s = parse(data)
        seek = s.offsets[::seek_every]
        seek_crc = zlib.crc32(np.array(s.offsets, "<i8").tobytes())
        feature = (
            f"frames={len(s.offsets)};samples={s.samples};rate={s.rate};duration_us={s.duration_us};"
            f"vbr_frames={s.vbr_frames};vbr_bytes={s.vbr_bytes};crc_errors={s.crc_errors};lost={s.lost_bytes};seek_crc32={seek_crc}"
        )
        return (
            int(s.tags.get("unpadded_bytes", len(s.payload))), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]),
            len(data), hashlib.sha256(data).hexdigest(), feature, len(s.offsets), s.crc_errors, s.lost_bytes, s.rate, s.samples, s.duration_us, seek,
        )

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in PROBED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media):
            columns = zip(*(row(x or b"") for x in part.column(media).to_pylist()), strict=True)
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *made], names=[*keep, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), PROBED])
    return df.select(*keep, media).mapInArrow(run, schema)
