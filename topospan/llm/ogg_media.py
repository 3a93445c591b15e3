"""Media columns: Ogg containers (RFC 3533).

Writing: a payload of 8-bit samples is cut into packets of `packet_bytes`, dealt round-robin over
`n_streams` logical streams, laced into pages of at most 255 segments (so that packets continue
over page borders) and interleaved in time order. Reading: pages are found by their capture
pattern, their CRC-32 is verified, lacing values are joined to packets across pages, pages are
demultiplexed by serial number, and a packet's timestamp follows from granule positions (samples
of its stream that are complete at the end of a page).

Defined results: a null or empty payload gives the bytes of an empty text's payload in the query
and streams without packets here; a page whose checksum fails is reported with `crc_ok` false
and its segments are left out, which marks the packet that lacks them as not complete; bytes
between pages are skipped; repeated rows give equal values; other columns are never read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings

FRAME = 576
PACKET_BYTES = 8 * FRAME
N_STREAMS = 2
RATE = 8000
_HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def ogg_crc(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, no inversion (RFC 3533).

    zlib's CRC is its mirror image, so it runs over mirrored bytes.
    """
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def padded(payload: bytes, frame: int = FRAME) -> bytes:
    """`payload` with bytes 255 up to a positive multiple of `frame`."""
    return payload + b"\xff" * ((-len(payload)) % frame if payload else frame)


@dataclass
class _Writer:
    serial: int
    sequence: int = 0
    samples: int = 0
    segments: list[int] = field(default_factory=list)
    body: list[bytes] = field(default_factory=list)
    granule: int = -1
    continued: bool = False

    def page(self, flags: int) -> bytes:
        body, lacing = b"".join(self.body), bytes(self.segments)
        head = _HEADER.pack(b"OggS", 0, flags | self.continued, self.granule, self.serial, self.sequence, 0, len(lacing))
        crc = ogg_crc(head + lacing + body)
        self.sequence += 1
        self.segments, self.body, self.granule = [], [], -1
        return head[:22] + crc.to_bytes(4, "little") + head[26:] + lacing + body

    def packet(self, data: bytes) -> Iterator[bytes]:
        """Laces a packet; yields the pages that it fills."""
        self.samples += len(data)
        at = 0
        while True:
            if len(self.segments) == 255:
                yield self.page(0)
                self.continued = at > 0
            part = data[at : at + 255]
            self.segments.append(len(part))
            self.body.append(part)
            at += 255
            if len(part) < 255:
                break
        self.granule = self.samples


def encode(payload: bytes, packet_bytes: int = PACKET_BYTES, n_streams: int = N_STREAMS) -> bytes:
    """An Ogg file of `payload`; equal payloads give equal files (serials derive from the content)."""
    seed = zlib.crc32(payload)
    streams = [_Writer((seed + k * 0x9E3779B1) & 0xFFFFFFFF) for k in range(n_streams)]
    out = []
    for k, s in enumerate(streams):
        s.segments, s.body, s.granule = [12], [struct.pack("<4sHHI", b"PCM8", k, n_streams, RATE)], 0
        out.append(s.page(2))
    for k in range(0, len(payload), packet_bytes):
        s = streams[(k // packet_bytes) % n_streams]
        for page in s.packet(payload[k : k + packet_bytes]):
            out.append(page)
    for s in streams:
        out.append(s.page(4))
        s.continued = False
    return b"".join(out)


@dataclass
class Page:
    offset: int
    size: int
    serial: int
    sequence: int
    granule: int
    continued: bool
    first: bool
    last: bool
    crc_ok: bool
    lacing: bytes
    body: bytes


def pages(media: bytes) -> Iterator[Page]:
    """The pages of a file, resynchronising at the capture pattern."""
    at = media.find(b"OggS")
    while 0 <= at and at + 27 <= len(media):
        _, version, flags, granule, serial, sequence, crc, n = _HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(media):
            at = media.find(b"OggS", at + 1)
            continue
        raw = media[at:end]
        ok = ogg_crc(raw[:22] + b"\0\0\0\0" + raw[26:]) == crc
        yield Page(at, len(raw), serial, sequence, granule, bool(flags & 1), bool(flags & 2), bool(flags & 4), ok, lacing, raw[27 + n :])
        at = media.find(b"OggS", end if ok else at + 1)


@dataclass
class Packet:
    serial: int
    index: int
    start: int
    data: bytes
    complete: bool


def packets(found: list[Page]) -> dict[int, list[Packet]]:
    """Per logical stream, in page order, its packets; `start` is the first sample's granule."""
    streams: dict[int, list[Packet]] = {}
    for serial in dict.fromkeys(p.serial for p in found):
        own = sorted((p for p in found if p.serial == serial and p.crc_ok), key=lambda p: p.sequence)
        done: list[Packet] = []
        parts: list[bytes] = []
        open_, whole, expected, clock = False, True, None, 0
        for p in own:
            if expected is not None and p.sequence != expected:
                whole = False
            expected = p.sequence + 1
            if open_ and not p.continued:
                done.append(Packet(serial, len(done), clock, b"".join(parts), False))
                parts, open_, whole = [], False, True
            elif p.continued and not open_:
                whole = False
            at, ended = 0, []
            for n in p.lacing:
                parts.append(p.body[at : at + n])
                at += n
                open_ = n == 255
                if not open_:
                    ended.append(Packet(serial, len(done) + len(ended), 0, b"".join(parts), whole))
                    parts, whole = [], True
            if p.first:
                done += ended
                continue
            if ended:
                clock = p.granule if p.granule >= 0 else clock + sum(len(x.data) for x in ended)
                end = clock
                for x in reversed(ended):
                    x.start = end - len(x.data)
                    end = x.start
            done += ended
        if open_ and parts:
            done.append(Packet(serial, len(done), clock, b"".join(parts), False))
        streams[serial] = done
    return streams


def decode(media: bytes) -> tuple[bytes, list[Page], dict[int, list[Packet]]]:
    """The payload, read back: demultiplexed packets merged by timestamp, then stream order."""
    found = list(pages(media))
    streams = packets(found)
    order = {}
    data = []
    for serial, own in streams.items():
        if own and own[0].data[:4] == b"PCM8":
            order[serial] = struct.unpack("<4sHHI", own[0].data)[1]
            data += own[1:]
    data.sort(key=lambda x: (x.start, order[x.serial]))
    return b"".join(x.data for x in data), found, streams


def feature(samples: bytes, found: list[Page], streams: dict[int, list[Packet]]) -> str:
    """Counts of the container and level, loudness and zero crossings of the unsigned samples."""
    x = np.frombuffer(samples, np.uint8)
    wave = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    total, square = int(wave.sum(dtype=np.int64)), int(np.dot(wave.astype(np.float64), wave.astype(np.float64)))
    n = max(1, len(x))
    return f"streams={len(streams)};pages={len(found)};bad={sum(not p.crc_ok for p in found)};packets={sum(map(len, streams.values()))};samples={len(x)};ms={len(x) * 1000 // RATE};mean={total / n:.6f};rms={(square / n) ** 0.5:.6f};crossings={crossings}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, crc_ok boolean"


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text stored as an Ogg file, read back and described; one row per row."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                media = encode(padded(raw))
                back, found, streams = decode(media)
                rows.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, found, streams), all(p.crc_ok for p in found)))
            names = [x.split()[0] for x in DIGEST.split(", ")]
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DIGEST)


PACKETS = "doc_id long, serial long, packet long, granule long, seconds double, complete boolean, data binary"


def to_ogg(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): the stored form of each text."""

    def run(batches):
        for batch in batches:
            media = [encode(padded(x.encode("utf-8", "surrogatepass"))) for x in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, media binary")


def read_packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", rate: int = RATE) -> DataFrame:
    """One row per packet of each file: stream, timestamp and data. A null file has no packets."""

    def run(batches):
        for batch in batches:
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(key, x.serial, x.index, x.start, x.start / rate, x.complete, x.data) for own in packets(list(pages(media or b""))).values() for x in own]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "serial", "packet", "granule", "seconds", "complete", "data"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("serial", pa.int64()), ("packet", pa.int64()), ("granule", pa.int64()), ("seconds", pa.float64()), ("complete", pa.bool_()), ("data", pa.binary())]))

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, PACKETS)
