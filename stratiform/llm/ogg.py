"""Ogg as a media column: pages, lacing, logical streams, checksums, granule positions.

``encode`` stores bytes losslessly as 8-bit samples in a physical Ogg stream of two interleaved
logical streams (samples, and an index of packet checksums). ``decode`` reads any Ogg bytes back.
Both are narrow: no shuffle, and memory of one batch.

Defined cases: a null text counts as empty; the payload is then 64 bytes 0. Null media give null
streams and a feature of zeros. Repeated rows and null ids pass through. A page whose checksum fails
is skipped, the reader goes on at the next capture pattern and packets cut by the gap are dropped and
counted as lost. An empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm import common as C

ALIGN = 64
RATE = 8000
PACKET = 4096
#: RFC 3533 fixed values.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC of RFC 3533 (polynomial 0x04c11db7, nothing reflected, start and end 0).

    It is zlib's CRC over bit-reversed bytes with zlib's start and end values undone, bit-reversed.
    """
    return int(f"{zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def write_page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    page = head + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def lace(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


class Writer:
    """Packets of one logical stream into pages; a page is closed when its 255 segments are full."""

    def __init__(self, serial: int) -> None:
        self.serial, self.sequence = serial, 0

    def pages(self, packets: list[tuple[bytes, int]], last: bool) -> Iterator[bytes]:
        """Pages of packets (bytes, granule position at their end)."""
        lacing, body, granule, flags = bytearray(), [], -1, 0 if self.sequence else FIRST
        for k, (data, at) in enumerate(packets):
            segments, start = lace(len(data)), 0
            while True:
                take = min(len(segments), 255 - len(lacing))
                part, segments = segments[:take], segments[take:]
                size = sum(part)
                lacing += part
                body.append(data[start : start + size])
                start += size
                if not segments:
                    granule = at
                if segments or len(lacing) == 255:
                    end = last and not segments and k == len(packets) - 1
                    yield self._page(granule, flags | (LAST if end else 0), lacing, body)
                    lacing, body, granule, flags = bytearray(), [], -1, CONTINUED if segments else 0
                if not segments:
                    break
        if lacing:
            yield self._page(granule, flags | (LAST if last else 0), lacing, body)

    def _page(self, granule: int, flags: int, lacing: bytearray, body: list[bytes]) -> bytes:
        page = write_page(self.serial, self.sequence, granule, flags, bytes(lacing), b"".join(body))
        self.sequence += 1
        return page


def mux(payload: bytes, n_bytes: int) -> bytes:
    """The payload as 8-bit samples beside an index stream of packet checksums; equal payloads, equal bytes."""
    serial = zlib.crc32(payload)
    samples, index = Writer(serial), Writer(serial ^ 0xFFFFFFFF)
    out = [
        *samples.pages([(struct.pack("<8sIHHQ", b"PCM8\0\0\0\0", RATE, 1, 8, n_bytes), 0)], False),
        *index.pages([(b"INDX\0\0\0\0", 0)], False),
    ]
    packets = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    for i in range(0, len(packets), 15):
        group = packets[i : i + 15]
        out += samples.pages(group, i + 15 >= len(packets))
        out += index.pages([(b"".join(struct.pack("<I", zlib.crc32(p)) for p, _ in group), group[-1][1])], i + 15 >= len(packets))
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: whole packets, the granule position known at each one's end (or -1)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _next: int = 0
    _open: list[bytes] | None = None


def demux(media: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number in order of appearance, and the number of damaged pages."""
    streams: dict[int, Stream] = {}
    bad, at = 0, 0
    while (at := media.find(CAPTURE, at)) >= 0:
        if at + HEADER.size > len(media):
            bad += 1
            break
        _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < n or end > len(media) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at += 4
            continue
        _add(streams.setdefault(serial, Stream(serial)), flags, granule, sequence, lacing, media, start)
        at = end
    return streams, bad


def _add(s: Stream, flags: int, granule: int, sequence: int, lacing: bytes, media: bytes, at: int) -> None:
    """One good page into its stream: packets end at a lacing value below 255."""
    if sequence != s._next or lacing and bool(flags & CONTINUED) != (s._open is not None):
        s.lost += 1
        s._open = None
    s._next, s.ended = sequence + 1, bool(flags & LAST)
    s.pages += 1
    if not lacing:  # nothing ends or goes on here; an open packet stays open
        return
    skip, whole = bool(flags & CONTINUED) and s._open is None, len(s.packets)
    parts, start, size = s._open or [], at, 0
    s._open = None
    for k, x in enumerate(lacing):
        size += x
        if x < 255 or k == len(lacing) - 1:
            parts.append(media[start : start + size])
            start, size = start + size, 0
            if x == 255:
                s._open = None if skip else parts
            else:
                if not skip:
                    s.packets.append(b"".join(parts))
                    s.granules.append(-1)
                parts, skip = [], False
    if granule >= 0 and len(s.packets) > whole:  # of the last packet that ends on this page
        s.granules[-1] = granule


def timestamps(s: Stream, rate: int, first: int) -> list[tuple[float, float]]:
    """Seconds of start and end of each packet from ``first`` on, for 8-bit samples: a known granule
    position fixes the end of its packet, those between are counted back from it by their samples."""
    ends: list[int] = []
    known = -1
    for packet, granule in zip(reversed(s.packets[first:]), reversed(s.granules[first:]), strict=True):
        known = granule if granule >= 0 else known
        ends.append(known)
        known = known - len(packet) if known >= 0 else -1
    ends.reverse()
    return [((e - len(p)) / rate, e / rate) for e, p in zip(ends, s.packets[first:], strict=True)]


def read_samples(media: bytes) -> tuple[bytes, int, str]:
    """Payload, unpadded length and feature of what ``mux`` wrote; damage shows in the feature."""
    streams, bad = demux(media)
    payload, n_bytes, times, checked = b"", 0, [], 0
    data = next((s for s in streams.values() if s.packets and s.packets[0][:4] == b"PCM8"), None)
    index = next((s for s in streams.values() if s.packets and s.packets[0][:4] == b"INDX"), None)
    if data:
        _, rate, _, _, n_bytes = struct.unpack("<8sIHHQ", data.packets[0])
        payload, times = b"".join(data.packets[1:]), timestamps(data, rate, 1)
        sums = b"".join(index.packets[1:]) if index else b""
        checked = sum(sums[4 * k : 4 * k + 4] == struct.pack("<I", zlib.crc32(p)) for k, p in enumerate(data.packets[1:]))
    feature = {
        "streams": len(streams),
        "pages": sum(s.pages for s in streams.values()),
        "packets": sum(len(s.packets) for s in streams.values()),
        "bad_pages": bad,
        "lost": sum(s.lost for s in streams.values()),
        "checked": checked,
        "seconds": f"{times[-1][1] if times else 0:.6f}",
        "middle": f"{times[len(times) // 2][0] if times else 0:.6f}",
    }
    return payload, n_bytes, ";".join(f"{k}={v}" for k, v in feature.items())


def _encode(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    def out(ids: list, sizes: list, media: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    for batch in batches:
        ids, sizes, media, held = [], [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            payload = raw + b"\0" * (max(1, -(-len(raw) // ALIGN)) * ALIGN - len(raw))
            ids.append(i)
            sizes.append(len(raw))
            media.append(mux(payload, len(raw)))
            held += len(media[-1])
            if held > C.BATCH_BYTES:
                yield out(ids, sizes, media)
                ids, sizes, media, held = [], [], [], 0
        if ids:
            yield out(ids, sizes, media)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as Ogg."""
    src = C.pick(df, id_col, text_col)
    kind = _arrow_type(src, id_col)
    return C.map_arrow(src, lambda it: _encode(it, kind), [_as(src, id_col), C.field("n_bytes", "long"), C.field("media", "binary")]).withColumnRenamed("id", id_col)


def _decode(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.binary(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "n_bytes", "payload", "media", "feature"])

    for batch in batches:
        rows, held = [], 0
        for i, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = media.as_py()
            payload, n, feature = read_samples(raw or b"")
            rows.append((i, n, None if raw is None else payload, raw, feature))
            held += 2 * len(raw or b"")
            if held > C.BATCH_BYTES:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)


def decode(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, payload, media, feature): the samples read back from Ogg bytes."""
    src = C.pick(df, id_col, media_col)
    kind = _arrow_type(src, id_col)
    fields = [_as(src, id_col), *(C.field(n, k) for n, k in (("n_bytes", "long"), ("payload", "binary"), ("media", "binary"), ("feature", "string")))]
    return C.map_arrow(src, lambda it: _decode(it, kind), fields).withColumnRenamed("id", id_col)


def _as(df: DataFrame, id_col: str):
    f = C.id_field(df, id_col)
    return type(f)("id", f.dataType, True)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as Ogg, read the stored bytes back, and digest both."""
    back = decode(encode(df, id_col, text_col), id_col)
    return back.select(
        id_col,
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{ALIGN}, {ALIGN})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
