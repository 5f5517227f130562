"""WARC archives: one gzip member per record, read back sequentially.

``write_archives`` writes response and revisit records into archives kept as a table of segments
(archive, sequence, bytes): the segments of an archive joined in order are a valid ``.warc.gz`` file,
each begins at a record, and Spark's committed writers put them into any store. ``read_archives``
reads such tables, ``read_files`` reads ``.warc.gz`` files in pieces from any store that pyarrow opens;
both inflate incrementally, frame records by Content-Length and verify block and payload digests.

Of rows with equal payloads those with the largest page id are the response and the others revisit
it; equal payloads meet as (digest, id) only, pre-aggregated before the shuffle. Bitmaps of fixed size
of the repeated digests and of their responses let the html of all other rows stay where it is: pages
of their own are written without a join, revisits join back by digest and length alone, in a join that
adaptive execution can split when a payload is hot.

Defined cases: null html counts as empty; a null page id is smaller than any other; if all ids of a
group are null, all are responses; repeated rows that hold the largest id are all responses. Empty
tables give empty tables; other columns are ignored. A record with a wrong digest is returned with
``valid`` false; an archive cut or damaged inside a record loses that record only: the reader looks for
the next member from where the damaged one began to fail.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.llm import bitmap
from stratiform.llm import common as C

SEGMENT = 1 << 20
#: How a gzip member begins.
MARK = b"\x1f\x8b\x08"
PIECE = 1 << 16
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + z.flush()


def _clean(value: str | None) -> str:
    """A header value: no line ends."""
    return " ".join((value or "").split())


def _record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, revisit: bool, length: int | None = None, sha1: str | None = None) -> bytes:
    """A page's record; of a revisit the payload's length and hexadecimal digest will do."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    length = len(payload) if length is None else length
    told = digest(payload) if sha1 is None else base64.b32encode(bytes.fromhex(sha1)).decode()
    headers = [
        ("WARC-Record-ID", _record_id(page_id, url)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{told}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(length)),
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
        return record("revisit", headers, http)
    return record("response", headers, http + payload)


class Record:
    """Headers (names in lower case), block, and whether its digests hold."""

    def __init__(self, head: bytes, block: bytes) -> None:
        lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        self.version, self.block = lines[0], block
        self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}
        self.kind = self.headers.get("warc-type", "")
        http, _, body = block.partition(b"\r\n\r\n")
        self.payload = body if http[:5] == b"HTTP/" else block
        said, whole = self.headers.get("warc-block-digest", ""), self.headers.get("warc-payload-digest", "")
        self.valid = (not said or said.rpartition(":")[2] == digest(block)) and (not whole or self.kind == "revisit" or whole.rpartition(":")[2] == digest(self.payload))


class Reader:
    """Sequential reader: feed it pieces of an archive of any size, take whole records, ``finish`` at the end.

    The compressed bytes of the member being read are kept: where it fails, every later gzip mark is tried,
    from the first of these bytes on, so a whole member is never lost to a damaged one before it.
    """

    def __init__(self) -> None:
        self._z, self._held, self._raw = zlib.decompressobj(31), bytearray(), bytearray()
        self._tail, self._lost = b"", False
        self.damaged = 0

    def feed(self, data: bytes) -> Iterator[Record]:
        data, self._tail = self._tail + data, b""
        while data:
            if self._lost and not self._raw:
                if (at := data.find(MARK)) < 0:
                    # a mark may begin in the last bytes
                    self._tail = next((data[-k:] for k in (2, 1) if data.endswith(MARK[:k])), b"")
                    return
                data = data[at:]
            self._raw += data
            try:
                self._held += self._z.decompress(data)
            except zlib.error:
                data = self._again()
                continue
            if not self._z.eof:
                return
            data, self._z = self._z.unused_data, zlib.decompressobj(31)
            self._raw, self._lost = bytearray(), False
            yield from self._records()

    def finish(self) -> Iterator[Record]:
        """The records behind a member that was cut and took them for its own."""
        while self._raw:
            yield from self.feed(self._again())

    def _again(self) -> bytes:
        """Give the member up; what follows its first byte."""
        self.damaged += not self._lost
        rest = bytes(self._raw[1:])
        self._z, self._held, self._raw, self._lost = zlib.decompressobj(31), bytearray(), bytearray(), True
        return rest

    def _records(self) -> Iterator[Record]:
        """All records of an ended member (one each, as written here; other writers may join some)."""
        held, at = bytes(self._held), 0
        self._held = bytearray()
        while (start := held.find(b"WARC/", at)) >= 0 and (end := held.find(b"\r\n\r\n", start)) >= 0:
            head = held[start:end]
            said = {x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x[:15].lower() == b"content-length:"}
            if len(said) != 1 or not (size := said.pop()).isdigit() or len(size) > _LENGTH:
                # no length to go by: the next record is looked for behind this header
                self.damaged += 1
                at = end + 4
                continue
            at = end + 4 + int(size)
            if at > len(held):
                self.damaged += 1
                at = end + 4
                continue
            yield Record(head, held[end + 4 : at])


#: Digits of the longest length that is read.
_LENGTH = 18
_LONG = "cast(conv(substring({0}, 1, 15), 16, 10) as bigint)"


def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Adds length_, digest_, refers_ and revisit_: which page id each row revisits; revisits lose their html.

    Only digests that occur more than once go into the join, and with html only the rows that may be its
    responses.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    keyed = pages.withColumn("length_", F.octet_length(html).cast("long")).withColumn("digest_", F.sha1(html))
    first = keyed.select(id_col, "digest_").groupBy("digest_").agg(F.max(id_col).alias("refers_"), F.count("*").alias("n_")).filter("n_ > 1").drop("n_")
    scratch = C.Scratch(pages.sparkSession, "revisits")
    first = scratch.keep(first)
    sent = pages.sparkSession.sparkContext.broadcast((bitmap.build(first.select(F.expr(_LONG.format("digest_")).alias("key"))), bitmap.build(first.select(F.xxhash64("digest_", "refers_").alias("key")))))
    marked = keyed.withColumn("d_", F.expr(_LONG.format("digest_"))).withColumn("r_", F.xxhash64("digest_", F.col(id_col)))
    names = [*keyed.columns, "d_", "r_"]

    def part(repeated: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                again = bitmap.has(sent.value[0], batch.column(len(names) - 2).to_numpy().view(np.uint64))
                own = batch.filter(pa.array(again == repeated))
                if repeated and own.num_rows:
                    # a row that isn't a response is written without its html
                    may = bitmap.has(sent.value[1], own.column(len(names) - 1).to_numpy().view(np.uint64))
                    columns = list(own.columns)
                    at = names.index(html_col)
                    columns[at] = pc.if_else(pa.array(may), columns[at], pa.scalar(None, columns[at].type))
                    own = pa.RecordBatch.from_arrays(columns, schema=own.schema)
                yield own

        return marked.mapInArrow(run, marked.schema).drop("d_", "r_")

    alone = part(False).withColumn("refers_", F.lit(None).cast(pages.schema[id_col].dataType)).withColumn("revisit_", F.lit(False))
    joined = part(True).join(first, "digest_", "left").withColumn("revisit_", F.col("refers_").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("refers_")))
    return alone.unionByName(joined)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archive, sequence, held, size = TaskContext.get().partitionId(), 0, [], 0

    def out(parts: list[bytes], k: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([archive], pa.int64()), pa.array([k], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["archive", "sequence", "bytes"])

    for batch in batches:
        columns = [batch.column(k) for k in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            if not sequence and not held:
                held.append(record("warcinfo", [("WARC-Record-ID", _record_id(None, f"archive {archive}")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            held.append(page_record(*(x.as_py() for x in row)))
            size += len(held[-1])
            if size > SEGMENT:
                yield out(held, sequence)
                held, size, sequence = [], 0, sequence + 1
    if held:
        yield out(held, sequence)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive, sequence, bytes) for every page; write it with Spark to keep it."""
    src = with_revisits(C.pick(pages, id_col, url_col, html_col), id_col, html_col)
    return C.map_arrow(src.select(id_col, url_col, html_col, "refers_", "revisit_", "length_", "digest_"), _write, [C.field("archive", "long"), C.field("sequence", "long"), C.field("bytes", "binary")])


_OUT = (("page_id", "long"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "long"), ("url", "string"), ("payload", "binary"), ("valid", "boolean"))


def _rows(records: Iterable[Record]) -> Iterator[tuple]:
    for r in records:
        if r.kind not in ("response", "revisit"):
            continue
        number = lambda name, r=r: int(x) if (x := r.headers.get(name, "")).lstrip("-").isdigit() else None
        full = number("x-payload-length") if r.kind == "revisit" else len(r.payload)
        told = r.headers.get("warc-payload-digest", "").rpartition(":")[2]
        yield (number("x-page-id"), full, told if r.kind == "revisit" else digest(r.payload), r.kind, number("x-refers-to-page-id"), r.headers.get("warc-target-uri"), r.payload if r.kind == "response" else None, r.valid)


def _batches(rows: Iterator[tuple], keep_payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    names = [(n, kinds[k]) for n, k in _OUT if keep_payload or n != "payload"]

    def out(held: list[tuple]) -> pa.RecordBatch:
        columns = [c for (n, _), c in zip(_OUT, zip(*held, strict=True), strict=True) if keep_payload or n != "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[6] or b"") if keep_payload else 64
        if size > C.BATCH_BYTES or len(held) >= 10_000:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def _fields(keep_payload: bool) -> list:
    return [C.field(n, k) for n, k in _OUT if keep_payload or n != "payload"]


def read_archives(segments: DataFrame, bytes_col: str = "bytes", keep_payload: bool = True) -> DataFrame:
    """Response and revisit records of archive segments: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload, valid."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            reader = Reader()
            for batch in batches:
                for x in batch.column(0):
                    yield from reader.feed(x.as_py() or b"")
            yield from reader.finish()

        yield from _batches(_rows(records()), keep_payload)

    return C.map_arrow(C.pick(segments, bytes_col), read, _fields(keep_payload))


def read_files(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records of the ``.warc.gz`` files under ``path``, one reader a file, in pieces of 64 KiB.

    Spark lists the files (their content isn't loaded), pyarrow opens them as streams on the executors, so
    a file may be of any size. Files in a store that pyarrow can't open raise an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def records(name: str) -> Iterator[Record]:
            store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
            reader = Reader()
            with store.open_input_stream(at, compression=None) as stream:
                while piece := stream.read(PIECE):
                    yield from reader.feed(piece)
            yield from reader.finish()

        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from _batches(_rows(records(name)), keep_payload)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path")
    return C.map_arrow(files, read, _fields(keep_payload))


def roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page into archives in the shared folder, then read the archives back."""
    scratch = C.Scratch(pages.sparkSession, "warc")
    return read_archives(scratch.keep(write_archives(pages, id_col, url_col, html_col)), keep_payload=False)
