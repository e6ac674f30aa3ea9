"""Legacy ARC archives to WARC.

ARC has a version block, then records of a header line and a body of the length that the line declares.
Version 1 lines have 5 fields: URL, IP address, date, content type, length. Version 2 lines have 10: URL, IP
address, date, content type, result code, checksum, location, offset, file name, length. The converter
follows each file's version, keeps bodies as they are, and synthesises WARC identifiers (name-based UUIDs of
URL, date and payload digest), ISO timestamps, record types and SHA-1 digests. Of records whose payloads are
equal, the one with the greatest page id stays a response and the others become revisits of it. Records without an
HTTP head (`dns:` lookups, say) become resources of the content type that their header line names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.llm.common import materialise, new_folder, shuffle_partitions, storage

ARC_V1 = ("url", "ip", "date", "mime", "length")
ARC_V2 = ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of archived rows that have none.
ARC_DATE = "20000101000000"
#: Payloads of at least so many bytes are compared.
MIN_BYTES = 0
_CHUNK = 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str | None) -> str:
    """A URL as one field of a header line: blanks and control characters are percent-encoded; null or empty is '-'."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "") or "-"


def arc_version_block(version: int, name: str) -> bytes:
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 Kinlake\n{names}\n"
    tail = {1: f"{len(body)}", 2: f"200 - - 0 {name} {len(body)}"}[version]
    return f"filedesc://{name} 0.0.0.0 {ARC_DATE} text/plain {tail}\n{body}\n".encode()


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes, name: str, offset: int, date: str = ARC_DATE) -> bytes:
    """One page as an ARC record: header line, HTTP head with the page id, payload, line feed."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n"
    body = head.encode() + payload
    tail = f"{len(body)}" if version == 1 else f"200 {zlib.crc32(payload):08x} - {offset} {name} {len(body)}"
    return f"{_field(url)} 0.0.0.0 {date} text/html {tail}\n".encode() + body + b"\n"


class _Gunzip:
    """Bytes of a multi-member gzip stream, or of a plain one, with bounded read-ahead."""

    def __init__(self, raw):
        self.raw, self.inner = raw, zlib.decompressobj(31)
        self.first = raw.read(_CHUNK)
        self.plain = self.first[:2] != b"\x1f\x8b"
        self.have = self.first if self.plain else b""

    def read(self, n: int) -> bytes:
        out, size = [self.have], len(self.have)
        while size < n:
            if self.plain:
                got = self.raw.read(_CHUNK)
                if not got:
                    break
            else:
                data = self.inner.unused_data if self.inner.eof else self.inner.unconsumed_tail
                data = self.first or data or self.raw.read(_CHUNK)
                self.first = b""
                if not data:
                    break
                if self.inner.eof:
                    self.inner = zlib.decompressobj(31)
                got = self.inner.decompress(data, _CHUNK)
            out.append(got)
            size += len(got)
        whole = b"".join(out)
        self.have = whole[n:]
        return whole[:n]

    def line(self) -> bytes:
        out = b""
        while not out.endswith(b"\n"):
            at = self.have.find(b"\n")
            if at >= 0:
                out, self.have = out + self.have[: at + 1], self.have[at + 1 :]
            else:
                out, self.have = out + self.have, b""
                if not (more := self.read(1)):
                    break
                self.have = more + self.have
        return out


def parse_arc(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record after the version block of an ARC stream, gzip or plain.

    The block's own version decides how the lines are split. Fields are counted from the line's end, so that a
    URL with blanks stays whole. A line with too few fields, an odd length or a short body raises ValueError.
    """
    source, names = _Gunzip(raw), None
    while True:
        line = source.line()
        while line in (b"\n", b"\r\n"):
            line = source.line()
        if not line:
            return
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if names is None:
            if not text.startswith("filedesc:"):
                raise ValueError("no ARC version block")
            block = source.read(int(text.rsplit(" ", 1)[1])).decode("utf-8", "replace")
            version = block.split(" ", 1)[0]
            if version not in ("1", "2"):
                raise ValueError(f"unknown ARC version {version!r}")
            names = ARC_V1 if version == "1" else ARC_V2
            continue
        fields = text.rsplit(" ", len(names) - 1)
        if len(fields) != len(names) or not fields[-1].isascii() or not fields[-1].isdigit():
            raise ValueError(f"bad ARC header line {text[:200]!r}")
        header = dict(zip(names, fields, strict=True))
        body = source.read(int(header["length"]))
        if len(body) != int(header["length"]):
            raise ValueError("short ARC record")
        yield header, body


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(head with its empty line, payload) of an HTTP response; without a head all is payload."""
    if body.startswith(b"HTTP/") and (at := body.find(b"\r\n\r\n")) >= 0:
        return body[: at + 4], body[at + 4 :]
    return b"", body


def page_id_of(head: bytes) -> int | None:
    m = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r$", head)
    return int(m[1]) if m else None


def iso_date(date: str) -> str:
    """A 14-digit ARC date (shorter ones are filled up) as a WARC date."""
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else ARC_DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(page_id: int | None, header: dict[str, str], digest: str, place: str | None = None) -> str:
    """The same for equal input on every run, and known to revisits of the record. `place`, a file and a number in it, tells
    records apart that have page and payload in common, or no page id."""
    name = f"page:{page_id}:{digest}" if page_id is not None else f"{header['url']} {header['date']} {digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name if place is None else f'{name} {place}')}>"


def warc_record(header: dict[str, str], body: bytes, refers_to: int | None, place: str | None = None) -> bytes:
    """The WARC record of an ARC record. A revisit keeps the HTTP head, whose Content-Length and the record's payload
    digest tell of the payload it leaves out. A body without a head is a resource, and all of it payload."""
    head, payload = split_http(body)
    digest, page_id = payload_digest(payload), page_id_of(head)
    block = body if refers_to is None else head
    kind, mime = ("response" if refers_to is None else "revisit", "application/http; msgtype=response") if head else ("resource", header["mime"])
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, header, digest, place)),
        ("WARC-Date", iso_date(header["date"])), ("WARC-Target-URI", header["url"]), ("WARC-IP-Address", header["ip"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", mime), ("X-Payload-Length", str(len(payload))), ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.insert(2, ("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields.insert(3, ("WARC-Profile", REVISIT_PROFILE))
        fields.insert(4, ("WARC-Refers-To", record_id(refers_to, header, digest)))
        fields.insert(5, ("X-Refers-To-Page-Id", str(refers_to)))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def parse_warc(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a gzip WARC stream."""
    source = _Gunzip(raw)
    while True:
        line = source.line()
        while line in (b"\n", b"\r\n"):
            line = source.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC version line")
        fields = {}
        while (line := source.line()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            fields[k.strip().lower()] = v.strip()
        block = source.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("short WARC record")
        yield fields, block


def _member(record: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def write_arcs(pages: DataFrame, folder: str | None = None, version: int | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as gzip ARC files, one a task, and return a table of their URIs. Null html is an
    empty payload. version: 1, 2, or both in turn by default. Repeated rows are repeated records; an empty table gives no file."""
    folder = folder or new_folder(pages.sparkSession, "arc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = storage(folder)
        name, out, offset, kind = uuid.uuid4().hex, None, 0, version
        for batch in batches:
            for part, page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    kind = version or 1 + part % 2
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}.arc.gz", compression=None)
                    block = _member(arc_version_block(kind, f"{name}.arc.gz"))
                    out.write(block)
                    offset = len(block)
                member = _member(arc_record(kind, page_id, url, (html or "").encode("utf-8", "surrogatepass"), f"{name}.arc.gz", offset))
                out.write(member)
                offset += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.arc.gz"])], names=["file"])

    rows = pages.select(F.spark_partition_id().alias("part"), F.col("page_id").cast("bigint"), "url", "html")
    return materialise(rows.mapInArrow(run, "file string"), "arc-files")


def index_arcs(files: DataFrame) -> DataFrame:
    """file, record (its number there), page_id (null without an HTTP head that has one), payload_bytes, payload_digest: an
    index without payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "record", "page_id", "payload_bytes", "payload_digest"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, at = storage(uri)
                rows = []
                with fs.open_input_stream(at, compression=None) as raw:
                    for k, (_, body) in enumerate(parse_arc(raw)):
                        head, payload = split_http(body)
                        rows.append((uri, k, page_id_of(head), len(payload), payload_digest(payload)))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return files.mapInArrow(run, "file string, record bigint, page_id bigint, payload_bytes bigint, payload_digest string")


def convert(files: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Convert ARC files to gzip WARC files and return a table of their URIs.

    Payloads never shuffle: an index of digests is grouped (partial maxima, so that a payload that a third of
    the records share is no hot key), decisions go back to their file by (file, record), and each file is
    converted as it is read. Records without a page id refer to none and are referred to by none. Where the greatest page
    id repeats, all its records are responses, each with an id of its own, and revisits refer to the last of them. An
    empty table gives no file.
    """
    spark = files.sparkSession
    folder = folder or new_folder(spark, "warc")
    index = materialise(index_arcs(files), "arc-index")
    paged = index.filter((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    last = paged.groupBy("payload_digest").agg(F.max(F.struct("page_id", "file", "record")).alias("last"), F.count("*").alias("n"))
    last = materialise(last.filter("n > 1"), "arc-repeats").select("payload_digest", "last")
    decided = index.select("file", "record", "page_id", "payload_bytes", "payload_digest").join(last, "payload_digest", "left")
    met = F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes)
    refers = F.when(met & (F.col("last.page_id") != F.col("page_id")), F.col("last.page_id"))
    main = met & (F.col("last").isNull() | ((F.col("last.file") == F.col("file")) & (F.col("last.record") == F.col("record"))))
    decided = decided.select("file", "record", refers.alias("refers_to"), main.alias("main"))
    # A stated number of partitions: rows are narrow, but each stands for a payload to convert, so they must not be coalesced.
    decided = decided.repartition(shuffle_partitions(spark), "file").sortWithinPartitions("file", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = storage(folder)
        uri = records = raw = out = name = None
        done: list[str] = []

        def finish() -> None:
            if next(records, None) is not None:
                raise ValueError(f"{uri} has more records than its index")
            raw.close()
            out.close()
            done.append(f"{folder}/{name}.warc.gz")

        for batch in batches:
            for file, number, refers_to, main in zip(*(batch.column(c).to_pylist() for c in ("file", "record", "refers_to", "main")), strict=True):
                if file != uri:
                    if uri is not None:
                        finish()
                    source, path = storage(file)
                    raw, name, uri = source.open_input_stream(path, compression=None), uuid.uuid4().hex, file
                    records = parse_arc(raw)
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}.warc.gz", compression=None)
                    info = b"software: kinlake\r\nformat: WARC File Format 1.1\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: {iso_date(ARC_DATE)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    out.write(_member(head.encode() + info + b"\r\n\r\n"))
                out.write(_member(warc_record(*next(records), refers_to, None if main else f"{file} {number}")))
        if uri is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    return materialise(decided.mapInArrow(run, "file string"), "warc-files")


def read_warcs(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, warc_date, url of each record but warcinfo.

    A response's or resource's payload is measured and digested anew and must agree with its header; a revisit tells of
    the payload that it refers to. Repeated records come back as often as they are there; no files give no rows.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, at = storage(uri)
                rows = []
                with fs.open_input_stream(at, compression=None) as raw:
                    for f, block in parse_warc(raw):
                        if f["warc-type"] == "warcinfo":
                            continue
                        head, payload = split_http(block)
                        digest = f["warc-payload-digest"].removeprefix("sha1:")
                        size = int(f["x-payload-length"])
                        if f["warc-type"] != "revisit":
                            if (len(payload), payload_digest(payload)) != (size, digest):
                                raise ValueError(f"{uri}: payload and header disagree")
                        page, refers = (int(f[k]) if k in f else None for k in ("x-page-id", "x-refers-to-page-id"))
                        rows.append((page, size, digest, f["warc-type"], refers, f["warc-record-id"].strip("<>"), f["warc-date"], f["warc-target-uri"]))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return files.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, warc_date string, url string")


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the WARC files that its ARC files become; see `convert`."""
    arcs = write_arcs(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    n = shuffle_partitions(spark)
    warcs = convert(arcs.repartition(n))
    return read_warcs(warcs.repartition(n))
