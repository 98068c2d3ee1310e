"""Legacy ARC archives to WARC records, and back to rows.

`parse_arc` reads ARC files of version 1 (five header fields) and 2 (ten): a
version block names the version, each record is a header line, the declared
number of bytes and a newline. Fields are taken from the right, so addresses
with spaces survive. `to_warc` gives each record an identifier (a UUID of its
archive and place in it), an ISO timestamp, a type and base32 SHA-1 digests; the
version block becomes a warcinfo record. What starts with an HTTP status line is
a response whose payload follows the HTTP header, all else a resource.

`write_arc` writes rows as stored, zipped ARC files, every other file of a task
in the other version. `convert` reads stored ARC files, zipped or not, and writes WARC files: of equal
payloads of at least `min_bytes` bytes the record with the largest key is the
response, the others are revisits that refer to its identifier. `read_archives`
gives the rows of WARC files. Files end after `FILE_BYTES` or one record; each
WARC record is a gzip member of its own, and reading holds one record at a time
beside its file.

Defined cases: a null payload is empty; a null key or address is left out of
the headers and comes back null; null keys rank below all others; of repeated
rows with one payload the one that lies last in the archives is the response; an
empty table writes no record; extra columns are not read. Damaged records raise
ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import load, map_arrow, materialize, prepare, release_shuffles, remove, scratch_path

V1_FIELDS = b"URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
END = b"\r\n\r\n"
NO_DATE = b"19700101000000"
HTTP_HEAD = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n"
FILE_BYTES = 8 << 20
#: Bytes of a zipped file that are read at once, doubled while a member goes on.
MEMBER_STEP = 4 << 10
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: What Spark's text writer puts after each file's bytes: a gzip member without content.
NOTHING = gzip.compress(b"", mtime=0)


@dataclass
class ArcRecord:
    version: int
    url: bytes
    ip: bytes
    date: bytes
    kind: bytes
    block: bytes
    offset: int = 0

    def head_size(self) -> int:
        """Bytes of the HTTP header before the payload."""
        end = self.block.find(END) if self.block.startswith(b"HTTP/") else -1
        return end + len(END) if end >= 0 else 0


def arc_header(version: int, url: bytes, ip: bytes, date: bytes, kind: bytes, size: int) -> bytes:
    middle = b"" if version == 1 else b"200 - - 0 - "
    return b"%s %s %s %s %s%d\n" % (url, ip, date, kind, middle, size)


def arc_file(version: int, records: list[ArcRecord], name: bytes = b"pages.arc") -> bytes:
    """An ARC file with its version block."""
    block = b"%d 0 glossa\n%s\n" % (version, V1_FIELDS if version == 1 else V2_FIELDS)
    out = [arc_header(1, b"filedesc://" + name, b"0.0.0.0", NO_DATE, b"text/plain", len(block)), block, b"\n"]
    for r in records:
        out += [arc_header(version, r.url, r.ip, r.date, r.kind, len(r.block)), r.block, b"\n"]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block first."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        line_end = data.find(b"\n", at)
        if line_end < 0:
            raise ValueError("ARC header line without an end")
        line = data[at:line_end].rstrip(b"\r")
        first = version == 0
        fields = line.rsplit(b" ", 4 if first or version == 1 else 9)
        if len(fields) != (5 if first or version == 1 else 10) or not fields[-1].isdigit():
            raise ValueError(f"not an ARC header line of version {version or 1}: {line[:80]!r}")
        size, start = int(fields[-1]), line_end + 1
        payload = data[start : start + size]
        if len(payload) < size:
            raise ValueError("ARC record shorter than declared")
        if first:
            if not line.startswith(b"filedesc:") or payload[:2] not in (b"1 ", b"2 "):
                raise ValueError("ARC file without a version block")
            version = int(payload[:1])
        yield ArcRecord(version, *fields[:4], payload, at)
        at = start + size


def digest_of(payload: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def iso_date(date: bytes) -> str:
    d = date.decode("ascii", "replace").ljust(14, "0")[:14]
    d = d if d.isdigit() else NO_DATE.decode()
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    """The identifier of the record at a place of an archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


@dataclass
class Origin:
    """The record that a revisit refers to."""

    archive: str
    offset: int
    key: int | None


def key_of(kind: bytes) -> int | None:
    """The key in a content type's parameter."""
    mark = kind.rpartition(b";key=")[2] if b";key=" in kind else b""
    return int(mark) if mark else None


def to_warc(r: ArcRecord, archive: str, origin: Origin | None = None) -> bytes:
    """The WARC record of an ARC record, with the blank lines after it; with an
    `origin` a revisit, of which only the HTTP header is kept."""
    n = r.head_size()
    payload, key = r.block[n:], key_of(r.kind)
    info = r.url.startswith(b"filedesc:")
    kind = "warcinfo" if info else "revisit" if origin else "response" if n else "resource"
    block = r.block[:n] if origin else r.block
    plain = r.kind.rpartition(b";key=")[0] if key is not None else r.kind
    head = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(archive, r.offset)}",
        f"WARC-Date: {iso_date(r.date)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        f"Content-Type: {'application/http; msgtype=response' if n else plain.decode('latin-1') or 'application/octet-stream'}",
    ]
    if r.url != b"-" and not info:
        head.append(f"WARC-Target-URI: {r.url.decode('utf-8', 'replace')}")
    if key is not None:
        head.append(f"WARC-Source-Key: {key}")
    if origin:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(origin.archive, origin.offset)}"]
        if origin.key is not None:
            head.append(f"WARC-Refers-To-Key: {origin.key}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + END + block + END


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    end = data.find(END)
    if not data.startswith(b"WARC/") or end < 0:
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    head = {k.lower(): v for k, v in head.items()}
    start = end + len(END)
    stop = start + int(head["content-length"])
    if data[stop:] != END:
        raise ValueError("WARC record of another length than declared")
    return head, data[start:stop]


def members(data: bytes) -> Iterator[bytes]:
    """The contents of a gzip file's members one by one, empty ones left out.
    They are read in steps, as zlib copies what lies behind a member in its
    input: given the whole file, each member would cost the length of the rest."""
    rest, at = memoryview(data), 0
    while at < len(rest):
        d, got, step = zlib.decompressobj(31), [], MEMBER_STEP
        while not d.eof:
            part = rest[at : at + step]
            if not len(part):
                raise ValueError("gzip member without an end")
            got.append(d.decompress(part))
            at += len(part) - len(d.unused_data)
            step *= 2
        whole = b"".join(got)
        if whole:
            yield whole


def unzipped(data: bytes) -> bytes:
    """An archive's bytes, which may be zipped."""
    return b"".join(members(data)) if data.startswith(NOTHING[:2]) else data


def files_of(parts: Iterator[bytes], first: bytes = b"") -> Iterator[pa.RecordBatch]:
    """Rows of a file's bytes each, `first` before its parts."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= FILE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([first + b"".join(held)], pa.binary())], names=["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([first + b"".join(held)], pa.binary())], names=["value"])


def save(files: DataFrame, path: str, after: bytes) -> None:
    """A file for each row, with `after` at its end. Latin-1 keeps these bytes."""
    writer = files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", after.decode("latin-1"))
    writer.text(path)


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2)) -> None:
    """Write (key long, url string, payload binary) rows as ARC files at `path`;
    a task's files take turns in `versions`."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0

        def records() -> Iterator[ArcRecord]:
            for b in batches:
                for key, url, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    kind = b"text/html" if key is None else b"text/html;key=%d" % key
                    yield ArcRecord(1, " ".join((url or "-").split()).encode() or b"-", b"0.0.0.0", NO_DATE, kind, HTTP_HEAD + (payload or b""))

        held, size = [], 0
        for r in records():
            version = versions[turn % len(versions)]
            held.append(replace(r, version=version))
            size += len(r.block)
            if size >= FILE_BYTES:
                yield from files_of(iter([gzip.compress(arc_file(version, held), 1, mtime=0)]))
                held, size, turn = [], 0, turn + 1
        if held:
            # a small last file goes half in each version
            for k, part in enumerate((held[::2], held[1::2])):
                if part:
                    yield from files_of(iter([gzip.compress(arc_file(versions[(turn + k) % len(versions)], part), 1, mtime=0)]))

    save(map_arrow(pages.select("key", "url", "payload"), run, "value binary"), path, NOTHING)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the files at `path`."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("archive"), "content")


def convert(spark: SparkSession, arcs: str, path: str, min_bytes: int = 0) -> None:
    """Write the records of the ARC files at `arcs` as WARC files at `path`."""
    prepare(spark)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for r in parse_arc(unzipped(content.as_py())):
                    payload = memoryview(r.block)[r.head_size() :]
                    if not r.url.startswith(b"filedesc:") and len(payload) >= min_bytes:
                        rows.append((hashlib.sha1(payload).digest(), key_of(r.kind), archive, r.offset))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["digest", "key", "archive", "offset"])

    seen, seen_at = materialize(map_arrow(stored(spark, arcs), places, "digest binary, key long, archive string, offset long"), "payloads")
    equal = seen.groupBy("digest").agg(F.max(F.struct("key", "archive", "offset")).alias("best"), F.count(F.lit(1)).alias("n"))
    # a table of its own, so that Spark can split the join of a hot payload
    first, first_at = materialize(equal.where("n > 1").drop("n"), "originals")
    again = seen.join(first, "digest").where((F.col("archive") != F.col("best.archive")) | (F.col("offset") != F.col("best.offset")))
    again = again.groupBy("archive").agg(F.collect_list(F.struct("offset", F.col("best.archive").alias("of"), F.col("best.offset").alias("at"), F.col("best.key").alias("key"))).alias("revisits"))
    again, again_at = materialize(again, "revisits")  # a row for each archive, of which each is bounded
    release_shuffles(spark)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[bytes]:
            for b in batches:
                for i in range(b.num_rows):
                    archive = b.column(0)[i].as_py()
                    known = {x["offset"]: Origin(x["of"], x["at"], x["key"]) for x in b.column(2)[i].as_py() or ()}
                    for r in parse_arc(unzipped(b.column(1)[i].as_py())):
                        yield gzip.compress(to_warc(r, archive, known.get(r.offset)), compresslevel=6, mtime=0)

        yield from files_of(out())

    save(map_arrow(stored(spark, arcs).join(again, "archive", "left").select("archive", "content", "revisits"), records, "value binary"), path, NOTHING)
    remove(spark, seen_at, first_at, again_at)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to, target,
    record_id, refers_to_id and payload of each record but the warcinfo ones."""
    prepare(spark)
    schema = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, record_id string, refers_to_id string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for i in range(b.num_rows):
                rows, held = [], 0
                for data in members(b.column(1)[i].as_py()):
                    head, block = parse_warc(data)
                    if head["warc-type"] == "warcinfo":
                        continue
                    digest, size, kind = head["warc-payload-digest"].removeprefix("sha1:"), int(head["warc-payload-length"]), head["warc-type"]
                    payload = block[ArcRecord(1, b"", b"", b"", b"", block).head_size() :]
                    if digest_of(block) != head["warc-block-digest"].removeprefix("sha1:") or kind != "revisit" and (digest_of(payload) != digest or len(payload) != size):
                        raise ValueError("a record differs from its digest")
                    rows.append((number(head.get("warc-source-key")), size, digest, kind, number(head.get("warc-refers-to-key")), head.get("warc-target-uri"), head["warc-record-id"], head.get("warc-refers-to"), payload))
                    held += len(payload)
                    if held >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return map_arrow(stored(spark, path), run, schema)


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("key"), "url", F.col("html").cast("binary").alias("payload"))
    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arcs)
    convert(spark, arcs, warcs)
    remove(spark, arcs)
    return read_archives(spark, warcs).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
