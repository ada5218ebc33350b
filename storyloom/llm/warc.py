"""WARC records in ZIP-packaged archives: a Spark writer and a range reader that unpacks nothing.

An archive is a ZIP file with stored members: ``archive/data.warc`` holds the records, ``indexes/index.cdx`` one
line for each with its place in the member. The reader takes the end of the file, follows the end-of-directory
record (and its ZIP64 form) to the central directory, takes sizes and offsets beyond 32 bits from the ZIP64
extra fields, finds the stored members' first bytes behind their local headers, reads the index, and then reads
ranges of records, neighbours together.

Of equal payloads the largest page id is a response, the others revisit it (``revisit_from`` is the least size
for that). Tasks write archives under new names in the shared folder and return them as rows of a manifest
table; files of lost attempts are in no manifest. Files are reached through pyarrow's file systems, so the
folder may be local, HDFS or an object store.

A null payload is empty. A null url has no target, a null page id gives a record without one and never is what
a revisit refers to unless all pages of that payload lack an id. Repeated rows of one id with one payload are
all responses. Very long payloads are one record each. An empty table writes no archive and reads no rows. Other
columns of the pages are not read, so they may have any name. A damaged archive raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import checked, lean, new_path, table, written

DATA, INDEX = "archive/data.warc", "indexes/index.cdx"
ARCHIVE_BYTES = 64_000_000
REVISIT_FROM = 0
#: Records nearer than this are read in one range, of at most so many bytes.
READ_BYTES = 4_000_000
DATE = "2024-01-01T00:00:00Z"

#: Fixed values of the ZIP format: signatures and the ZIP64 extra field's id.
END, END64, LOCATOR64, ENTRY, LOCAL, EXTRA64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04", 1


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's name and the path there; a plain path is a local one."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def page_of(value: str | None) -> int | None:
    head = "<urn:x-page:"
    return int(value[len(head) : -1]) if value and value.startswith(head) else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: an HTTP response with the payload, or a revisit with the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; the digests of a response are computed anew and compared."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    if missing := {"content-length", "warc-payload-digest", "warc-block-digest", "warc-type", "warc-record-id"} - set(fields):
        raise ValueError(f"damaged record: no {', '.join(sorted(missing))}")
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    size = next((int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), -1)
    if size < 0 or fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}" or kind == "response" and (base32_sha1(payload) != digest or len(payload) != size):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return {"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields.get("warc-refers-to"))}


def with_references(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, payload, refers_to): each payload's largest page id is found by a partial aggregate of digests.

    Only digests that occur twice are joined, by a broadcast if they are few, so that most payloads are never shuffled.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    owners = written(rows.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).filter("copies > 1 AND owner IS NOT NULL").select("digest", "owner"), "warc-owners")
    revisits = (F.octet_length("payload") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return rows.join(checked(owners, 100), "digest", "left").select("page_id", "url", "payload", F.when(revisits, F.col("owner")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, revisit_from: int = REVISIT_FROM, zip64: bool = True) -> DataFrame:
    """Writes the records of pages(page_id, url, html); returns the manifest (path, bytes, records)."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(batches):
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        rows = ((p, u, h, r) for b in batches for p, u, h, r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        row = next(rows, None)
        while row is not None:
            name, index, at = f"{uuid.uuid4().hex}.wacz", [], 0
            with fs.open_output_stream(f"{top}/{name}") as sink, zipfile.ZipFile(_Unseekable(sink), "w", zipfile.ZIP_STORED) as out:
                with out.open(DATA, "w", force_zip64=zip64) as member:
                    while row is not None and at < archive_bytes:
                        raw = record(row[0], row[1], (row[2] or "").encode(), row[3])
                        member.write(raw)
                        index.append(f"{'-' if row[0] is None else row[0]} {at} {len(raw)}\n")
                        at += len(raw)
                        row = next(rows, None)
                with out.open(INDEX, "w", force_zip64=zip64) as member:
                    member.write("".join(index).encode())
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([at]), pa.array([len(index)])], ["path", "bytes", "records"])

    return written(with_references(pages, revisit_from).mapInArrow(lean(run), "path string, bytes long, records long"), "warc-manifest")


class _Unseekable:
    """A sink for zipfile that can only be written to; sizes then follow the members' bytes."""

    def __init__(self, sink):
        self.sink = sink

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


def directory(source, size: int) -> dict[str, tuple[int, int]]:
    """Stored members of a ZIP file: name to (first byte of the data, bytes), from the central directory alone."""
    tail_at = max(0, size - 65_557)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("not a ZIP file: no end-of-directory record")
    _, _, _, count, length, start, _ = struct.unpack("<HHHHIIH", tail[end + 4 : end + 22])
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == LOCATOR64:
        (at64,) = struct.unpack("<Q", tail[locator + 8 : locator + 16])
        record64 = source.read_at(56, at64)
        if record64[:4] != END64:
            raise ValueError("damaged ZIP64 end-of-directory record")
        count, length, start = struct.unpack("<QQQ", record64[32:56])
    raw, at, members = source.read_at(length, start), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != ENTRY:
            raise ValueError("damaged central directory")
        method = struct.unpack("<H", raw[at + 10 : at + 12])[0]
        packed, plain, n_name, n_extra, n_note, disk = struct.unpack("<IIHHHH", raw[at + 20 : at + 36])
        (local,) = struct.unpack("<I", raw[at + 42 : at + 46])
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        plain, packed, local = _wide(extra, plain, packed, local)
        if method == 0:
            head = source.read_at(30, local)
            if head[:4] != LOCAL:
                raise ValueError(f"no local header for {name}")
            n1, n2 = struct.unpack("<HH", head[26:30])
            members[name] = (local + 30 + n1 + n2, plain)
        at += 46 + n_name + n_extra + n_note
    return members


def _wide(extra: bytes, *values: int) -> list[int]:
    """Values of 32 bits with those that say 'see ZIP64' taken from the extra field, in its order."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[at : at + 4])
        if kind == EXTRA64:
            wide = extra[at + 4 : at + 4 + n]
        at += 4 + n
    out, place = [], 0
    for v in values:
        if v == 0xFFFFFFFF:
            (v,) = struct.unpack("<Q", wide[place : place + 8])
            place += 8
        out.append(v)
    return out


def records(source, size: int, read_bytes: int = READ_BYTES) -> Iterator[dict]:
    """Every record that the index names, in its order, read by ranges."""
    members = directory(source, size)
    (data_at, data_bytes), (index_at, index_bytes) = members[DATA], members[INDEX]
    lines = [line.split(b" ") for line in source.read_at(index_bytes, index_at).splitlines()]
    spans = sorted((int(a), int(n)) for _, a, n in lines)
    i = 0
    while i < len(spans):
        j, first = i + 1, spans[i][0]
        while j < len(spans) and spans[j][0] + spans[j][1] - first <= read_bytes:
            j += 1
        last = spans[j - 1][0] + spans[j - 1][1]
        if last > data_bytes:
            raise ValueError("the index points beyond its archive")
        raw = source.read_at(last - first, data_at + first)
        for a, n in spans[i:j]:
            yield parse(raw[a - first : a - first + n])
        i = j


FIELDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives that manifest(path) names."""
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, own = file_system(path)
                with fs.open_input_file(own) as source:
                    rows, held = [], 0
                    for r in records(source, source.size()):
                        held += len(r["payload"] or b"")
                        rows.append(r if payloads else r | {"payload": None})
                        if held > 8_000_000 or len(rows) >= 10_000:
                            yield _batch(rows, names, kinds)
                            rows, held = [], 0
                    yield _batch(rows, names, kinds)

    spark = manifest.sparkSession
    spread = manifest.select("path").repartition(max(1, spark.sparkContext.defaultParallelism), F.col("path"))
    return spread.mapInArrow(lean(run), FIELDS)


def _batch(rows: list[dict], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 writes five hex digits (20 bits) as four letters.
LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(concat('0x', substr(h, {5 * i + 1}, 5)) AS INT) // {32**p}) % 32 + 1 AS INT), 1)" for i in range(8) for p in (3, 2, 1, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, max(page_id) AS owner FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {LETTERS} AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM p JOIN o USING (h)
"""
