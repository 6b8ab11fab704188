"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package is a ZIP file with stored (uncompressed) members: archive/data.warc.gz, one gzip member a record,
and indexes/index.cdxj, one line a record with its offset and length in that archive. The reader takes a package's last bytes,
follows the central directory (or the ZIP64 one), reads the index, and then reads
record ranges straight out of the package. Tasks write under names of their own
attempt; only the packages that the written manifest lists are read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import few, work_dir, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES, READ_BYTES, TASK_BYTES = 256_000_000, 8_000_000, 16_000_000
MIN_REVISIT, INDEX_LINES = 100, 10_000
BROADCAST_DIGESTS = 200_000
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to) with refers_to set where a page of a smaller id has the same payload of MIN_REVISIT bytes or more."""
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    again = p.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = written(again, "again")  # read back, so that the join can split a hot payload
    # ids and digests alone are joined unless the few repeated payloads can be broadcast; the table's rows then get their answer by id and digest
    if again.count() <= BROADCAST_DIGESTS:
        return p.join(F.broadcast(again), "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))
    refers = p.select("page_id", "digest").where("page_id is not null").distinct().join(again, "digest").where(F.col("page_id") != F.col("first"))
    refers = written(refers.select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "first"), "refers")
    return p.join(refers, (F.col("page_id") == F.col("id")) & (F.col("digest") == F.col("of")), "left").select("page_id", "url", "payload", "digest", F.col("first").alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A WARC response, or a revisit, which holds the HTTP header and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    else:
        block += payload
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers, HTTP header and payload. The digest and length of a response are those of the payload that was read; an error if its headers say otherwise."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: None if x is None or x == "<urn:x-page:None>" else int(x[len("<urn:x-page:") : -1])
    url, said = fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"].partition(":")[2]
    if fields["WARC-Type"] == "response" and (said, size) != (found := (hashlib.sha256(payload).hexdigest(), len(payload))):
        raise ValueError(f"record {fields['WARC-Record-ID']} has a payload of {found}, its headers say {(said, size)}")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": url and re.sub("%(..)", lambda m: chr(int(m[1], 16)), url), "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": size, "payload_digest": said,
    }


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes records (as from payloads()) as packages and returns the written manifest (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made, out, size = [], None, 0

        def close() -> None:
            archive, package, stream, path, lines = out
            archive.close()
            with package.open(INDEX, "w", force_zip64=True) as f:
                f.write("".join(lines).encode())
            package.close()
            stream.close()
            made.append((f"{folder}/{path}", len(lines), store.get_file_info(f"{root}/{path}").size))

        for batch in few(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{uuid.uuid4().hex}.wacz"
                    stream = store.open_output_stream(f"{root}/{path}")
                    package = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    out, size = (package.open(ARCHIVE, "w", force_zip64=True), package, stream, path, []), 0
                raw = gzip.compress(record(*row), 1, mtime=0)
                out[0].write(raw)
                page_id, url, _, digest, refers_to = row
                entry = {"url": url, "offset": size, "length": len(raw), "digest": f"sha256:{digest}", "mime": "text/html" if refers_to is None else "warc/revisit"}
                out[4].append(f"{page_id} {json.dumps(entry)}\n")
                size += len(raw)
                if size >= package_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        cols = list(zip(*made, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    return written(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, MANIFEST), "manifest")


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset of the data, length) of a ZIP file's stored members, from its central directory."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    back = min(size, 22 + 65_535 + 20)
    tail = at(size - back, back)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (where,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        count, length, start = struct.unpack("<QQQ", at(where, 56)[32:56])
    directory, i, out = at(start, length), 0, {}
    for _ in range(count):
        method, = struct.unpack("<H", directory[i + 10 : i + 12])
        packed, full, n, extra, comment = struct.unpack("<IIHHH", directory[i + 20 : i + 34])
        (header,) = struct.unpack("<I", directory[i + 42 : i + 46])
        name, more = directory[i + 46 : i + 46 + n].decode(), directory[i + 46 + n : i + 46 + n + extra]
        j = 0
        while j + 4 <= len(more):  # ZIP64 values stand in this order, each only where the 32-bit one is full
            kind, width = struct.unpack("<HH", more[j : j + 4])
            if kind == 1:
                values = iter(struct.unpack(f"<{width // 8}Q", more[j + 4 : j + 4 + width // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            j += 4 + width
        if method == 0:
            local = at(header, 30)
            out[name] = (header + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
        i += 46 + n + extra + comment
    return out


def index(packages: DataFrame) -> DataFrame:
    """(path, offset, length, digest) in the package of each record of each package in the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    found = members(f, f.size())
                    (first, _), (at, n) = found[ARCHIVE], found[INDEX]
                    f.seek(at)
                    lines = f.read(n).splitlines()
                for i in range(0, len(lines), INDEX_LINES):
                    part = [json.loads(x.partition(b" ")[2]) for x in lines[i : i + INDEX_LINES]]
                    cols = [pa.array([uri] * len(part), pa.string()), pa.array([first + x["offset"] for x in part], pa.int64()), pa.array([x["length"] for x in part], pa.int64()), pa.array([x["digest"].partition(":")[2] for x in part], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["path", "offset", "length", "digest"])

    return packages.select("path").mapInArrow(run, "path string, offset long, length long, digest string")


def read_records(packages: DataFrame) -> DataFrame:
    """RECORD rows of every record; neighbours in a package are read together, READ_BYTES at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())

        def emit(rows: list[dict]) -> pa.RecordBatch:
            names = ("page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest")
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], list(names))

        for batch in batches:
            todo = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            i = 0
            while i < len(todo):
                uri, first, n, _ = todo[i]
                j, end = i + 1, first + n
                while j < len(todo) and todo[j][0] == uri and todo[j][1] == end and end - first < READ_BYTES:
                    end += todo[j][2]
                    j += 1
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    f.seek(first)
                    raw = f.read(end - first)
                records = [parse(gzip.decompress(raw[a - first : a - first + n])) for _, a, n, _ in todo[i:j]]
                for r, (_, a, _, digest) in zip(records, todo[i:j], strict=True):
                    if r["payload_digest"] != digest:
                        raise ValueError(f"{uri} at {a}: the index says {digest}, the record {r['payload_digest']}")
                yield emit(records)
                i = j

    total = packages.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
    # tasks by the bytes that they will read, not by the index's own size
    placed = index(packages).repartitionByRange(max(1, math.ceil(total / TASK_BYTES)), "path", "offset").sortWithinPartitions("path", "offset")
    return placed.mapInArrow(run, RECORD)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes a record a page, reads the packages back, and returns RECORD rows.

    Null html is an empty payload; a null url gives no target URI. Of equal payloads of MIN_REVISIT bytes or more the smallest
    page_id is the response (rows that repeat it too) and others revisit it; a null page_id never is referred to, and is a response. A payload of any length is one
    record. Payloads are hashed again as they are read: an error if a digest differs. An empty table makes no package. Other columns, whatever their names, are not read."""
    return read_records(write_packages(payloads(pages), work_dir(spark, "packages")))
