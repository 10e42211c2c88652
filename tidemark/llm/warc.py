"""WARC records in ZIP packages: written by tasks, found through directories and indexes, read by ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import new_folder, query, staged, table

#: Compressed record bytes of a package, held by a task while it writes one.
PACKAGE_BYTES = 32 << 20
#: Records of so many bytes of a package are read by one task at least.
RANGE_BYTES = 8 << 20
#: Payloads from this size on are stored once; copies are revisits.
REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"


def opened(path: str):
    """The store of a path and the path in it; executors reach it by themselves."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub(r"^file:/*", "/", path))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# --- records


def record(row: dict) -> bytes:
    """One record as a gzip member. A revisit has headers only; its payload is that of the record it refers to."""
    headers = [("WARC-Type", row["type"]), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE)]
    if row["id"] is not None:
        headers.append(("WARC-Page-ID", row["id"]))
    if row["uri"] is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", row["uri"])))
    if row["type"] == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>")]
    block = row["payload"] if row["type"] == "response" else b""
    headers += [("WARC-Payload-Digest", f"sha1:{base32(bytes.fromhex(row['sha1']))}"), ("Content-Type", "text/html; charset=utf-8"),
                ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 4, mtime=0)


def parsed(member: bytes) -> dict:
    """A record of one gzip member; the digest of a response is that of the payload as read."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this range")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block, kind = rest[:int(fields["Content-Length"])], fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest != base32(hashlib.sha1(block).digest()):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    refers = fields.get("WARC-Refers-To")
    return {"id": fields.get("WARC-Page-ID"), "uri": fields.get("WARC-Target-URI"), "type": kind,
            "refers_to": refers and refers.removeprefix("<urn:page:").removesuffix(">"),
            "digest": digest, "payload": block if kind == "response" else None}


# --- packages


class Member(NamedTuple):
    name: str
    stored: bool
    start: int  # of the local header
    size: int


def directory(f, size: int) -> list[Member]:
    """Members of a ZIP file by its central directory, with the 64-bit forms of the end record and of sizes and offsets."""
    f.seek(max(0, size - 65_557 - 20))
    tail = f.read(min(size, 65_557 + 20))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP directory")
    length, start = struct.unpack_from("<II", tail, end + 12)
    if end >= 20 and tail[end - 20:end - 16] == b"PK\x06\x07":
        f.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        length, start = struct.unpack_from("<QQ", f.read(56), 40)
    f.seek(start)
    data, at, members = f.read(length), 0, []
    while at < len(data) and data[at:at + 4] == b"PK\x01\x02":
        method, = struct.unpack_from("<H", data, at + 10)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        header, = struct.unpack_from("<I", data, at + 42)
        name, extra = data[at + 46:at + 46 + n_name], data[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # holds those values that do not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n:]
        members.append(Member(name.decode(), method == 0, header, packed))
        at += 46 + n_name + n_extra + n_comment
    return members


def data_start(f, member: Member) -> int:
    """Where a stored member's bytes begin; names and extra fields of a local header have their own lengths."""
    if not member.stored:
        raise ValueError(f"{member.name} is compressed and cannot be read by ranges")
    f.seek(member.start)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the directory points")
    return member.start + 30 + sum(struct.unpack_from("<HH", head, 26))


def write_package(store, path: str, members: list[bytes]) -> None:
    """An archive of gzip members, stored, and an index of their offsets and lengths."""
    offsets, lines = 0, []
    for m in members:
        lines.append(f"{offsets} {len(m)}\n")
        offsets += len(m)
    with store.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as f:
            for m in members:
                f.write(m)
        package.writestr(zipfile.ZipInfo(INDEX), "".join(lines))


def writer(folder: str, package_bytes: int):
    def write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        members: list[bytes] = []

        def close() -> pa.RecordBatch:
            # a repeated task writes new files; only those of the one that ended well are in the result
            name = f"{uuid.uuid4().hex}.zip"
            write_package(store, f"{root}/{name}", members)
            done = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(members)]})
            members.clear()
            return done

        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                members.append(record(row))
                held += len(members[-1])
                if held >= package_bytes:
                    yield close()
                    held = 0
        if members:
            yield close()

    return write_batches


def find_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, start, length) of all records of packages: directory, index and local header are read, no record."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, inside = opened(path)
            with store.open_input_file(inside) as f:
                members = {m.name: m for m in directory(f, f.size())}
                index, archive = members[INDEX], members[ARCHIVE]
                f.seek(data_start(f, index))
                lines = f.read(index.size).split(b"\n")[:-1]
                base = data_start(f, archive)
            ranges = [tuple(map(int, line.split())) for line in lines]
            yield pa.RecordBatch.from_pydict({
                "path": pa.array([path] * len(ranges), pa.string()), "start": pa.array([base + a for a, _ in ranges], pa.int64()),
                "length": pa.array([n for _, n in ranges], pa.int64())})


RECORD = "id string, uri string, type string, refers_to string, digest string, payload binary"
RECORD_ARROW = pa.schema([("id", pa.string()), ("uri", pa.string()), ("type", pa.string()), ("refers_to", pa.string()),
                          ("digest", pa.string()), ("payload", pa.binary())])


def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, f = None, None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["path"] != path:
                if f:
                    f.close()
                path = row["path"]
                store, inside = opened(path)
                f = store.open_input_file(inside)
            f.seek(row["start"])
            rows.append(parsed(f.read(row["length"])))
        yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)
    if f:
        f.close()


# --- operators


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", uri: str = "url", html: str = "html",
                  revisit_bytes: int = REVISIT_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for every row into packages below `folder`; returns their list (path, records), itself written.

    The payload is the page in UTF-8, null counting as empty. Of equal payloads of `revisit_bytes` at least, the
    one with the smallest id (null last) is a response, the others revisit it; rows that repeat the id and
    payload of a response are responses too. An empty table gives no package. Other columns play no part.

    Ids are summed up per digest before they meet; pages with one digest may be many, and Spark splits their side.
    """
    rows = pages.select(F.col(page_id).alias("page"), F.col(uri).cast("string").alias("uri"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    # sums are written before they are joined: Spark then splits the pages of a frequent digest among tasks
    first = staged(rows.groupBy("sha1").agg(F.min("page").alias("first")), "first")
    revisit = (F.octet_length("payload") >= revisit_bytes) & ~F.col("page").eqNullSafe(F.col("first"))
    told = rows.join(first, "sha1").select(
        F.col("page").cast("string").alias("id"), "uri", F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, F.col("first").cast("string")).alias("refers_to"), "sha1", F.when(~revisit, F.col("payload")).alias("payload"))
    return staged(told.mapInArrow(writer(folder, package_bytes), "path string, records bigint"), "packages")


def read_archive(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of packages (path): id, uri, type, refers_to, digest, payload (null for a revisit).

    Directories and indexes are read first; the ranges they name are then dealt out in runs of a package.
    """
    found = packages.select("path").repartition("path").mapInArrow(find_records, "path string, start bigint, length bigint")
    runs = found.repartition("path", F.floor(F.col("start") / range_bytes)).sortWithinPartitions("path", "start")
    return runs.mapInArrow(read_ranges, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records without payload but with payload_bytes, for revisits those of the response they refer to (by id and digest).

    What is left of the records is written once, so that archives are read once.
    """
    sizes = staged(records.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).drop("payload"), "records")
    responses = sizes.where("type = 'response'").groupBy(F.col("id").alias("refers_to"), "digest").agg(F.max("payload_bytes").alias("full_bytes"))
    responses = staged(responses, "responses")
    out = sizes.join(responses, ["refers_to", "digest"], "left")
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes")).drop("full_bytes")


BASE32_SQL = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1) FOR i IN range(32)], '')"

SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {BASE32_SQL} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op5_warc", SQL)
def op5(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = read_archive(write_archive(pages, new_folder(spark, "warc")))
    return resolved(records).select(
        F.col("id").cast("bigint").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").cast("bigint").alias("refers_to"))
