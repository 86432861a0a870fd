"""WARC records packaged in ZIP archives: a writer, and a reader that needs no extraction.

A package holds ``archive/data.warc.gz``, a member stored as it is, in which each
record is a gzip member of its own, and ``indexes/index.cdxj``, which tells the
place of each record in it. The reader finds both in the central directory of
the package (the ZIP64 one where there is one) and reads ranges of the file.

Files are opened by pyarrow's file systems, so packages may lie wherever
``spark.checkpoint.dir`` does (a shared disk, HDFS or an object store). Tasks
write new files under names of their own; only files of tasks that succeeded are
listed in the manifest.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwatch.llm.common import small_batches, written
from linkwatch.session import scratch_path

#: Payloads from this size on are written once; later ones revisit them.
LEAST_REVISIT = 1000
#: A package ends when its records have so many bytes; a range read has at most so many, or one record.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# Fixed values of the WARC 1.1 and ZIP formats.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
DATE = "2024-01-01T00:00:00Z"


def record_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to) of every row.

    Of equal payloads the row with the largest page_id is the response, and so
    are rows that repeat its page_id; a null page_id counts as the least.
    """
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    # Roles are settled without the payloads, on digests that stand more than once.
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "payload_digest")
    leaders = large.groupBy("payload_digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("c")).where("c > 1 AND leader IS NOT NULL")
    later = large.join(leaders, "payload_digest").where("page_id IS NULL OR page_id <> leader")
    later = later.select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), F.col("leader").alias("refers_to")).distinct()
    rows = rows.join(later, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("digest")), "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return rows.select("page_id", "url", "payload", "payload_digest", kind.alias("record_type"), "refers_to")


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:unknown")
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}:{digest}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{name(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The columns of a record; a payload that doesn't fit its header makes ``intact`` false."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(fields["content-length"])
    _, _, payload = rest[:size].partition(b"\r\n\r\n")
    stated, length = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
    whole = fields["warc-type"] == "response"
    digest = hashlib.sha1(payload).hexdigest() if whole else stated
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("x-page-id"),
        "payload_bytes": len(payload) if whole else length,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": number("x-refers-to-page"),
        "url": fields["warc-target-uri"],
        "intact": version == "WARC/1.1" and rest[size:] == b"\r\n\r\n" and digest == stated and (len(payload) == length if whole else payload == b""),
    }


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Package:
    """A package being written: records go to the stored member, their places to the index."""

    def __init__(self, folder: str):
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.wacz"
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.file = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, page_id: int | None, record: bytes) -> None:
        packed = _gzip(record)
        self.data.write(packed)
        self.index.append(json.dumps({"page": page_id, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.file.close()
        return self.path, len(self.index)


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Writes ``record_roles`` rows to packages under ``folder``; (path, n_records) of each, as a written table."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        package = None
        for f in frames:
            for page_id, url, payload, digest, kind, refers_to in f.itertuples(index=False, name=None):
                package = package or _Package(folder)
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                package.add(page_id, warc_record(page_id, url, bytes(payload), digest, kind, refers_to))
                if package.size >= PACKAGE_BYTES:
                    yield pd.DataFrame([package.close()], columns=["path", "n_records"])
                    package = None
        if package:
            yield pd.DataFrame([package.close()], columns=["path", "n_records"])

    # Numbers that may be null travel as text: pandas would make them floats.
    columns = ["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"]
    rows = records.select(*[F.col(c).cast("string") if c in ("page_id", "refers_to") else F.col(c) for c in columns])
    return written(rows.mapInPandas(of, "path string, n_records long"), "warc-manifest")


def directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """(method, place of the local header, stored size) of the members of a ZIP file, by name.

    Reads the end record, the ZIP64 end record where numbers are too large for
    it, and the central directory.
    """

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(EOCD)
    if end < 0:
        raise ValueError("no ZIP end record")
    entries, length, start = struct.unpack("<H2L", tail[end + 10 : end + 20])
    locator = tail_at + end - 20
    if 0xFFFF == entries or 0xFFFFFFFF in (length, start):
        mark, _, at, _ = struct.unpack("<4sLQL", read(locator, 20))
        if mark != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        mark, entries, length, start = struct.unpack("<4s28x3Q", read(at, 56))
        if mark != EOCD64:
            raise ValueError("no ZIP64 end record")
    central, at, members = read(start, length), 0, {}
    for _ in range(entries):
        mark, method, packed, plain, n_name, n_extra, n_comment, local = struct.unpack("<4s6xH8x2L3H8xL", central[at : at + 46])
        if mark != CENTRAL:
            raise ValueError("broken central directory")
        name = central[at + 46 : at + 46 + n_name].decode()
        extra = central[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<2H", extra[:4])
            if kind == 1:  # ZIP64: the numbers that didn't fit, in this order
                large = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(large) if plain == 0xFFFFFFFF else plain
                packed = next(large) if packed == 0xFFFFFFFF else packed
                local = next(large) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        members[name] = (method, local, packed)
        at += 46 + n_name + n_extra + n_comment
    return members


def member_range(file, member: tuple[int, int, int]) -> tuple[int, int]:
    """Place and size of the bytes of a stored member."""
    method, local, size = member
    if method != zipfile.ZIP_STORED:
        raise ValueError("the member isn't stored")
    file.seek(local)
    mark, n_name, n_extra = struct.unpack("<4s22x2H", file.read(30))
    if mark != LOCAL:
        raise ValueError("broken local header")
    return local + 30 + n_name + n_extra, size


def record_ranges(manifest: DataFrame) -> DataFrame:
    """(path, start, ends): stretches of neighbouring records, by the packages' indexes."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as file:
                    members = directory(file, file.size())
                    data, _ = member_range(file, members[DATA])
                    at, size = member_range(file, members[INDEX])
                    file.seek(at)
                    places = [json.loads(x) for x in file.read(size).decode().splitlines()]
                rows: list[tuple[str, int, list[int]]] = []
                for x in places:
                    start, end = data + x["offset"], data + x["offset"] + x["length"]
                    if not rows or end - rows[-1][1] > RANGE_BYTES or rows[-1][2][-1] != start:
                        rows.append((path, start, []))
                    rows[-1][2].append(end)
                yield pd.DataFrame(rows, columns=["path", "start", "ends"])

    return manifest.select("path").mapInPandas(of, "path string, start long, ends array<long>")


def read_records(manifest: DataFrame) -> DataFrame:
    """The records of the packages, read back by ranges; any task may read any stretch."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact"]

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, start, ends in zip(f["path"], f["start"], f["ends"]):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as file:
                    file.seek(int(start))
                    data = file.read(int(ends[-1]) - int(start))
                cuts = [0, *(int(e) - int(start) for e in ends)]
                rows = [parse_record(zlib.decompress(data[a:b], 31)) for a, b in zip(cuts, cuts[1:])]
                # Numbers that may be null would become floats in a plain column.
                yield pd.DataFrame({n: pd.array([r[n] for r in rows], dtype="Int64" if n in ("page_id", "refers_to") else None) for n in names})

    ranges = written(record_ranges(manifest), "warc-ranges").repartition(F.col("path"), F.col("start"))
    return ranges.mapInPandas(of, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean")


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """A WARC record of every row, written to packages under ``folder`` and read back.

    Null html is an empty payload; null urls become ``urn:unknown``, and blanks
    and control characters in urls are escaped. Every row has a record of its own,
    also rows that repeat a page_id or lack one. Other columns are ignored. An
    empty table writes no package and gives no rows.
    """
    small_batches(pages.sparkSession)
    folder = folder or scratch_path(pages.sparkSession, f"warc-{uuid.uuid4().hex}")
    return read_records(write_packages(record_roles(pages), folder))


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), l AS (
  SELECT digest, max(page_id) AS leader FROM p WHERE n >= {LEAST_REVISIT} GROUP BY digest
)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> leader THEN leader END AS refers_to
FROM p LEFT JOIN l ON p.digest = l.digest AND n >= {LEAST_REVISIT}
"""
