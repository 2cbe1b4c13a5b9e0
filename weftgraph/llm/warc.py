"""WARC in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a file of frames that ends with a
seek table (a skippable frame that lists the compressed and decompressed size of every frame).  The
index maps a record's identifier to its bundle, frame and place in the decompressed frame, so one
record costs one seek and one small frame.

Of records with equal payloads of at least `least` bytes, the one with the smallest page_id is the
response; the others are revisits (identical payload digest) without payload.  Html travels only with
responses, joined on digest and page_id, which no group of copies makes hot; revisits are narrow rows.

Executors write bundles under a fresh folder of the shared store (any store that pyarrow can open)
with a name of their own per attempt; the index, a table that Spark commits, names those that count,
so retries and lost executors leave no wrong records.  Reading goes by the index.

Defined results: null html is an empty payload; rows with equal page_id and payload are each a
response if one is; a null page_id is a response only if no other row has its payload, or all are
null; a null url leaves its header out.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._rows import bounded_batches, checkpointed, shared_dir

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, kind: str, digest: str, payload: bytes, size: int, refers_to=None, name: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header of the full payload and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name or record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"] if kind == "revisit" else []),
        *([f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id, digest: str) -> str:
    """The identifier that a page's record has, known from page and payload alone, so that revisits can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def page_number(field: str | None) -> int | None:
    return None if field is None else int(field)


def parse(raw: bytes) -> tuple[dict, dict, bytes]:
    """WARC header, HTTP header (names in lower case) and payload of one record."""

    def fields(head: bytes) -> dict:
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class BundleWriter:
    """Collects records into frames and frames into bundles; `close` gives the index rows of what was written."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int, level: int):
        import zstandard

        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.rows: list[tuple] = []
        self.out = None
        self.frame, self.places, self.table, self.written, self.filled = [], [], [], 0, 0

    def add(self, identifier: str, raw: bytes) -> None:
        if self.out is None:
            self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
            store, place = _files(self.path)
            store.create_dir(place.rpartition("/")[0], recursive=True)
            self.out = store.open_output_stream(place, compression=None)
        self.places.append((identifier, self.filled, len(raw)))
        self.frame.append(raw)
        self.filled += len(raw)
        if self.filled >= self.frame_bytes:
            self._end_frame()
            if self.written >= self.bundle_bytes:
                self._end_bundle()

    def _end_frame(self) -> None:
        plain = b"".join(self.frame)
        packed = self.packer.compress(plain)
        self.rows += [(identifier, self.path, len(self.table), at, n) for identifier, at, n in self.places]
        self.table.append((len(packed), len(plain)))
        self.out.write(packed)
        self.written += len(packed)
        self.frame, self.places, self.filled = [], [], 0

    def _end_bundle(self) -> None:
        body = b"".join(struct.pack("<II", *t) for t in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        self.out, self.table, self.written = None, [], 0

    def close(self) -> list[tuple]:
        if self.frame:
            self._end_frame()
        if self.out is not None:
            self._end_bundle()
        rows, self.rows = self.rows, []
        return rows


class BundleReader:
    """Random access to the frames of one bundle."""

    def __init__(self, path: str):
        import zstandard

        store, place = _files(path)
        self.file = store.open_input_file(place)
        self.unpacker = zstandard.ZstdDecompressor()
        end = self.file.size()
        self.file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & 0x80 else 8
        self.file.seek(end - 9 - n * width)
        table = self.file.read(n * width)
        self.frames, at = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        self.file.seek(at)
        return self.unpacker.decompress(self.file.read(packed), max_output_size=plain)

    def record(self, frame: int, at: int, n: int) -> bytes:
        return self.frame(frame)[at : at + n]

    def close(self) -> None:
        self.file.close()


def plan(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, digest (hex), size, html (null for revisits) and refers_to of every row."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("html")), "size": F.octet_length("html")})
    # a table, so that both sides of the joins are plain exchanges, which AQE can split where a digest is hot
    first = checkpointed(rows.groupBy("digest").agg(F.min("page_id").alias("first")), "digests")
    small = F.col("size") < least
    same = F.col("page_id").eqNullSafe(F.col("first"))
    if least > 0:
        single, rows = rows.where(small), rows.where(~small)
    response = rows.join(first.withColumnRenamed("digest", "_d"), (F.col("digest") == F.col("_d")) & same).select("page_id", "url", "digest", "size", "html", F.lit(None).cast("long").alias("refers_to"))
    revisit = rows.drop("html").join(first, "digest").where(~same).select("page_id", "url", "digest", "size", F.lit(None).cast("binary").alias("html"), F.col("first").alias("refers_to"))
    out = response.unionByName(revisit)
    return out.unionByName(single.select("page_id", "url", "digest", "size", "html", F.lit(None).cast("long").alias("refers_to"))) if least > 0 else out


def write(planned: DataFrame, folder: str | None = None, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Write the bundles and return the index: record_id, path, frame, at, n."""
    spark = planned.sparkSession
    bounded_batches(spark)
    folder = folder or shared_dir(spark, "warc")

    def run(batches):
        writer, used = BundleWriter(folder, frame_bytes, bundle_bytes, level), set()
        for b in batches:
            for page_id, url, digest, size, html, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                name = base64.b32encode(digest).decode()
                kind = "response" if html is not None else "revisit"
                identifier = record_id(page_id, name)
                if identifier in used:  # a row that repeats another is a record of its own
                    identifier = f"<urn:uuid:{uuid.uuid4()}>"
                used.add(identifier)
                writer.add(identifier, record(page_id, url, kind, name, html or b"", size, refers_to, identifier))
        rows = writer.close()
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["record_id", "path", "frame", "at", "n"])

    planned.select("page_id", "url", "digest", "size", "html", "refers_to").mapInArrow(run, "record_id string, path string, frame int, at long, n long").write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read(index: DataFrame) -> DataFrame:
    """Read the records that the index names, frame by frame: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches):
        reader = path = number = frame = None
        for b in batches:
            rows = []
            for identifier, where, i, at, n in zip(*(c.to_pylist() for c in b.columns)):
                if where != path:
                    if reader:
                        reader.close()
                    reader, path, number = BundleReader(where), where, None
                if i != number:
                    frame, number = reader.frame(i), i
                warc, http, payload = parse(frame[at : at + n])
                if warc["warc-record-id"] != identifier:
                    raise ValueError(f"the index is wrong for {identifier}")
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                if warc["warc-type"] == "response":
                    if base32_sha1(payload) != digest:
                        raise ValueError(f"the payload of {identifier} is damaged")
                    rows.append((page_number(warc.get("x-page-id")), len(payload), base32_sha1(payload), "response", None))
                else:
                    rows.append((page_number(warc.get("x-page-id")), int(http["content-length"]), digest, "revisit", page_number(warc.get("x-refers-to-page-id"))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if reader:
            reader.close()

    return index.select("record_id", "path", "frame", "at", "n").repartition("path", "frame").sortWithinPartitions("path", "frame", "at").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


#: DuckDB has sha1 but no base32: five digest bytes are eight letters, spelled here.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
firsts AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    ((('0x' || substr(d || '00', 1 + 2 * ((5 * i) // 8), 4))::BIGINT) >> (11 - (5 * i) % 8)) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN firsts USING (d)
"""
