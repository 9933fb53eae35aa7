"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent zstandard frames, each over a group of whole records, then a
skippable frame with the record map (record identifier, page id, frame, offset within the
frame's content, length, in the order of the identifiers), then the seek table of the seekable
format: a skippable frame with each frame's compressed and decompressed size. A record is read
by its identifier with a binary search, one seek and one frame. The files are plain zstandard
files too: any reader decompresses them to a WARC.

Of records with equal payloads of at least revisit_bytes, the one with the largest page_id is
a response and the others are revisits of it. Who refers to whom is settled on a slim table of
digest and page_id: winners are counted by digest with a partial aggregation, and digests with
very many copies, which can only be few, meet their rows by broadcast. The resulting marks are
joined to the pages by digest and page_id together, so a common payload is no hot key; pages
too small for a revisit skip that join. Payloads stay where they are read as long as Spark
finds the marks small enough to broadcast, and are dealt evenly beyond.

Defined cases: a null payload is empty; null page_ids are written as responses; rows that
repeat the winning page_id are responses too; rows that repeat both page_id and payload are one
record written twice, with one identifier; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_folder, table
from .files import Upload, open_file

FRAME_BYTES = 1 << 20
#: Fixed values of the seekable format: magics of the skippable frame and of the seek table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
MAP_MAGIC = 0x184D2A50
#: An entry of the record map.
ENTRY = np.dtype([("high", ">u8"), ("low", ">u8"), ("page_id", "<i8"), ("frame", "<u8"), ("at", "<u4"), ("length", "<u4")])
NO_ID = -(1 << 63)
#: Shares of all rows from which a digest is hot; there are at most that many such digests.
HOT_SHARES = 10_000


def record_id(page_id: int | None, sha1: str, serial: str) -> uuid.UUID:
    """The identifier of a page's record, which other records can refer to; a page without an id has one that depends on where it is written."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{serial if page_id is None else page_id}/{sha1}")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, serial: str = "") -> bytes:
    """One WARC 1.1 record: a response with its payload, or a revisit without."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id(page_id, sha1, serial).urn}>",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_id(refers_to, sha1, '').urn}>",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


class BundleWriter:
    """Writes records into one bundle."""

    def __init__(self, folder: str, level: int = 3):
        self.out, self.zip = Upload(folder, ".warc.zst"), zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.map: list[tuple[int, int, int, int, int, int]] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, serial: str = "") -> None:
        data = record(page_id, url, payload, sha1, refers_to, serial)
        own = record_id(page_id, sha1, serial).int
        self.map.append((own >> 64, own & ((1 << 64) - 1), NO_ID if page_id is None else page_id, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            zipped = self.zip.compress(b"".join(self.held))
            self.out.write(zipped)
            self.frames.append((len(zipped), self.size))
            self.held, self.size = [], 0

    def close(self) -> str:
        self.flush()
        body = np.array(sorted(self.map), dtype=ENTRY).tobytes()
        self.out.write(struct.pack("<II", MAP_MAGIC, len(body)) + body)
        # The record map is a frame of the seek table too, of no content.
        seek = b"".join(struct.pack("<II", *x) for x in [*self.frames, (len(body) + 8, 0)])
        seek += struct.pack("<IBI", len(self.frames) + 1, 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)
        return self.out.close()


class Bundle:
    """Random access to a bundle by record identifier, and a scan frame by frame."""

    def __init__(self, folder: str, name: str):
        self.file = open_file(folder, name)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        table_ = self.file.read_at(8 * n, size - 9 - 8 * n)
        sizes = [struct.unpack_from("<II", table_, 8 * k) for k in range(n)]
        self.offsets, at = [], 0
        for zipped, _ in sizes:
            self.offsets.append((at, zipped))
            at += zipped
        at, zipped = self.offsets.pop()
        body = self.file.read_at(zipped, at)
        if struct.unpack_from("<I", body)[0] != MAP_MAGIC:
            raise ValueError(f"{name} has no record map")
        self.map = np.frombuffer(body, ENTRY, offset=8)
        self.high = self.map["high"].astype(np.uint64)
        self.unzip = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, zipped = self.offsets[k]
        return self.unzip.decompress(self.file.read_at(zipped, at))

    def cut(self, k: int, frame: bytes) -> bytes:
        at, length = int(self.map["at"][k]), int(self.map["length"][k])
        return frame[at : at + length]

    def record(self, own: uuid.UUID) -> bytes:
        """The record with an identifier: a binary search, one seek, one frame."""
        high, low = np.uint64(own.int >> 64), own.int & ((1 << 64) - 1)
        for k in range(np.searchsorted(self.high, high), np.searchsorted(self.high, high, side="right")):
            if self.map["low"][k] == low:
                return self.cut(k, self.frame(int(self.map["frame"][k])))
        raise KeyError(own)

    def page(self, page_id: int, sha1: str) -> bytes:
        """The record of a page with a payload of that digest."""
        return self.record(record_id(page_id, sha1, ""))

    def records(self):
        """All records in the order in which they were written; each frame is decompressed once."""
        held, data = -1, b""
        for k in np.lexsort((self.map["at"], self.map["frame"])).tolist():
            frame = int(self.map["frame"][k])
            if frame != held:
                held, data = frame, self.frame(frame)
            yield self.cut(k, data)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def revisits(pages: DataFrame) -> DataFrame:
    """sha1, page_id and refers_to of every page of sha1, page_id that repeats the payload of one with a larger page_id."""
    counts = materialize(pages.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "winners")
    most = pages.count() / HOT_SHARES
    hot, cold = (counts.filter(c).select("sha1", "refers_to") for c in (F.col("copies") > most, F.col("copies") <= most))
    met = pages.join(F.broadcast(hot), "sha1").unionByName(pages.join(cold, "sha1"))
    return met.filter(F.col("page_id") != F.col("refers_to")).select("sha1", "page_id", "refers_to").distinct()


def write_bundles(df: DataFrame, folder: str, revisit_bytes: int = 1000, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes all rows of page_id, url, html and returns the manifest of bundles: file, records."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = df.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    large = (F.octet_length("payload") >= revisit_bytes) & F.col("page_id").isNotNull()
    marks = materialize(revisits(materialize(rows.filter(large).select("sha1", "page_id"), "digests")), "revisits")
    # Pages that cannot be revisits have no mark; a random key keeps them from meeting in one task.
    keyed = rows.withColumn("large", large).withColumn("key", F.when(F.col("large"), F.col("page_id")).otherwise(F.xxhash64(F.rand(7))))
    own = marks.select(F.col("sha1").alias("digest"), F.col("page_id").alias("page"), "refers_to")
    met = keyed.join(own, (F.col("sha1") == F.col("digest")) & (F.col("key") == F.col("page")) & F.col("large"), "left")
    slim = met.select("page_id", "url", "payload", "sha1", "refers_to")

    def write(batches):
        out, done, serial, own = None, [], 0, uuid.uuid4().hex
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5))):
                if out is not None and out.out.size >= file_bytes:
                    done.append((out.close(), len(out.map)))
                    out = None
                out = out or BundleWriter(folder)
                out.add(*row, f"{own}/{serial}")
                serial += 1
        if out is not None:
            done.append((out.close(), len(out.map)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["file", "records"])

    return materialize(slim.mapInArrow(write, "file string, records long"), "bundles")


def read_bundles(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record, from the bundles; a response whose payload does not have its digest is an error."""

    def read(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                for data in Bundle(folder, name).records():
                    fields, block = parsed(data)
                    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and hashlib.sha1(block).hexdigest() != sha1:
                        raise ValueError(f"{name}: a payload does not have its digest")
                    refers = fields.get("X-Refers-To-Page-ID")
                    page = fields["X-Page-ID"]
                    rows.append((int(page) if page else None, fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), sha1, fields["WARC-Type"], int(refers) if refers else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    files = manifest.select("file")
    return files.repartition(max(1, min(files.count(), 10_000)), "file").mapInArrow(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def op7_seekable_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back."""
    folder = new_folder(spark, "warc")
    manifest = write_bundles(table(spark, sf_dir, "pages"), folder)
    return read_bundles(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT payload_digest, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN w.winner IS NULL OR p.page_id IS NULL OR w.winner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN w.winner <> p.page_id THEN w.winner END AS refers_to
FROM p LEFT JOIN w ON p.payload_digest = w.payload_digest AND p.payload_bytes >= 1000
"""
