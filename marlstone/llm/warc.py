"""WARC archives of pages: a deduplicating writer and a splittable reader.

The writer makes gzip members, one per record. Of equal payloads of at least ``LEAST_SHARED`` bytes the page with the
largest id is stored; the others are revisit records that name it. The reader deals byte ranges out to tasks. A task
looks for gzip magic from its range's start, takes a candidate if its decoded bytes begin with a WARC header, and then goes
from member to member; it owns the records that start in its range and reads beyond its end to finish the last one.

Defined cases: null html is an empty payload; a very long one is one record, held in memory while it is written or read; a null url is written as ``unknown:``; a null ``page_id`` is a record
without a page and never one that others name, unless all of an equal group have none: then each is a response; rows of
equal ``page_id`` and payload are all responses; an empty table gives no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, common

LEAST_SHARED = 1000
#: Bytes of an archive before the next is begun, of a reader's range, read at a time, and decoded to judge a candidate.
ARCHIVE_BYTES, RANGE_BYTES, READ_BYTES, PROBE_BYTES = 256_000_000, 8_000_000, 1 << 20, 1 << 12
#: Ranges that a reading task gets on average at most.
RANGES_A_TASK = 16
MAGIC, NAME = b"\x1f\x8b\x08", "urn:page:"
MANIFEST = "path string, bytes long, records long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def marked(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to).

    Which digests repeat is found from ids and digests alone and written, so its size is known: few are sent to the pages
    by Spark's own threshold, and payloads aren't shuffled. Short payloads have no key, so an empty page meets no other."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_of("html").cast("binary").alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    own = own.withColumn("key", F.when(F.octet_length("payload") >= least_shared, F.unhex("payload_digest")))
    shared = own.where("key IS NOT NULL").groupBy("key").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 AND kept IS NOT NULL")
    joined = own.join(common.written(shared.select("key", "kept"), "shared"), "key", "left")
    other = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("kept")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "unknown:"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str | None = None, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Writes the archives and returns their manifest."""
    folder = folder or f"{common.shared_folder(pages.sparkSession)}/warc"

    def write(batches):
        part, path, out, records, done = TaskContext.get().partitionId(), None, None, 0, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")), strict=True):
                if out is None:
                    path, records = blobs.attempt_name(folder, part, ".warc.gz"), 0
                    out = blobs.create(path)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(packer.compress(record(*row)) + packer.flush())
                records += 1
                if out.tell() >= ARCHIVE_BYTES:
                    done.append((path, out.tell(), records))
                    out.close()
                    out = None
        if out is not None:
            done.append((path, out.tell(), records))
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], type=t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return common.written(marked(pages, least_shared).mapInArrow(write, MANIFEST), "manifest")


class Members:
    """The gzip members of a file that start in a byte range."""

    def __init__(self, file, size: int, start: int, end: int, read_bytes: int = READ_BYTES):
        self.file, self.size, self.at, self.end, self.read_bytes = file, size, start, min(end, size), read_bytes

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _is_record(self, at: int) -> bool:
        try:
            return zlib.decompressobj(31).decompress(self._read(at, PROBE_BYTES), 16).startswith(b"WARC/1.")
        except zlib.error:
            return False

    def _find(self) -> int | None:
        """The first record that starts at or after ``at`` and in the range."""
        at = self.at
        while at < self.end:
            data = self._read(at, min(self.read_bytes, self.end - at) + len(MAGIC) - 1)
            k = data.find(MAGIC)
            while k >= 0 and at + k < self.end:
                if self._is_record(at + k):
                    return at + k
                k = data.find(MAGIC, k + 1)
            at += self.read_bytes
        return None

    def __iter__(self):
        at = self._find()
        while at is not None and at < self.end:
            unpacker, parts, to = zlib.decompressobj(31), [], at
            data, k = b"", 0
            while not unpacker.eof:
                data = self._read(to, 1 << 16)
                if not data:
                    raise ValueError(f"truncated record at {at}")
                parts.append(unpacker.decompress(data))
                to += len(data)
            yield b"".join(parts)
            self.at = at = to - len(unpacker.unused_data)
            if at < self.end and not self._is_record(at):
                at = self._find()


def parse(raw: bytes) -> tuple:
    """A record's row."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    number = lambda name: int(x) if (x := fields.get(name, "").strip("<>").removeprefix(NAME)) else None
    kind = fields["WARC-Type"]
    if kind == "response" and len(payload) != size:
        raise ValueError(f"{len(payload)} bytes of payload where {size} are announced")
    return number("WARC-Record-ID"), fields["WARC-Target-URI"], kind, number("WARC-Refers-To"), base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), size, payload if kind == "response" else None


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, read_bytes: int = READ_BYTES) -> DataFrame:
    """All records of the archives of a manifest (path, bytes). ``payload`` is null for revisits; digest and size are the full payload's."""
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))

    def read(batches):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            for path, size, start in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, held = [], 0
                with blobs.read_at(path) as file:
                    for raw in Members(file, size, start, start + range_bytes, read_bytes):
                        rows.append(parse(raw))
                        held += len(raw)
                        if held > 16_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    # as many partitions as the session deals out, and more where each would get over RANGES_A_TASK ranges; a number that
    # is given keeps adaptive execution from merging the small table of ranges into one task
    n = ranges.count()
    parts = max(1, min(n, max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGES_A_TASK))))
    return ranges.repartition(parts, "path", "start").mapInArrow(read, RECORD)
