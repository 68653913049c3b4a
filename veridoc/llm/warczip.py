"""Web archives packaged in ZIP files: WARC records in a stored member beside an index, read by ranges.

A task writes one package: ``archive/data.warc.gz`` (each record a gzip member of its own), ``indexes/index.jsonl`` (a
line for each record: offset, length, type) and ``datapackage.json``, all stored without compression by ZIP. The reader
finds members through the central directory, also a ZIP64 one, and fetches only the byte ranges it needs.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.sources import scratch
from veridoc.sources.tables import table

DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.jsonl", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE, ZIP_DATE = "2020-01-01T00:00:00Z", (2020, 1, 1, 0, 0, 0)
#: Shorter payloads are always stored in full.
LEAST = 100
#: Compressed bytes that one range request fetches, about.
RANGE = 4 << 20


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record that has the HTTP head but not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one record; the block must be as long as it says."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not what its header says")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return {"fields": fields, "http": {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


@dataclass
class Member:
    name: str
    method: int
    size: int
    header_at: int


class Package:
    """The members of a ZIP file behind any object with ``seek`` and ``read``; nothing is extracted."""

    END, LOCATOR, END64, ENTRY, LOCAL = (struct.Struct(x) for x in ("<4s4H2LH", "<4sLQL", "<4sQ2H2L4Q", "<4s6H3L5H2L", "<4s5H3L2H"))

    def __init__(self, source: io.RawIOBase, size: int):
        self.source = source
        tail = self._range(max(0, size - 65557), min(size, 65557))
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of a central directory")
        *_, count, length, start, _ = self.END.unpack(tail[at : at + 22])
        if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
            _, _, end64, _ = self.LOCATOR.unpack(tail[at - 20 : at])
            mark, *_, count, length, start = self.END64.unpack(self._range(end64, 56))
            if mark != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of a central directory where its locator points")
        self.members = {m.name: m for m in self._entries(self._range(start, length), count)}

    def _range(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _entries(self, directory: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            mark, _, _, flags, method, _, _, _, packed, size, name, extra, comment, _, _, _, header = self.ENTRY.unpack(directory[at : at + 46])
            if mark != b"PK\x01\x02":
                raise ValueError("a broken entry of the central directory")
            label = directory[at + 46 : at + 46 + name].decode("utf-8" if flags & 0x800 else "cp437")
            more, k = directory[at + 46 + name : at + 46 + name + extra], 0
            while k + 4 <= len(more):
                kind, length = struct.unpack_from("<2H", more, k)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", more, k + 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                k += 4 + length
            yield Member(label, method, packed, header)
            at += 46 + name + extra + comment

    def place(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin, and how many they are."""
        m = self.members[name]
        if m.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is compressed by ZIP, so its records have no byte ranges")
        *_, name_size, extra = self.LOCAL.unpack(self._range(m.header_at, 30))
        return m.header_at + 30 + name_size + extra, m.size

    def stored(self, name: str) -> bytes:
        return self._range(*self.place(name))


class _Sink:
    """Only ``write``: makes zipfile write front to back."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        pass


def write_package(out: io.RawIOBase, records: Iterator[tuple[str, bytes]]) -> int:
    """Stream (type, record) pairs into a package; returns how many. It holds one record and the index lines."""
    lines, at = [], 0
    with zipfile.ZipFile(_Sink(out), "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        with package.open(zipfile.ZipInfo(DATA, ZIP_DATE), "w", force_zip64=True) as member:
            for kind, record in records:
                squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
                packed = squeeze.compress(record) + squeeze.flush()
                member.write(packed)
                lines.append(f'{{"offset":{at},"length":{len(packed)},"type":"{kind}"}}\n')
                at += len(packed)
        index = "".join(lines).encode()
        package.writestr(zipfile.ZipInfo(INDEX, ZIP_DATE), index)
        about = {"profile": "data-package", "records": len(lines), "resources": [{"path": DATA, "bytes": at}, {"path": INDEX, "bytes": len(index), "hash": "sha256:" + hashlib.sha256(index).hexdigest()}]}
        package.writestr(zipfile.ZipInfo(ABOUT, ZIP_DATE), json.dumps(about))
    return len(lines)


def write(pages: DataFrame, path: str) -> DataFrame:
    """Write a record for each row of ``page_id``, ``url``, ``html`` below ``path``; returns ``file``, ``bytes``, ``records``.

    Only digests that occur twice or more among payloads of at least 100 bytes are joined back, after an aggregation
    that combines before its shuffle; a payload that a third of the rows share is a skewed join that AQE splits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    planned = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to")).sortWithinPartitions("page_id", "digest")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for b in batches:
            for values in zip(*(c for c in b.columns), strict=True):
                page_id, url, body, digest, refers_to = (v.as_py() for v in values)
                yield "response" if refers_to is None else "revisit", make_record(page_id, url, body, digest, refers_to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_batch = next((b for b in batches if b.num_rows), None)
        if first_batch is None:
            return
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name, made = f"{root}/part-{part:06d}.wacz", f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"

        def everything():
            yield first_batch
            yield from batches

        with fs.open_output_stream(made) as out:
            n = write_package(out, records(everything()))
        fs.move(made, name)
        yield pa.RecordBatch.from_pylist([{"file": name, "bytes": fs.get_file_info(name).size, "records": n}])

    return scratch.keep(planned.mapInArrow(run, "file string, bytes long, records long"), "packages")


def read(spark: SparkSession, packages: DataFrame, path: str, payload: bool = False) -> DataFrame:
    """The records of all packages: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    One step reads each package's directory and index and lists byte ranges of about 4 MB; the next one fetches the
    ranges, in as many tasks as there are shuffle partitions. Digests of stored payloads are computed from what was read
    and must equal the header's. ``payload`` adds the stored payload (null for revisits).
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for b in batches:
            for row in b.to_pylist():
                with fs.open_input_file(row["file"]) as source:
                    package = Package(source, row["bytes"])
                    start, size = package.place(DATA)
                    lines = [json.loads(x) for x in package.stored(INDEX).splitlines()]
                if sum(x["length"] for x in lines) != size:
                    raise ValueError(f"the index of {row['file']} does not cover its archive")
                out, lengths, at, held = [], [], start, 0
                for x in lines:
                    lengths.append(x["length"])
                    held += x["length"]
                    if held >= RANGE:
                        out.append({"file": row["file"], "at": at, "lengths": lengths})
                        at, lengths, held = at + held, [], 0
                if lengths:
                    out.append({"file": row["file"], "at": at, "lengths": lengths})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("at", pa.int64()), ("lengths", pa.list_(pa.int64()))]))

    names = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payload else {})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for b in batches:
            for row in b.to_pylist():
                with fs.open_input_file(row["file"]) as source:
                    source.seek(row["at"])
                    data = source.read(sum(row["lengths"]))
                out, at = [], 0
                for length in row["lengths"]:
                    r = parse_record(zlib.decompress(data[at : at + length], 31))
                    at += length
                    f, kind = r["fields"], r["fields"]["warc-type"]
                    digest, size = f["warc-payload-digest"].removeprefix("sha256:"), int(r["http"]["content-length"])
                    if kind == "response":
                        if hashlib.sha256(r["payload"]).hexdigest() != digest or len(r["payload"]) != size:
                            raise ValueError(f"a payload in {row['file']} is not the one that was written")
                    page, refers = (f.get(k) for k in ("x-page-id", "x-refers-to-page-id"))
                    out.append({"page_id": page and int(page), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers and int(refers), "payload": r["payload"] if kind == "response" else None})
                yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], t) for n, t in names.items()], list(names))

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = packages.select("file", "bytes").repartition(max(1, packages.count())).mapInArrow(ranges, "file string, at long, lengths array<long>")
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payload else "")
    return listed.repartition(spread).mapInArrow(fetch, kinds)


def archive(pages: DataFrame, payload: bool = False) -> DataFrame:
    """Write all pages into packages in the shared folder and return what reading them back gives.

    A null html is an empty payload; a null url has no target field. Rows that repeat the smallest page_id of a payload
    are responses like it; a null page_id is smallest only where no other is. An empty table writes no package. Columns
    other than ``page_id``, ``url`` and ``html`` are ignored.
    """
    spark = pages.sparkSession
    path = scratch.new_dir(spark, "warc")
    return read(spark, write(pages, path), path, payload)


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read from the packages."""
    return archive(table(spark, sf_dir, "pages"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NOT NULL AND p.page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND p.page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
