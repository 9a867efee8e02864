"""WARC archives: whole-file gzip streams rewritten as one member per record, with a sidecar of offsets.

`write_archives` puts a record per page into archives that are one gzip stream each, as crawlers write them that
compress whole files. `normalise` inflates such a stream once, copies every record into a gzip member of its own and
writes the sidecar: a line per record with offset, length, type, id and payload digest. `read_records` seeks to the
offsets of the sidecars and inflates single members; it needs no stream from the start.

Archives are files under the shared checkpoint folder, or any folder that pyarrow's file systems reach from every
executor. A task writes under a name of its own attempt and moves the file to its final name when it is complete; the
manifest, a Parquet table, names the files of the attempts that succeeded. Repeated or lost tasks leave files behind that
no manifest names. Streams pass through the tasks in chunks of a MB, so an archive or a record may exceed the memory.

Of pages with equal payloads of at least `SMALLEST_REVISIT` bytes the smallest page id is stored as response and the others
as revisit records without payload; shorter payloads are stored every time. A null html is an empty payload. Rows that
repeat the smallest id of their payload are responses too. A null id is larger than any other; where no copy has an id
all are responses. Ids may be null and repeated, record ids repeat with them. Control characters, blanks and
non-ASCII characters of urls are percent-encoded in the archive; a null url has no target header. Other columns of the pages
are left out. No pages give no archives and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_folder, small_batches

#: Payloads below this many bytes are never stored as revisits.
SMALLEST_REVISIT = 100
#: An archive is closed once it holds so many bytes of records.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Payloads with copies that are told to all tasks; beyond, only those of at least a thousandth of all rows are.
TOLD_ROWS = 100_000
HOT_SHARE = 1_000
#: The date of the records: a repeated run writes the same bytes.
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

MANIFEST = "archive string, records long, bytes long"
INDEXED = "archive string, sidecar string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path within it."""
    if "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:", "", path)
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))


class NewFile:
    """A file that has its final name only when it is complete."""

    def __init__(self, path: str):
        self.path = path
        self.system, self.final = file_system(path)
        self.system.create_dir(self.final.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.final}.part"
        self.out = self.system.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.size += len(raw)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.part, self.final)


def attempt_name() -> str:
    """Partition and attempt of the running task: no two attempts share a file."""
    context = TaskContext.get()
    return f"{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex[:12]}"


# Which pages are revisits

def signed_pages(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256))


def with_first_copies(signed: DataFrame, told_rows: int = TOLD_ROWS) -> DataFrame:
    """`signed` with `first`, the smallest id of an equal payload that is long enough for a revisit."""
    long_enough = F.length("payload") >= SMALLEST_REVISIT
    groups = signed.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = cut(groups)
    if groups.count() <= told_rows:
        return signed.join(F.broadcast(groups.select("digest", "first")), "digest", "left")
    # A payload of many rows is told to all tasks, there are at most a thousand; the rows of the others meet by digest.
    hot_from = max(2, -(-signed.select("page_id").count() // HOT_SHARE))
    hot = F.broadcast(groups.where(F.col("n") >= hot_from).select("digest", F.struct("first").alias("hot")))
    alone = F.concat(F.lit("row"), F.xxhash64("page_id", "url").cast("string"))
    keyed = signed.join(hot, "digest", "left").withColumn("met", F.when(F.col("hot").isNull() & long_enough, F.col("digest")).otherwise(alone))
    cold = groups.where(F.col("n") < hot_from).select(F.col("digest").alias("met"), F.col("first").alias("cold"))
    return keyed.join(cold, "met", "left").select("digest", "page_id", "url", "payload", F.coalesce("hot.first", "cold").alias("first"))


def planned_records(pages: DataFrame, told_rows: int = TOLD_ROWS) -> DataFrame:
    """page_id, url, digest, refers_to (null for responses), payload_bytes and payload (null for revisits)."""
    first: Column = F.col("first")
    again = first.isNotNull() & ~first.eqNullSafe(F.col("page_id"))
    return with_first_copies(signed_pages(pages), told_rows).select(
        "page_id", "url", "digest", F.when(again, first).alias("refers_to"), F.length("payload").cast("long").alias("payload_bytes"),
        F.when(~again, F.col("payload")).alias("payload"))


# Records

def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in fields], b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + END + block + END


def page_record(page_id: int | None, url: str | None, digest: str, refers_to: int | None, size: int, payload: bytes | None) -> bytes:
    """One response or revisit record. The stored HTTP header of a revisit keeps the length of the full payload."""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % size + END
    return record_bytes(fields, http + (payload or b""))


def head_fields(head: bytes) -> dict[str, str]:
    """Named fields of a record or HTTP header, names in lower case."""
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


# Archives as whole-file streams

def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages as archives of one gzip stream each; returns the manifest (archive, records, bytes)."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    small_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, number, out, packed, records, held = attempt_name(), 0, None, None, 0, 0

        def closed() -> pa.RecordBatch:
            out.write(packed.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [out.path], "records": [records], "bytes": [out.size]})

        for batch in batches:
            for row in zip(*batch.to_pydict().values(), strict=True):
                if out is None:
                    out, packed = NewFile(f"{folder}/streams/{name}-{number:04d}.warc.gz"), zlib.compressobj(3, wbits=31)
                    info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
                    out.write(packed.compress(record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}-{number:04d}>"),
                                                            ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info)))
                    number, records, held = number + 1, 1, 0
                record = page_record(*row)
                out.write(packed.compress(record))
                records, held = records + 1, held + len(record)
                if held >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    planned_records(pages).mapInArrow(write, MANIFEST).write.parquet(f"{folder}/streams-manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/streams-manifest")


# The normaliser

class Inflated:
    """Bytes of a gzip file, of one stream or of many members, in bounded chunks."""

    def __init__(self, source, name: str):
        self.source, self.name, self.at = source, name, 0
        self.unpack, self.left, self.buffer = zlib.decompressobj(31), b"", bytearray()

    def more(self) -> bool:
        """Adds a chunk to the buffer; False at the end of the file."""
        while True:
            if not self.left:
                self.left = self.source.read(CHUNK)
                if not self.left:
                    if self.unpack is not None and not self.unpack.eof:
                        raise ValueError(f"{self.name}: the gzip stream ends early")
                    return False
            if self.unpack is None:
                self.unpack = zlib.decompressobj(31)
            got = self.unpack.decompress(self.left, CHUNK)
            if self.unpack.eof:
                self.left, self.unpack = self.unpack.unused_data.lstrip(b"\0"), None
            else:
                self.left = self.unpack.unconsumed_tail
            if got:
                self.buffer += got
                return True

    def head(self) -> bytes | None:
        """The next record's header with its closing empty line; None at the end."""
        while True:
            while self.buffer[:2] == b"\r\n":
                del self.buffer[:2]
            end = self.buffer.find(END)
            if end >= 0 and len(self.buffer) > 2:
                out = bytes(self.buffer[:end + 4])
                del self.buffer[:end + 4]
                return out
            if not self.more():
                if self.buffer.strip():
                    raise ValueError(f"{self.name}: the file ends within a record header")
                return None

    def block(self, length: int) -> Iterator[bytes]:
        """The next `length` bytes."""
        while length:
            if not self.buffer and not self.more():
                raise ValueError(f"{self.name}: the file ends within a record")
            out = bytes(self.buffer[:length])
            del self.buffer[:length]
            length -= len(out)
            yield out


def normalise(archives: DataFrame, folder: str | None = None) -> DataFrame:
    """Rewrites every file of column `archive` with one gzip member a record and a sidecar of offsets beside it.

    Returns the manifest (archive, sidecar, records, bytes). Files of several members come out the same way. A file
    that ends early or holds no WARC records ends the job: nothing is left out silently.
    """
    spark = archives.sparkSession
    folder = folder or shared_folder(spark, "warc")

    def rewrite(path: str, name: str) -> tuple[str, str, int, int]:
        system, inner = file_system(path)
        out, lines = NewFile(f"{folder}/records/{name}.warc.gz"), NewFile(f"{folder}/records/{name}.idx")
        records = 0
        with system.open_input_stream(inner, compression=None) as source:
            stream = Inflated(source, path)
            while (head := stream.head()) is not None:
                fields = head_fields(head)
                if not head.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
                    raise ValueError(f"{path}: no WARC record at record {records}")
                offset, packed = out.size, zlib.compressobj(3, wbits=31)
                out.write(packed.compress(head))
                for piece in stream.block(int(fields["content-length"])):
                    out.write(packed.compress(piece))
                out.write(packed.compress(END) + packed.flush())
                words = [fields.get(k, "-").replace(" ", "%20") for k in ("warc-type", "warc-record-id", "warc-payload-digest")]
                lines.write(f"{offset} {out.size - offset} {' '.join(words)}\n".encode())
                records += 1
        out.close()
        lines.close()
        return out.path, lines.path, records, out.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, number = attempt_name(), 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                done = rewrite(path, f"{name}-{number:04d}")
                number += 1
                yield pa.RecordBatch.from_pydict({"archive": [done[0]], "sidecar": [done[1]], "records": [done[2]], "bytes": [done[3]]})

    spread(archives.select("archive")).mapInArrow(run, INDEXED).write.parquet(f"{folder}/records-manifest")
    return spark.read.schema(INDEXED).parquet(f"{folder}/records-manifest")


def spread(manifest: DataFrame) -> DataFrame:
    """The rows of a manifest over tasks of one archive each, as far as 10,000 tasks go."""
    return manifest.repartition(max(1, min(manifest.count(), 10_000)))


def read_index(manifest: DataFrame) -> DataFrame:
    """The sidecar lines: archive, offset, length, record_type, record_id, digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for some in sidecar_lines(sidecar):
                    columns = list(zip(*some, strict=True))
                    yield pa.RecordBatch.from_pydict({
                        "archive": [archive] * len(some), "offset": list(map(int, columns[0])), "length": list(map(int, columns[1])),
                        "record_type": list(columns[2]), "record_id": list(columns[3]), "digest": list(columns[4])})

    return spread(manifest.select("archive", "sidecar")).mapInArrow(run, "archive string, offset long, length long, record_type string, record_id string, digest string")


def sidecar_lines(path: str, rows: int = 1_000) -> Iterator[list[list[str]]]:
    """Words of the lines of a sidecar, so many lines at a time."""
    system, inner = file_system(path)
    with system.open_input_stream(inner, compression=None) as source:
        left, held = b"", []
        while piece := source.read(CHUNK):
            *whole, left = (left + piece).split(b"\n")
            held += [x.decode().split(" ") for x in whole]
            while len(held) >= rows:
                yield held[:rows]
                del held[:rows]
        if held:
            yield held


def read_records(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """Response and revisit records of normalised archives, each inflated from its own offset.

    The digest of a response is taken from the payload read and must agree with the header's; a revisit's digest and payload
    length are those of its headers. With `payload` the bytes of responses come along, null for revisits.
    """
    schema = RECORD + (", payload binary" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    small_batches(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inner = file_system(archive)
                with system.open_input_file(inner) as source:
                    for some in sidecar_lines(sidecar):
                        rows, held = [], 0
                        for offset, length, kind, *_ in some:
                            if kind not in ("response", "revisit"):
                                continue
                            rows.append(parsed(zlib.decompress(source.read_at(int(length), int(offset)), 31), archive))
                            held += len(rows[-1][-1] or b"") if payload else 0
                            if held > ARCHIVE_BYTES // 8:
                                yield as_batch(rows)
                                rows, held = [], 0
                        if rows:
                            yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True))[:len(names)], types, strict=False)], names=names)

    return spread(manifest.select("archive", "sidecar")).mapInArrow(run, schema)


def parsed(record: bytes, archive: str) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload of a record."""
    head, _, rest = record.partition(END)
    fields = head_fields(head)
    block = rest[:int(fields["content-length"])]
    http, _, body = block.partition(END)
    kind, told = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    page_id, url = page_of(fields["warc-record-id"]), fields.get("warc-target-uri")
    if kind == "revisit":
        return page_id, url, int(head_fields(http)["content-length"]), told, kind, page_of(fields.get("warc-refers-to")), None
    digest = hashlib.sha256(body).hexdigest()
    if digest != told:
        raise ValueError(f"{archive}: the payload of {fields['warc-record-id']} differs from its digest")
    return page_id, url, len(body), digest, kind, None, body
