"""Deterministic sharded WARC writer and the reader of its archives.

Records are sorted into ranges of page_id, a shard each. A shard's task writes gzip members (one
per record, so that a file can be read from any record), rolls to the next file once the
compressed size is reached, and gives each file its final name only when it is whole. The list of
files is written by Spark at the end and is what makes them visible: a reader opens listed files
only. Headers, record ids and digests are made from the rows alone, so a task that runs again,
after a lost executor or twice at a time, writes the same bytes under the same name.

Of records with equal payloads the one with the largest page_id is the response; the others are
revisits of it, without a payload. Digests meet in a join of (id, digest) rows; the payloads are
shuffled once, into their ranges, where each revisit's note is sorted ahead of its page.

Cases: a null payload is empty; a null page_id sorts first and is a response only among its like;
rows that repeat page_id and payload are all responses if their page_id is the largest; a null
url is ``urn:page:<page_id>``; control characters in a url are percent-encoded; an empty table
has an empty list of files.

Tasks reach the archive folder by pyarrow's file systems (local or shared folders, S3, HDFS, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm.ranges import range_of

FILE_BYTES = 32 << 20
DATE = "2020-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name space of URLs, RFC 4122
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file string, shard int, records long, bytes long, sha256 string"
ROWS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "url string, payload binary")


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named as Spark names it."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'urn:page:{page_id}:{digest}')}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))]]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = f"WARC/1.1\r\n{''.join(lines)}\r\n".encode()
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """Response or revisit record of a page."""
    digest = _base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url) if url else f"urn:page:{page_id}"), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"),
        ("X-Page-Id", "" if page_id is None else page_id), ("X-Payload-Length", len(payload)),
    ]
    if revisit:
        headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", refers_to)]
    return _record(headers, block)


class _Shard:
    """Files of one shard; each gets its name when it is whole."""

    def __init__(self, uri: str, shard: int, limit: int):
        self.fs, self.folder = open_folder(uri)
        self.shard, self.limit, self.count, self.out = shard, limit, 0, None

    def write(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.count:05d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.sha, self.bytes, self.records = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
            note = f"format: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, self.name)}>"),
                               ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], note))
            self.records = 0
        self._put(data)
        if self.bytes >= self.limit:
            yield from self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> Iterator[tuple]:
        if self.out is None:
            return
        self.out.close()
        target = f"{self.folder}/records/{self.name}"
        there = self.fs.get_file_info(target)
        if there.type == fs.FileType.File and there.size == self.bytes:
            self.fs.delete_file(self.temporary)  # another attempt has written the same bytes
        else:
            self.fs.move(self.temporary, target)
        yield self.name, self.shard, self.records, self.bytes, self.sha.hexdigest()
        self.out, self.count = None, self.count + 1


def _with_originals(pages: DataFrame) -> DataFrame:
    """Pages, and ahead of each revisit (by kind) a note with the response's page_id."""
    thin = pages.select("page_id", "digest")
    groups = thin.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    notes = thin.join(groups, "digest").filter(F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")))
    notes = notes.distinct().select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
                                    "digest", "keep", F.lit(0).alias("kind"))
    return pages.withColumn("keep", F.lit(None).cast("long")).withColumn("kind", F.lit(1)).unionByName(notes)


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                  file_bytes: int = FILE_BYTES, shards: int | None = None) -> str:
    """Write every page into WARC files below ``folder`` and commit their list; the list's path.

    ``shards`` ranges of page_id at most (else as many as shuffle partitions)."""
    spark = pages.sparkSession
    target, path = open_folder(folder)
    for part in ("_temporary", "records"):
        target.create_dir(f"{path}/{part}", recursive=True)
    payload = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    parts = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = range_of(_with_originals(rows), "page_id", parts, bounds_of=rows)
    dealt = dealt.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "page_id", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "shard", "records", "bytes", "sha256"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

        def listed(files: list[tuple]) -> Iterator[pa.RecordBatch]:
            if files:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*files), kinds)], names=names)

        shard, note, files = None, None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("bucket", "page_id", "url", "payload", "digest", "keep", "kind")]
            for row in zip(*columns):  # one payload at a time
                bucket, pid, link, data, digest, keep, kind = (x.as_py() for x in row)
                if shard is None or shard.shard != bucket:
                    files += shard.close() if shard else []
                    shard = _Shard(folder, bucket, file_bytes)
                if kind == 0:
                    note = (pid, digest, keep)
                    continue
                revisit = note is not None and note[:2] == (pid, digest)
                files += shard.write(page_record(pid, link, data, note[2] if revisit else None, revisit))
        files += shard.close() if shard else []
        yield from listed(files)

    manifest = f"{folder}/manifest"
    dealt.mapInArrow(write, FILES).write.parquet(manifest)
    return manifest


def records_of(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file, one gzip member after the other."""
    unpacker, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            record = b"".join(parts)
            head, _, rest = record.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]}")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            yield headers, rest[:int(headers["Content-Length"])]
            unpacker, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the file ends within a record")


def _check(headers: dict[str, str], block: bytes, payload: bytes | None) -> None:
    for name, data in (("WARC-Block-Digest", block), ("WARC-Payload-Digest", payload)):
        if data is not None and headers[name] != f"sha1:{_base32(hashlib.sha1(data).digest())}":
            raise ValueError(f"{name} of {headers['WARC-Record-ID']} does not match")


def read_archive(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row per page record of the committed files; all digests are checked.

    Each file is read as a stream, record by record. A revisit has no payload; its length and
    digest are those of the full payload."""
    files = spark.read.schema(FILES).parquet(f"{folder}/manifest").select("file")
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def number(value: str | None) -> int | None:
        return int(value) if value else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                source, path = open_folder(folder)
                rows, size = [], 0
                with source.open_input_stream(f"{path}/records/{name}", compression=None) as stream:
                    for headers, block in records_of(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                        _check(headers, block, payload)
                        rows.append((number(headers["X-Page-Id"]), int(headers["X-Payload-Length"]),
                                     headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"],
                                     number(headers.get("X-Refers-To-Page-Id")), headers["WARC-Target-URI"], payload if with_payload else None))
                        size += len(block) * with_payload + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(read, ROWS)
