"""WARC archives in which repeated payloads are revisits of one response.

Only headers (digest, length, id) are shuffled to find the repeats; the few digests that occur more than
once form a table of their own, and the payloads join it (by broadcast while Spark knows that it is small,
else by a sort-merge join that is split on skew). The archives are written by the tasks into a folder that
all executors see. Each attempt of a task writes files of its own names, and the manifest (a table of what the
tasks that succeeded have written) says which files count: what a lost or repeated attempt left is never read.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhead.llm.common import partitions, written
from gridhead.sources.shared import shared_path

#: Compressed bytes at which a task begins another archive.
ROLL_BYTES = 16 << 20
#: Payloads of fewer bytes are stored again rather than referred to.
MIN_BYTES = 1000
#: Fixed value: the profile of revisits that were found by digest.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

_RECORD = "source_id long, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to_record string"
_HEAD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r?$", re.M)
#: Compressed bytes that are read at once.
_STEP = 1 << 16


def record_uri(source_id: int | None, digest: str) -> str:
    """The record's identifier: a name-based UUID of id and payload, so that a revisit can name its response without a lookup.

    Rows that repeat both id and payload are one record written again.
    """
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'record {source_id} {digest}')}>"


def payload_headers(records: DataFrame) -> DataFrame:
    """Adds `payload_digest` (bare lower-case hex SHA-1) and `payload_bytes` of the binary column `payload` (null: empty)."""
    full = records.withColumn("payload", F.coalesce("payload", F.lit(b"")))
    return full.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))


def repeated_payloads(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """`payload_digest, payload_bytes, response_id` of the payloads that occur more than once; the largest id is the response."""
    groups = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
    return groups.agg(F.max("source_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")


def resolve_revisits(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """`records` (source_id, target_uri, payload) with digest, length and `refers_to` (the response's id; null for responses)."""
    full = payload_headers(records)
    repeats = written(repeated_payloads(full.select("source_id", "payload_digest", "payload_bytes"), min_bytes), "warc-repeats")
    joined = full.join(repeats, ["payload_digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("source_id").eqNullSafe(F.col("response_id")), F.col("response_id"))).drop("response_id")


def _record(source_id, uri, digest, n_bytes, refers_to, payload, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(source_id, digest)}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", uri))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to, digest)}"]
    if source_id is not None:
        lines.append(f"X-Source-Id: {source_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file (a URI or a local path), and its path there."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


class _Archive:
    """One archive of a task's attempt."""

    def __init__(self, folder: str, name: str):
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        self.path, self.size, self.records = f"{folder.rstrip('/')}/{name}", 0, 0
        self.out = fs.open_output_stream(f"{root}/{name}", compression=None)

    def add(self, record: bytes) -> None:
        member = zlib.compressobj(3, zlib.DEFLATED, 31)
        for part in (member.compress(record), member.flush()):
            self.out.write(part)
            self.size += len(part)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.size


def write_archives(resolved: DataFrame, folder: str, date: dt.datetime | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the rows of `resolve_revisits` as gzipped records (one member each) with fresh headers; returns the manifest.

    The manifest (path, records, bytes) lists the files of the attempts that succeeded; only those are the archive.
    """
    stamp = (date or dt.datetime.now(dt.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex[:12]
        names = (f"part-{TaskContext.get().partitionId():06d}-{k:04d}-{attempt}.warc.gz" for k in itertools.count())
        done, archive = [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                archive = archive or _Archive(folder, next(names))
                archive.add(_record(*row, stamp))
                if archive.size >= roll_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist([{"path": p, "records": n, "bytes": s} for p, n, s in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    payload = F.when(F.col("refers_to").isNull(), F.col("payload"))
    rows = resolved.select(F.col("source_id").cast("long"), "target_uri", "payload_digest", "payload_bytes", F.col("refers_to").cast("long"), payload.alias("payload"))
    return written(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def _members(stream) -> Iterator[bytes]:  # noqa: ANN001
    """The gzip members of an archive, one by one: no more than a record is held."""
    rest = b""
    while rest or (rest := stream.read(_STEP)):
        member, parts = zlib.decompressobj(31), []
        while True:
            # input goes in by small steps, as what follows a member is copied
            for at in range(0, len(rest), 8192):
                parts.append(member.decompress(rest[at : at + 8192]))
                if member.eof:
                    rest = member.unused_data + rest[at + 8192 :]
                    break
            if member.eof:
                break
            if not (rest := stream.read(_STEP)):
                raise ValueError("an archive ends inside a record")
        yield b"".join(parts)


def _parsed(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode() for k, v in _HEAD.findall(head)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(v for k, v in _HEAD.findall(http) if k.lower() == b"content-length"))  # a revisit keeps that of the full payload
    kind, digest = fields["warc-type"], base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"{fields['warc-record-id']}: the payload does not match its digest")
    source = fields.get("x-source-id")
    return {"source_id": int(source) if source else None, "record_id": fields["warc-record-id"], "record_type": kind, "target_uri": fields.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": length, "refers_to_record": fields.get("warc-refers-to"), "payload": payload if kind == "response" else None}


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives that the manifest (path) lists, digests and lengths checked; with the payload bytes if asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("source_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to_record", pa.string())]
        schema = pa.schema(kinds + [("payload", pa.binary())] * payloads)
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, place = _opened(path)
                with fs.open_input_stream(place, compression=None) as stream:
                    rows, size = [], 0
                    for record in map(_parsed, _members(stream)):
                        rows.append({k: record[k] for k in schema.names})
                        size += record["payload_bytes"] if payloads else 0
                        if len(rows) == 1000 or size > ROLL_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = manifest.select("path")
    # a file is a task's worth; the manifest itself is small and would be read by few tasks
    return files.repartition(partitions(files), "path").mapInArrow(read, _RECORD + ", payload binary" * payloads)


def join_responses(records: DataFrame) -> DataFrame:
    """Adds `refers_to`: the id of the response that a revisit names (null for responses)."""
    revisits = records.where("record_type = 'revisit'")
    named = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max("source_id").alias("refers_to"))
    found = revisits.join(named, "refers_to_record", "left").select(*records.columns, "refers_to")
    return records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes every row of `pages` (page_id, url, html) to archives in the shared folder, reads them back, and returns a row per record.

    A null html is an empty payload; a null url leaves out the target URI; a very long html is one record like any other.
    Rows with a null page_id are responses unless their payload repeats one that has an id. Rows of one page_id with
    different payloads are records of their own; rows that share page_id and payload are all responses, under one
    record id. Further columns are ignored. An empty table gives an empty result.
    """
    records = pages.select(F.col("page_id").alias("source_id"), F.col("url").alias("target_uri"), F.encode("html", "UTF-8").alias("payload"))
    manifest = write_archives(resolve_revisits(records), shared_path(pages.sparkSession, "warc"))
    # the headers are read once and kept, as they are joined with themselves
    return join_responses(written(read_archives(manifest), "warc-headers"))
