"""WARC archives: a writer with revisit records, and a salvage reader.

Each task writes its rows to archives of bounded size in a shared folder (one gzip member for each
record) and reports them in a manifest; only files of the manifest count, so a lost or repeated
task leaves nothing behind that is read.  The reader checks every record (member checksum, lengths,
trailer, block and payload digests); after a failed check it searches for the next valid member or
version line, recovers what follows and logs the skipped bytes as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, new_path, partitions

#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 16 << 20
#: Copies of the table of repeated payloads over which one digest's rows spread.
SALTS = 16
ID_PREFIX, END = "urn:x-record:", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
MEMBER, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r?\n")


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, ident, uri: str | None, payload: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record with its payload, or a revisit record with the response's HTTP header only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID_PREFIX}{'' if ident is None else ident}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + block + END


def member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _open(uri: str):
    """The file system and path of a folder or file; a bare path is local."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``refers_to``: of rows with equal payloads of at least ``least_bytes`` the smallest id stays a
    response (null here), the others revisit it.

    Payloads compare by SHA-256 and length.  Rows that repeat the smallest id are responses too; rows with
    a null id revisit the smallest id if there is one.  A digest's rows spread over salts, so a payload that a
    third of the rows share isn't one task's work.
    """
    keyed = pages.withColumn("_key", F.sha2("payload", 256)) \
        .withColumn("_salt", F.pmod(F.xxhash64("id", "uri"), F.lit(SALTS)).cast("int"))
    first = keyed.where(F.length("payload") >= least_bytes).groupBy("_key").agg(
        F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.join(first, ["_key", "_salt"], "left").select(
        "id", "uri", "payload",
        F.when(F.col("id").isNull() | (F.col("id") != F.col("_first")), F.col("_first")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", uri_col: str = "url",
          payload_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row under ``folder`` (a new one in the shared folder if not given).

    Returns the manifest: (path, records, bytes) of each archive.  A null payload is empty; a null uri
    has no target line; other columns are left out; an empty table makes no archive.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    own = pages.select(pages[id_col].alias("id"), pages[uri_col].alias("uri"),
                       F.coalesce(pages[payload_col].cast("binary"), F.lit(b"")).alias("payload"))

    def run(batches):
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        done, out, name, n, size = [], None, "", 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", n, size))
                out = None

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for r in batch.slice(lo, 64).to_pylist():
                    if out is None:
                        name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    raw = member(record("response" if r["refers_to"] is None else "revisit",
                                        r["id"], r["uri"], r["payload"], r["refers_to"]))
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
                    if size >= archive_bytes:
                        close()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return materialize(decide(own, least_bytes).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; ValueError if a check fails."""
    start = VERSION.match(data, at)
    split = data.find(END, at)
    if not start or split < 0:
        raise ValueError("no version line or no end of headers")
    headers: dict[str, str] = {}
    for line in data[start.end():split].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.strip().lower()] = value.strip()
    if missing := MANDATORY - headers.keys():
        raise ValueError(f"no {min(missing)}")
    length = headers["content-length"]
    if not length.isdigit():
        raise ValueError("no length")
    begin = split + len(END)
    end = begin + int(length)
    if data[end:end + len(END)] != END:
        raise ValueError("no trailer")
    block = data[begin:end]
    if headers.get("warc-block-digest", (own := "sha1:" + digest(block))) != own:
        raise ValueError("block digest")
    payload, size = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(END)
        size = next((int(m[1]) for m in [re.search(rb"(?i)content-length:\s*(\d+)", head)] if m), len(payload))
    if headers.get("warc-type") != "revisit" and headers.get("warc-payload-digest", (own := "sha1:" + digest(payload))) != own:
        raise ValueError("payload digest")
    return {"headers": headers, "payload": payload, "payload_bytes": size}, end + len(END)


def _unpack(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at`` and where it ends; ValueError if it isn't whole."""
    d = zlib.decompressobj(31)
    try:
        own = d.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if not d.eof:
        raise ValueError("cut off")
    return own, len(data) - len(d.unused_data)


def _records_at(data: bytes, at: int) -> tuple[list[dict], int]:
    """Valid records that begin at ``at`` (a member's all, or one plain record)."""
    if data.startswith(MEMBER, at):
        # a member is small against an archive: unpack from a window first, so that no copy of the rest is made
        for window in (1 << 18, len(data) - at):
            part = data[at:at + window]
            try:
                own, end = _unpack(part, 0)
                break
            except ValueError as e:
                if str(e) != "cut off" or at + window >= len(data):
                    raise
        found, k = [], 0
        while k < len(own):
            r, k = parse(own, k)
            found.append(r)
        return found, at + end
    r, end = parse(data, at)
    return [r], end


def salvage(data: bytes):
    """("record", offset, length, record) and ("gap", offset, length, reason) over all bytes of an archive, in order."""
    at, n = 0, len(data)
    while at < n:
        try:
            found, end = _records_at(data, at)
        except ValueError as e:
            reason, end = str(e), at + 1
            while end < n:
                a = data.find(MEMBER, end)
                m = VERSION.search(data, end)
                end = min(x for x in (a if a >= 0 else n, m.start() if m else n))
                if end < n:
                    try:
                        _records_at(data, end)
                        break
                    except ValueError:
                        end += 1
            yield "gap", at, min(end, n) - at, reason
        else:
            for r in found:
                yield "record", at, end - at, r
        at = end


SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("uri", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType())])
_NAMES = SCHEMA.fieldNames()


def _ident(value: str | None) -> str | None:
    """The id of a record URI, without the brackets and this library's prefix."""
    return None if value is None else (value.strip("<>").removeprefix(ID_PREFIX) or None)


def _rows(path: str, data: bytes, payloads: bool):
    for kind, at, length, r in salvage(data):
        if kind == "gap":
            yield (path, at, length, kind, r, *[None] * 7)
        else:
            h = r["headers"]
            yield (path, at, length, kind, None, _ident(h.get("warc-record-id")), h.get("warc-type"),
                   h.get("warc-target-uri"), _ident(h.get("warc-refers-to")),
                   (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, r["payload_bytes"],
                   r["payload"] if payloads else None)


_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()),
                    ("reason", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()),
                    ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _batches(rows, size: int = 256):
    block: list[tuple] = []
    for r in rows:
        block.append(r)
        if len(block) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, x)) for x in block], _ARROW)
            block = []
    if block:
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, x)) for x in block], _ARROW)


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (``kind``) of the archives a manifest names.

    A revisit's ``payload_bytes`` and digest are those of the full payload it refers to.  Null paths are left out.
    """
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = _open(path)
                with store.open_input_file(at) as f:
                    data = f.read()
                yield from _batches(_rows(path, data, payloads))

    own = manifest.where("path is not null").select("path")
    return own.repartition(partitions(own.sparkSession), "path").mapInArrow(run, SCHEMA)


def read_files(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The same from a frame of Spark's ``binaryFile`` source (path, content), for archives of others."""
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _batches(_rows(path, data or b"", payloads))

    return files.select("path", "content").mapInArrow(run, SCHEMA)
