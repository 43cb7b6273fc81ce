"""WARC archives: writing, normalising monolithic gzip, and reading back by offset.

`write` makes one archive a task as a single gzip stream. `normalise` inflates such a stream once, from
start to end and piece by piece, writes every record as a gzip member of its own, and a sidecar index
with a line for each record: offset, length and record id. `read_back` opens records by those offsets.
Records with equal payloads are stored once: the one with the smallest page id is a response, the
others are revisit records that name it and keep the payload's digest and length.

Cases: a null html is an empty payload; a null url leaves out the target; a null page id counts as
larger than any other and comes back as null; rows with the same page id and payload as the response
are responses too, with its record id; payloads under `least` bytes are always responses; other columns are ignored; an
empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store, _text

LEAST = 0
LEVEL = 3
PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "<urn:page:%s>"
ARCHIVES = "path string, n_records long, n_bytes long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, first_url: str | None = None) -> bytes:
    """One WARC record; a revisit holds the HTTP head alone and names the response's record and target."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", ID % ("" if page is None else page)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Refers-To", ID % first), ("WARC-Profile", PROFILE)]
        if first_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", _uri(first_url)))
    body = head if revisit else head + payload
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def _uri(url: str) -> str:
    return urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]|")


def head(stream) -> tuple[bytes, dict[str, str]] | None:
    """The next record's head as bytes and as fields, or None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("no WARC record where one should start")
    raw, fields = [line], {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a WARC head breaks off")
        raw.append(line)
        k, _, v = line.decode("utf-8", "replace").partition(":")
        fields[k.strip().lower()] = v.strip()
    return b"".join([*raw, b"\r\n"]), fields


def members(source, out) -> Iterator[tuple[int, int, str]]:
    """Copy every record of a gzip stream to `out` as its own member: (offset, length, record id)."""
    offset = 0
    with io.BufferedReader(gzip.GzipFile(fileobj=source), PIECE) as stream:
        while (found := head(stream)) is not None:
            raw, fields = found
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            size = out_write(out, z.compress(raw))
            left = int(fields["content-length"])
            while left:
                piece = stream.read(min(left, PIECE))
                if not piece:
                    raise ValueError("a WARC record breaks off")
                left -= len(piece)
                size += out_write(out, z.compress(piece))
            size += out_write(out, z.compress(b"\r\n\r\n") + z.flush())
            yield offset, size, fields.get("warc-record-id", "")
            offset += size


def out_write(out, piece: bytes) -> int:
    if piece:
        out.write(piece)
    return len(piece)


def with_first(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1), and for repeated payloads the smallest page id and its url as `first` and `first_url`.

    Only digests are grouped, with partial minima before the exchange; payloads that occur once are not
    in the joined table, and a payload that many pages share is a skewed join that Spark splits.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    shared = p.filter(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
    return p.join(shared.filter("n > 1").select("digest", "first", "first_url"), "digest", "left")


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """One monolithic archive a task; returns the table of archives."""

    def run(batches):
        fs, root = _store.files(folder)
        out = stream = None
        n, path = 0, f"{root}/pages-{uuid.uuid4().hex}.warc.gz"
        for rb in _text.slices(batches, "payload", 1 << 23):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(path, compression=None)
                stream = zlib.compressobj(1, zlib.DEFLATED, 31)
            for page, url, payload, digest, first, first_url in zip(*(rb.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first", "first_url")), strict=True):
                bare = base64.b32encode(bytes.fromhex(digest)).decode()
                out_write(out, stream.compress(record(page, url, payload, bare, first, first is not None and page != first, first_url)))
                n += 1
        if out is not None:
            out_write(out, stream.flush())
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])

    return _store.table(with_first(pages, least).select("page_id", "url", "payload", "digest", "first", "first_url").mapInArrow(run, ARCHIVES), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a member for every record and an index beside it (path + ".idx")."""

    def run(batches):
        fs, root = _store.files(folder)
        for rb in batches:
            for path in rb.column("path").to_pylist():
                fs.create_dir(root, recursive=True)
                to, index, n, size = f"{root}/records-{uuid.uuid4().hex}.warc.gz", [], 0, 0
                with fs.open_input_file(path) as source, fs.open_output_stream(to, compression=None) as out, fs.open_output_stream(f"{to}.idx", compression=None) as side:
                    for offset, length, name in members(source, out):
                        index.append(f"{offset} {length} {name}\n")
                        n, size = n + 1, offset + length
                        if len(index) == 4096:
                            side.write("".join(index).encode())
                            index = []
                    side.write("".join(index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])

    return _store.table(_store.spread(archives).mapInArrow(run, ARCHIVES), "records")


def open_record(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The fields and block of the record that the index places there."""
    f.seek(offset)
    stream = io.BytesIO(gzip.decompress(f.read(length)))
    _, fields = head(stream)
    return fields, stream.read(int(fields["content-length"]))


def page_of(name: str) -> int | None:
    n = name.removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def read_back(records: DataFrame, folder: str) -> DataFrame:
    """One row a record from the normalised archives, opened through their indexes."""

    def run(batches):
        fs, _ = _store.files(folder)
        for rb in batches:
            for path in rb.column("path").to_pylist():
                with fs.open_input_stream(f"{path}.idx", compression=None) as side, fs.open_input_file(path) as f:
                    lines, rows = io.TextIOWrapper(io.BufferedReader(side), "utf-8"), []
                    for line in lines:
                        offset, length, name = line.split(" ", 2)
                        fields, block = open_record(f, int(offset), int(length))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"the payload of {name.strip()} in {path} is damaged")
                        rows.append((page_of(name.strip()), size, digest, kind, page_of(fields["warc-refers-to"]) if kind == "revisit" else None))
                        if len(rows) == 8192:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return _store.spread(records).mapInArrow(run, ROWS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write, normalise and read back all pages in new shared folders."""
    folder = _store.shared(pages.sparkSession, "warc")
    return read_back(normalise(write(pages, folder, least), folder), folder)


@_store.query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(_store.read(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST(('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5)) AS INT) >> CAST(15 - i % 4 * 5 AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
