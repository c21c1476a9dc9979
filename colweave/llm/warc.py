"""WARC archives with an index that is written first and read by byte ranges.

Each task writes one archive below the shared folder, every record its own
gzip member, and hands back one index row for each record: archive, offset,
length, URL and digest. The index is stored before anything is read, and only
it says which bytes count, so an archive left by a lost attempt is never read.
Readers take any selection of index rows, sort them by place and read
neighbouring ranges together.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.llm.common import scratch_path, store

#: Equal payloads of at least so many bytes are written once.
MIN_REVISIT = 100
#: An archive is closed and the next one opened beyond this size.
ARCHIVE_BYTES = 256 << 20
#: Index rows of one archive are read together within spans of this size.
SPAN_BYTES = 32 << 20
#: ... and least, where there is too little for all cores.
LEAST_SPAN = 1 << 20
#: Ranges this close are read together, up to so many bytes.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, archive string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _files(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")  # Hadoop writes file:/x
    return fs.FileSystem.from_uri(path)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}|{digest}'.encode()).hexdigest())}>"


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, revisit: bool, refers_to) -> bytes:
    """One WARC record; a revisit has the headers of the response but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        # white space and control characters would end the field
        fields.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        fields.append(("X-Page-Id", page_id))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-Id", refers_to)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    http, payload = block.split(b"\r\n\r\n", 1)
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, size, refers_to (null: a response).

    Of pages with equal payloads of at least ``min_revisit`` bytes the one with
    the smallest id is the response (all of them, if its rows repeat). Only
    payloads that occur more than once are joined, by digest.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    first = store(
        rows.filter(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null").select("digest", "first"), "first-pages")
    joined = rows.join(first, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", "size", refers.alias("refers_to"))


def write_archives(pages: DataFrame, root: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write one record for every row of ``pages`` (page_id, url, html) and return the stored index.

    Null html is an empty payload; a null URL or id leaves its field out.
    Empty input writes no archive and gives an empty index.
    """
    spark = pages.sparkSession
    root = root or scratch_path(spark, "archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at = None, "", 0
        for b in batches:
            rows = []
            for x in b.to_pylist():
                if out is None:
                    files, folder = _files(root)
                    files.create_dir(folder, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"  # a name of its own for each attempt
                    path, at, out = f"{root}/{name}", 0, files.open_output_stream(f"{folder}/{name}", compression=None)
                revisit = x["refers_to"] is not None
                raw = _member(record(x["page_id"], x["url"], (x["payload"] or "").encode(), x["digest"], x["size"], revisit, x["refers_to"]))
                out.write(raw)
                rows.append((x["page_id"], x["url"], x["digest"], "revisit" if revisit else "response", x["refers_to"], path, at, len(raw)))
                at += len(raw)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield _batch(rows, INDEX)
        if out is not None:
            out.close()

    return store(with_revisits(pages, min_revisit).mapInArrow(write, INDEX), "warc-index")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def ranges(rows: list[dict]) -> Iterator[tuple[int, int, list[dict]]]:
    """(offset, length, rows) of reads that take neighbouring rows of one archive together."""
    held: list[dict] = []
    for x in rows:
        end = held and max(y["offset"] + y["length"] for y in held)
        if held and (x["offset"] - end > GAP_BYTES or x["offset"] + x["length"] - held[0]["offset"] > READ_BYTES):
            yield held[0]["offset"], end - held[0]["offset"], held
            held = []
        held.append(x)
    if held:
        yield held[0]["offset"], max(y["offset"] + y["length"] for y in held) - held[0]["offset"], held


def read_records(index: DataFrame, payload: bool = False) -> DataFrame:
    """The records of a selection of index rows, one row each, checked against their digests.

    Returns page_id, url (as written), record_type, refers_to, payload_bytes
    and payload_digest, both of the full payload, and the payload itself if wanted.
    """
    schema = RECORDS + (", payload string" if payload else "")
    # tasks by bytes: the index itself is small, which says nothing on what its rows stand for
    total = index.agg(F.sum("length")).first()[0] or 0
    size = min(SPAN_BYTES, max(LEAST_SPAN, total // (2 * index.sparkSession.sparkContext.defaultParallelism)))
    span = F.floor(F.col("offset") / size)
    placed = index.select("archive", "offset", "length").repartition(max(1, -(-total // size)), "archive", span)
    placed = placed.sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for b in batches:
            rows, out = b.to_pylist(), []
            cuts = [i for i in range(len(rows)) if not i or rows[i]["archive"] != rows[i - 1]["archive"]] + [len(rows)]
            for i, j in zip(cuts, cuts[1:]):
                if rows[i]["archive"] != name:
                    if source is not None:
                        source.close()
                    name = rows[i]["archive"]
                    files, path = _files(name)
                    source = files.open_input_file(path)
                for start, n, group in ranges(rows[i:j]):
                    raw = memoryview(source.read_at(n, start))
                    for x in group:
                        at = x["offset"] - start
                        out.append(_read(zlib.decompress(raw[at : at + x["length"]], 31), payload))
            yield _batch(out, schema)
        if source is not None:
            source.close()

    return placed.mapInArrow(read, schema)


def _read(raw: bytes, payload: bool) -> tuple:
    fields, http, body = parse(raw)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response":
        size, found = len(body), hashlib.sha256(body).hexdigest()
        if found != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    else:
        size = int(http["Content-Length"])
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    out = (None if page is None else int(page), fields.get("WARC-Target-URI"), kind, None if refers is None else int(refers), size, digest)
    return (*out, body.decode() if kind == "response" else None) if payload else out


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, then read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    return read_records(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
