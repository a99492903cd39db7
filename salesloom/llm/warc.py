"""Operator 8: WARC archives, written index first and read back by byte ranges.

Writing: each task writes one archive of its pages (every record is a gzip
member of its own) and returns per record where it stands: file, offset, length,
URL and digest. These rows are the index, stored before anything is read.
Payloads that occur again become revisit records of the page with the smallest
id; their digests are grouped with a map-side combine, and the join back is
salted, so a payload that a third of the pages share is spread.

Reading: the selected index rows are grouped by file and stretch of bytes and
sorted by offset; ranges that nearly touch are read in one go and cut into
records. Every payload's digest is computed anew and held against its header.

A lost executor repeats its tasks into files of new names; only files of
finished tasks are in the index.

Defined results: a null html is an empty payload; payloads under `LEAST` bytes
are never revisits; rows that share the smallest id of a payload are all
responses; a page without id is never referred to; a null URL is an empty one;
an empty table gives an empty index; extra columns are not used.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.session import scratch_path, stored

LEAST = 100  # bytes of a payload that may be referred to
SALTS = 16
LEVEL = 4  # of gzip
ROLL = 1 << 30  # bytes after which a task begins another archive
GAP = 1 << 16  # bytes between two ranges that are still read together
READ = 1 << 23  # bytes read at once, unless one record is longer
STRETCH = 1 << 23  # bytes of an archive that one group of index rows covers
TASK_BYTES = 1 << 25  # bytes of archives a task reads; less while there are fewer tasks than cores
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the folder's path there."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit leaves the payload out and says its length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=~")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        *([("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to))] if kind == "revisit" else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers of a record, the payload's length, and the payload (empty in a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record: {version[:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return headers, length, payload


def _typed(pages: DataFrame) -> DataFrame:
    """The pages with payload digest, record type, and the page a revisit refers to."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    rows = rows.withColumns({"digest": F.sha2("html", 256), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})
    long = rows.where(F.octet_length("html") >= LEAST)
    again = long.groupBy("digest").agg(F.min("page_id").alias("target"), F.count("*").alias("n")).where("n > 1 and target is not null")
    again = again.select("digest", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.join(again, ["digest", "salt"], "left")
    revisit = F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("page_id")) & (F.octet_length("html") >= LEAST)
    return rows.select(
        "page_id",
        "url",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("target")).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        "html",
    )


def write_archives(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Writes a record per row of (page_id, url, html) into archives under `folder`; gives the stored index."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        sink, name, at = None, "", 0
        try:
            for batch in batches:
                rows = batch.to_pylist()
                places = []
                for r in rows:
                    if sink is None or at >= ROLL:
                        if sink is not None:
                            sink.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        sink = system.open_output_stream(f"{path}/{name}", compression=None)
                    raw = record(r["record_type"], r["page_id"], r["url"], r["html"].encode(), r["payload_digest"], r["refers_to"], date)
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = packer.compress(raw) + packer.flush()
                    sink.write(member)
                    places.append((name, at, len(member)))
                    at += len(member)
                columns = [batch.column(k) for k in range(5)]
                columns += [pa.array([p[k] for p in places], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, INDEX.names)
        finally:
            if sink is not None:
                sink.close()

    index = _typed(pages).mapInArrow(run, INDEX)
    return stored(index, "warc-index")


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the index rows point to; `payloads` keeps their bytes (null in a revisit).

    Tasks are dealt by the bytes of the archives to read: the index rows alone would look small.
    """
    parts = F.floor(F.col("offset") / STRETCH)
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(size // TASK_BYTES, min(size >> 20, index.sparkSession.sparkContext.defaultParallelism)) + 1
    near = index.select("file", "offset", "length").repartition(tasks, "file", parts)
    near = near.sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            for name, begin, end, ranges in coalesced(rows):
                with system.open_input_file(f"{path}/{name}") as source:
                    source.seek(begin)
                    data = memoryview(source.read(end - begin))
                out = [_checked(data[a - begin : a - begin + n], payloads) for a, n in ranges]
                yield pa.RecordBatch.from_pylist(out, RECORD_ARROW)

    return near.mapInArrow(run, RECORD)


RECORD_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def coalesced(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as reads: file, begin, end, and the ranges inside."""
    name, begin, end, ranges = "", 0, 0, []
    for file, offset, length in rows:
        if ranges and (file != name or offset > end + GAP or offset + length - begin > READ):
            yield name, begin, end, ranges
            ranges = []
        if not ranges:
            name, begin, end = file, offset, offset
        ranges.append((offset, length))
        end = max(end, offset + length)
    if ranges:
        yield name, begin, end, ranges


def _checked(member: memoryview, payloads: bool) -> dict:
    headers, length, payload = parsed(zlib.decompress(member, 31))
    said = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != said):
        raise ValueError(f"record {headers['WARC-Record-ID']} does not hold the payload it names")
    return {
        "page_id": int(headers["X-Page-Id"]) if headers["X-Page-Id"] else None,
        "url": unquote(headers["WARC-Target-URI"]),
        "record_type": kind,
        "refers_to": int(headers["X-Refers-To-Page"]) if kind == "revisit" else None,
        "payload_bytes": length,
        "payload_digest": said,
        "payload": payload if payloads and kind == "response" else None,
    }
