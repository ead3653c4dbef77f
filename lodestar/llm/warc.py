"""WARC archives, index first.

Writing gives one index row per record (file, offset, length, URL, digest); reading sorts the index rows
of the selected records by place and joins neighbouring byte ranges into large reads, in tasks of about TASK_BYTES
of archive. Archives are gzip members, one per record, in files of a bounded size in the shared folder; each file
begins with a warcinfo record. They are written and read with pyarrow's file systems, so the folder may be local to
all, or in any store that pyarrow opens.

A response record holds an HTTP message whose entity is the payload; a revisit record holds that message's header and
names the response that it repeats. Record ids are UUIDs of the row's place in the input.

A retried task writes a file of another name, and only the index rows of the task that committed count, so
a lost executor leaves at most an unused file.

Defined results: null html is an empty payload; a null url is written as the empty URL; a null page_id
sorts before every other and is written as no number; rows that repeat a page_id and payload are
records of their own, and all of them are responses if they hold the largest page_id of their payload; an
empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, long_id, materialize, row_keys, ship, table, tasks_for

LEAST_BYTES = 1000  # smaller payloads are never revisits
FILE_BYTES = 64 << 20  # an archive file is closed beyond this size
GAP_BYTES = 64 << 10  # ranges closer than this are read together
SPAN_BYTES = 8 << 20  # and a read is not longer than this, unless a record is
REGION_BYTES = 4 << 20  # records of one file that a reading task takes together start within this many bytes
TASK_BYTES = 64 << 20  # archive bytes of a reading task
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the public name space of URLs

INDEX_SCHEMA = "file string, offset long, length long, url string, digest string, page_id long"
READ_SCHEMA = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record_id(file: str, at: int) -> str:
    """The id of the record of a row of the input."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{file}#{at}')}>"


def _member(head: list[str], block: bytes) -> bytes:
    """One record as a gzip member."""
    raw = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def warcinfo(name: str) -> bytes:
    """The first record of a file."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMES, name)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _member(head, b"software: lodestar\r\nformat: WARC File Format 1.1\r\n")


def record(own_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[str, int] | None) -> bytes:
    """A response, or a revisit of a record (its id and page)."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {own_id}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _member(head, block + payload)
    return _member([*head, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to[0]}", f"X-Refers-To-Page-ID: {refers_to[1]}"], block)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one decompressed record: of an HTTP message, what follows its own header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["Content-Type"].startswith("application/http") else block


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_task(folder: str):
    """(page_id, url, html, file, at, page, file and place of the record referred to) to archive files and their index rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file_system(folder)
        out, name, at = None, "", 0
        for b in batches:
            rows: dict[str, list] = {k: [] for k in ("file", "offset", "length", "url", "digest", "page_id")}
            for page_id, url, html, file, place, page, page_file, page_at in zip(*(b.column(i).to_pylist() for i in range(8))):
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha1(payload).hexdigest()
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    first = warcinfo(name)
                    out.write(first)
                    at = len(first)
                data = record(record_id(file, place), page_id, url, payload, digest, None if page_file is None else (record_id(page_file, page_at), page))
                out.write(data)
                for k, v in zip(rows, (name, at, len(data), url, digest, page_id)):
                    rows[k].append(v)
                at += len(data)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))
        if out is not None:
            out.close()

    return write


def spans(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = SPAN_BYTES) -> Iterator[tuple[int, int, int]]:
    """Sorted (offset, length) ranges coalesced: (first range's number, start, stop) of each read."""
    first = start = stop = None
    for i, (offset, length) in enumerate(ranges):
        if start is not None and offset - stop <= gap and offset + length - start <= most:
            stop = max(stop, offset + length)
            continue
        if start is not None:
            yield first, start, stop
        first, start, stop = i, offset, offset + length
    if start is not None:
        yield first, start, stop


def _read_task(folder: str, payloads: bool):
    """Index rows sorted by (file, offset) to records; one open file at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file_system(folder)
        name, source = None, None
        for b in batches:
            files, ranges = b.column(0).to_pylist(), list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            edges = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if files[lo] != name:
                    if source is not None:
                        source.close()
                    name, source = files[lo], store.open_input_file(f"{base}/{files[lo]}")
                own = ranges[lo:hi]
                reads = list(spans(own))
                for (i, start, stop), after in zip(reads, [*(r[0] for r in reads[1:]), len(own)]):
                    block = source.read_at(stop - start, start)
                    yield _records([zlib.decompress(block[o - start : o - start + n], 31) for o, n in own[i:after]], payloads)
        if source is not None:
            source.close()

    return read


def _records(raw: list[bytes], payloads: bool) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(7)]
    for fields, body in map(parse, raw):
        kind = fields["WARC-Type"]
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size = int(fields["X-Payload-Length"])
        if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != size):
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        values = (_number(fields["X-Page-ID"]), kind, fields["WARC-Target-URI"], size, digest, _number(fields.get("X-Refers-To-Page-ID")), body if payloads else None)
        for column, v in zip(out, values):
            column.append(v)
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages below folder; gives the index. Equal payloads are found on narrow rows, before any page moves."""
    ship(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = row_keys(pages).select(long_id(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), "row_key")
    narrow = rows.select("row_key", "page_id", F.unhex(F.sha1("html")).alias("sha"), F.octet_length("html").alias("size")).where(F.col("size") >= LEAST_BYTES)
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row_key"))
    first = narrow.groupBy("sha", "size").agg(F.max(named).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1 and keep is not null").drop("n")
    again = narrow.join(first, ["sha", "size"]).where(~F.col("page_id").eqNullSafe(F.col("keep.page_id"))).select("row_key", "keep")
    marked = rows.join(materialize(again, "revisits", narrow.count()), "row_key", "left")
    columns = ["page_id", "url", "html", "row_key.file", "row_key.at", F.col("keep.page_id").alias("page"), F.col("keep.row_key.file").alias("page_file"), F.col("keep.row_key.at").alias("page_at")]
    return materialize(marked.select(*columns).mapInArrow(_write_task(folder), INDEX_SCHEMA), "warc-index")


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index rows given, in large sequential reads. How many tasks read follows from the bytes of the records, not of the index."""
    spark = index.sparkSession
    size = index.agg(F.sum("length").alias("size")).collect()[0]["size"] or 0  # one row
    tasks = tasks_for(spark, size, TASK_BYTES, REGION_BYTES)
    placed = index.select("file", "offset", "length").repartition(tasks, "file", F.expr(f"offset div {REGION_BYTES}")).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_read_task(folder, payloads), READ_SCHEMA)


def make_folder(spark, name: str) -> str:
    """A new folder in the shared place, made by Spark's own file system."""
    folder = fresh_path(spark, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def op6_warc(spark, sf_dir) -> DataFrame:
    folder = make_folder(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS keep FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM r
"""
