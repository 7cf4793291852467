"""WARC archives: written with an index, read back through it.

Writing: every task writes one archive, a gzip member for each record, and returns a row for each record: offset, length,
URL and digest. Of equal payloads, the row with the smallest id is the response and the others revisit it. Reading
starts at the index: the selected records' byte ranges are sorted by file and offset, ranges that are near become
one read, and each record is parsed and its digest verified.

Files are reached through Arrow's filesystems, so the folder may be any URI that those know. A task that runs again
writes another file; the index names only the files of the tasks that ended.

Payloads are carried by responses only; which rows revisit which is found on ids, URLs and digests. A payload that is on any
number of pages moves once for each task that has it at most.

Defined cases: a null html is an empty payload, a null URL an empty target; a null id comes after all others; of rows equal
in id, URL and payload one is the response and the others revisit it; a very long payload is one record; an empty table gives
no archive; columns besides the three are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch_of, lean, materialize, shared_path, small

#: Ranges with at most GAP bytes between become one read of at most READ bytes; SPAN bytes of a file go to one task.
GAP, READ, SPAN = 64 << 10, 4 << 20, 16 << 20
#: Tasks over which rows of one payload are dealt where the groups are too many to broadcast.
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
LEVEL = 1
INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
INDEX_DDL = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
RECORD_DDL = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> bytes:
    return value.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "replace")


def record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{url}/{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes | None, length: int, digest: str, refers_to: tuple[int | None, str] | None = None) -> bytes:
    """One record, not compressed. A revisit (payload null) holds the HTTP header only, with the length of the full payload, and names the response, of a page and its URL."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload or b"")
    own = f"<urn:uuid:{uuid.uuid4()}>" if refers_to else record_id(page_id, url, digest)
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if refers_to else b"response"),
        b"WARC-Record-ID: " + own.encode(),
        b"WARC-Date: " + DATE.encode(),
        b"WARC-Target-URI: " + _clean(url),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if page_id is not None:
        head.append(b"X-Page-Id: %d" % page_id)
    if refers_to:
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(b"WARC-Refers-To: " + record_id(*refers_to, digest).encode())
        head.append(b"WARC-Refers-To-Target-URI: " + _clean(refers_to[1]))
        head.append(b"WARC-Refers-To-Date: " + DATE.encode())
        if refers_to[0] is not None:
            head.append(b"X-Refers-To-Page-Id: %d" % refers_to[0])
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record that is not compressed."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda lines: {k.decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
    warc = fields(head.split(b"\r\n")[1:])
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http.split(b"\r\n")[1:]), payload


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _typed(source: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, payload (null for revisits), n, sha1, revisit, first_id, first_url of source (page_id, url, payload): a row for each row."""
    hashed = source.select("page_id", "url", "payload", F.length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("k"))
    captures = hashed.where(F.col("n") >= least_bytes).groupBy("k", "page_id", "url").agg(F.count("*").alias("times"))
    # Nulls first would make a null id the smallest.
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "times"))
    groups = captures.groupBy("k").agg(F.sum("times").alias("rows"), first.alias("first")).where("rows > 1")
    groups = materialize(groups.select(F.col("k").alias("__k"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.times").alias("times")), "payload-groups")
    near = small(groups)
    asked = F.col("n") >= least_bytes
    if near is groups:  # a hot payload's rows are dealt over SALTS tasks
        salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        known = hashed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        typed = known.join(salted, (F.col("k") == F.col("__k")) & (F.col("salt") == F.col("__salt")) & asked, "left").drop("salt", "__salt")
    else:
        typed = hashed.join(near, (F.col("k") == F.col("__k")) & asked, "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("url") == F.col("first_url"))
    columns = ["page_id", "url", "payload", "n", "sha1", "revisit", "first_id", "first_url"]
    again = F.col("__k").isNotNull() & ~is_first
    typed = typed.withColumn("payload", F.when(~again, F.col("payload"))).withColumn("revisit", again)
    if groups.where("times > 1").isEmpty():
        return typed.select(columns)
    # Of rows equal in all three, one is the response; the others are told by their number and carry no payload.
    same = F.coalesce(~again & (F.col("times") > 1), F.lit(False))
    one = typed.where(same).groupBy("k", "page_id", "url").agg(F.first("payload").alias("payload"), *[F.first(c).alias(c) for c in ("n", "sha1", "first_id", "first_url", "times")])
    one = materialize(one.withColumn("revisit", F.lit(False)), "one-of-equals")
    more = one.withColumn("payload", F.lit(None).cast("binary")).withColumn("revisit", F.lit(True)).withColumn("nth", F.explode(F.sequence(F.lit(2).cast("long"), F.col("times"))))
    return typed.where(~same).select(columns).union(one.select(columns)).union(more.select(columns))


def write(pages: DataFrame, folder: str, *, least_bytes: int = 0, id_column: str = "page_id") -> DataFrame:
    """Writes a record for each row of pages (id_column, url, html) into archives in folder; returns the index, itself kept in the shared folder."""
    source = pages.select(F.col(id_column).cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), as_bytes("html").alias("payload"))
    typed = _typed(source, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = _filesystem(folder)
        name = f"{path}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            rows: list[list] = [[] for _ in INDEX]
            for page_id, url, payload, n, sha1, again, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    filesystem.create_dir(path, recursive=True)
                    out = filesystem.open_output_stream(name, compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = gzip.compress(record(page_id, url, payload, n, digest, (first_id, first_url) if again else None), LEVEL, mtime=0)
                out.write(member)
                for column, value in zip(rows, (name, offset, len(member), url, digest, page_id, "revisit" if again else "response"), strict=True):
                    column.append(value)
                offset += len(member)
            yield batch_of(INDEX, rows)
        if out is not None:
            out.close()

    return materialize(typed.mapInArrow(lean(run), INDEX_DDL), "warc-index")


def reads(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, ranges) of the reads that cover sorted (offset, length) ranges."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in sorted(ranges):
        if out and offset - out[-1][1] <= gap and max(out[-1][1], offset + length) - out[-1][0] <= most:
            out[-1][2].append((offset, length))
            out[-1] = (out[-1][0], max(out[-1][1], offset + length), out[-1][2])
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that index selects, whatever rows were filtered out of it: RECORD_DDL. A record whose digest is wrong ends the job."""
    selected = index.select("file", "offset", "length", F.floor(F.col("offset") / SPAN).alias("span"))
    tasks = max(1, -(-(selected.agg(F.sum("length")).first()[0] or 0) // SPAN))  # by the bytes to read, not by the size of the index
    spans = selected.repartition(tasks, "file", "span").groupBy("file", "span").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _filesystem(folder)
        for batch in batches:
            for name, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with filesystem.open_input_file(name) as file:
                    for start, end, own in reads([(r["offset"], r["length"]) for r in ranges]):
                        file.seek(start)
                        data = memoryview(file.read(end - start))
                        rows: list[list] = [[] for _ in RECORD]
                        for offset, length in own:
                            warc, http, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                            digest = warc["warc-payload-digest"].removeprefix("sha1:")
                            again = warc["warc-type"] == "revisit"
                            if not again and digest_of(payload) != digest:
                                raise ValueError(f"record at {offset} of {name} does not have its digest")
                            number = lambda k, d=warc: int(d[k]) if k in d else None
                            values = (number("x-page-id"), warc["warc-target-uri"], None if again else payload, int(http["content-length"]), digest, warc["warc-type"], number("x-refers-to-page-id"))
                            for column, value in zip(rows, values, strict=True):
                                column.append(value)
                        yield batch_of(RECORD, rows)

    return spans.select("file", "ranges").mapInArrow(lean(run), RECORD_DDL)


def round_trip(pages: DataFrame, folder: str | None = None, *, least_bytes: int = 0) -> DataFrame:
    folder = folder or shared_path(pages.sparkSession, "warc")
    return read(write(pages, folder, least_bytes=least_bytes), folder)
