"""WARC archives and their capture index.

Pages are written as WARC/1.1 records, each a gzip member of its own; a payload of some size
that another record holds is written once, and the other records revisit it. Reading an
archive gives a run of captures, sorted where it was read. The runs are merged outside
memory: each owner task takes a range of (URL key, timestamp) and merges its slices
of all runs with a loser tree, so its output continues that of the task before, and the
captures of a URL stand together in time order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.llm.common import Shelf

#: Payloads from this size on are revisited.
LEAST_REVISIT = 1000
#: An archive file ends with the record that reaches so many bytes, gzipped; captures of an owner task's range.
ARCHIVE_BYTES, CAPTURES_PER_RANGE = 32 << 20, 50_000
CRLF = "\r\n"
GZIP, READ_AT_ONCE = 31, 1 << 16
CAPTURE = ("urlkey string, timestamp string, page_id {id}, record_type string, payload_digest string, "
           "payload_bytes long, refers_to {id}, file string, offset long, length long")


def captured_at(page_id: str = "page_id") -> Column:
    """Pages carry no time of capture; the id stands for seconds after a fixed day."""
    seconds = F.pmod(F.coalesce(F.col(page_id).try_cast("long"), F.lit(0)), F.lit(10 ** 9))
    universal = F.to_utc_timestamp(F.timestamp_seconds(F.lit(1_704_067_200) + seconds), F.current_timezone())
    return F.date_format(universal, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, body, payload_bytes, payload_digest, response_id: the page whose record holds the payload.

    Of records with equal payloads of at least `least` bytes that is the largest page_id.
    Null payloads are empty. Copies are counted on the map side before anything moves.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("body")).withColumns({
        "payload_bytes": F.octet_length("body").cast("long"), "payload_digest": F.sha1("body"),
        "strong": F.sha2("body", 256)})
    holders = (rows.filter(F.col("payload_bytes") >= least).groupBy("strong")
               .agg(F.max("page_id").alias("response_id"), F.count("*").alias("records")).filter("records > 1"))
    return rows.join(holders, "strong", "left").drop("strong", "records")


def records(pages: DataFrame) -> DataFrame:
    """(record): each row's record as text, without the blank lines that end it.

    Line breaks in a URL are percent-encoded. A null page_id or url has no header line. Rows that
    repeat a page_id and hold the payload are responses alike.
    """
    revisit = F.col("response_id").isNotNull() & ~F.col("response_id").eqNullSafe(F.col("page_id"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    named = lambda digest: F.regexp_replace(
        digest, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "<urn:uuid:$1-$2-$3-$4-$5>")
    record_id = lambda id_: named(F.md5(F.concat_ws(":", id_.cast("string"), "payload_digest").cast("binary")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    block = F.concat("http", F.when(revisit, F.lit("")).otherwise(F.col("body")))
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))), line("WARC-Date", captured_at()),
        line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, line("WARC-Refers-To", record_id(F.col("response_id")))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        F.when(revisit, line("X-Refers-To-Page-Id", F.col("response_id").cast("string"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        line("Content-Length", F.octet_length("block").cast("string")))
    return pages.withColumn("http", http).withColumn("block", block).select(
        F.concat(head, F.lit(CRLF * 2), "block").alias("record"))


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return packer.compress(data) + packer.flush()


def _members(archive_bytes: int):
    """Gzip members of records, and the number of the archive of this task that each goes to."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            packed = [member(x.as_py() + b"\r\n\r\n") for x in batch.column("record")]
            begins = before + np.cumsum([0, *map(len, packed)], dtype=np.int64)
            before = int(begins[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(packed, pa.binary()), pa.array(begins[:-1] // archive_bytes)], ["member", "lot"])

    return pack


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages as archive files under `path`, through Spark's writer, so any file system that Spark writes serves.

    Its text format writes the bytes of a string as they are. It wants something between two rows, which is
    an empty gzip member: readers of gzip pass over it. A task begins a file in a new folder `lot=…` after
    `archive_bytes`, so a file has at most that and one record, however large or many the pages are.
    """
    (records(with_revisits(pages, least)).select(F.col("record").cast("binary").alias("record"))
     .mapInArrow(_members(archive_bytes), "member binary, lot long").select(F.col("member").cast("string"), "lot").write
     .option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("ISO-8859-1"))
     .partitionBy("lot").text(path))


def url_key(url: str) -> str:
    """The host turned round, then path and query: com,example)/page?x=1."""
    try:
        parts = urlsplit(url.strip().lower())
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.removeprefix('www.').split('.')))}{port}){parts.path or '/'}{query}"


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and data of the gzip members that hold something."""
    at, view = 0, memoryview(content)
    while at < len(content):
        unpacker, end, data = zlib.decompressobj(GZIP), at, []
        while not unpacker.eof:
            if end >= len(content):
                raise ValueError(f"the record at byte {at} is cut off")
            part = view[end:end + READ_AT_ONCE]
            data.append(unpacker.decompress(part))
            end += len(part)
        end -= len(unpacker.unused_data)
        if any(data):
            yield at, end - at, b"".join(data)
        at = end


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record. Lengths, not separators, rule."""
    def fields(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8", "replace").split(CRLF)[1:]
        return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}

    if not record.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    body = record.index(b"\r\n\r\n") + 4
    warc = fields(record[:body - 4])
    end = body + int(warc["content-length"])
    if record[end:] != b"\r\n\r\n":
        raise ValueError("the record has not the length that it tells")
    payload = record.index(b"\r\n\r\n", body, end) + 4
    return warc, fields(record[body:payload - 4]), record[payload:end]


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The captures in the archives under `path`. Payloads of responses are checked against their digests."""
    schema = CAPTURE.format(id=id_type)
    number = (lambda x: None if x is None else int(x)) if id_type != "string" else (lambda x: x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                for offset, length, record in members(content.as_py()):
                    warc, http, payload = parse(record)
                    digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the payload at byte {offset} of {path} has another digest")
                    rows.append((
                        url_key(warc.get("warc-target-uri", "")), warc["warc-date"], number(warc.get("x-page-id")),
                        kind, digest, int(http["content-length"]), number(warc.get("x-refers-to-page-id")),
                        path.as_py(), offset, length))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * len(types), types)], names)

    id_arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(
        id_type, pa.string())
    types = [pa.string(), pa.string(), id_arrow, pa.string(), pa.string(), pa.int64(), id_arrow, pa.string(),
             pa.int64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


class LoserTree:
    """Merges sorted lists: inner nodes hold the losers of matches, so a new head meets one loser per level."""

    def __init__(self, runs: list[list]):
        self.runs, self.next, k = runs, [0] * len(runs), max(len(runs), 1)
        self.k, self.losers = k, [0] * k
        winner = [0] * (2 * k)
        for node in range(2 * k - 1, 0, -1):
            if node >= k:
                winner[node] = node - k
            else:
                a, b = winner[2 * node], winner[2 * node + 1]
                winner[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.top = winner[1] if k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        """Whether the head of run a comes before that of run b; ended runs come last."""
        if self.next[b] >= len(self.runs[b]):
            return True
        if self.next[a] >= len(self.runs[a]):
            return False
        return (self.runs[a][self.next[a]], a) < (self.runs[b][self.next[b]], b)

    def __iter__(self):
        while self.runs and self.next[self.top] < len(self.runs[self.top]):
            run = self.top
            yield self.runs[run][self.next[run]]
            self.next[run] += 1
            node = (run + self.k) // 2
            while node:
                if self._first(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.top = run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One owner's range: slices of the runs come in any order, each slice in its own order."""
    batches = [b for b in batches if len(b)]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    low = -(1 << 63)
    ids = table.column("page_id").to_pylist()
    ids = [(x is not None, x if x is not None else low) for x in ids]
    heads = list(zip(*(table.column(c).to_pylist() for c in ("urlkey", "timestamp")), ids,
                     table.column("file").to_pylist(), table.column("offset").to_pylist(), range(len(table))))
    runs = []
    for head in heads:
        if runs and runs[-1][-1] <= head:
            runs[-1].append(head)
        else:
            runs.append([head])
    merged = table.take(pa.array([head[-1] for head in LoserTree(runs)]))
    yield from merged.combine_chunks().to_batches()


def capture_index(captures: DataFrame, per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """The captures in the order of URL key, timestamp, page_id over all partitions; null ids come first.

    Ranges are cut on all of these, so the captures of one frequent URL are spread over many owners.
    """
    shelf = Shelf(captures.sparkSession, "capture-index")
    order = ("urlkey", "timestamp", "page_id", "file", "offset")
    runs = shelf.keep(captures.sortWithinPartitions(*order), "runs")
    owners = max(1, -(-runs.count() // per_range))
    return shelf.keep(runs.repartitionByRange(owners, *order).mapInArrow(_merge, captures.schema), "index")


def archive(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write pages as archives in the shared folder, read them back, and give their merged index."""
    path = f"{Shelf(pages.sparkSession, 'warc').path}/archives"
    write_archives(pages, path, least)
    kind = pages.schema["page_id"].dataType.simpleString()
    return capture_index(read_archives(pages.sparkSession, path, kind))
