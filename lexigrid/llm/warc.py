"""WARC records as rows, and the assembly of a capture from its records.

``write_records`` and ``read_records`` are a sink and a source for WARC/1.1
files, plain or gzip (whole files or one member a record).  Files are read as
streams in the workers, one record in memory at a time.  ``assemble`` joins
request, response and metadata records through their concurrent-to
identifiers and gives one nested row for each capture.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCHEMA = "record_id string, type string, concurrent_to array<string>, target_uri string, date string, content_type string, payload binary, truncated boolean"
_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("payload", pa.binary()), ("truncated", pa.bool_())])
END = "\r\n\r\n"
#: Bytes of payloads that a worker gathers into one Arrow batch, and bytes of one read.
BATCH_BYTES, READ_BYTES = 8 << 20, 1 << 20


def _line(name: str, value: Column) -> Column:
    # A header's value has no line break; null values give no line.
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def record_text(record_id: Column, type_: Column, payload: Column, concurrent_to: Column, target_uri: Column, date: Column, content_type: Column) -> Column:
    """One WARC record, without the two line ends behind it, as a string Column."""
    body = F.coalesce(payload, F.lit(""))
    links = F.array_join(F.transform(F.filter(F.coalesce(concurrent_to, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.concat(F.lit("WARC-Concurrent-To: "), x, F.lit("\r\n"))), "")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", type_),
        _line("WARC-Record-ID", record_id),
        links,
        _line("WARC-Target-URI", target_uri),
        _line("WARC-Date", date),
        _line("Content-Type", content_type),
        F.lit("Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
        body,
    )


def write_records(records: DataFrame, path: str, gzip: bool = False) -> None:
    """Write rows of ``SCHEMA`` as WARC files, one a partition.

    Spark's text sink does it, with the mark that ends a record as its line
    separator, so a lost task leaves no half file.  Payloads are any bytes: a
    cast to a string keeps them as they are, and so does the sink.
    """
    text = record_text(F.col("record_id"), F.col("type"), F.col("payload").cast("string"), F.col("concurrent_to"), F.col("target_uri"), F.col("date"), F.col("content_type"))
    records.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip" if gzip else "none").text(path)


class _Stream:
    """Buffered bytes of a file, unzipped if they are gzip members; what a damaged member holds behind the damage is skipped, up to the next member."""

    def __init__(self, file):
        self.file, self.buf, self.pos, self.over, self.kept = file, b"", 0, False, b""
        head = file.read(2)
        self.unzip = zlib.decompressobj(31) if head == b"\x1f\x8b" else None
        self.feed(head)

    def feed(self, raw: bytes) -> None:
        if self.unzip is not None:
            out, raw, self.kept = [], self.kept + raw, b""
            while raw:
                try:
                    out.append(self.unzip.decompress(raw))
                    raw = self.unzip.unused_data
                    if self.unzip.eof:
                        self.unzip = zlib.decompressobj(31)
                        raw = raw.lstrip(b"\0")
                except zlib.error:
                    self.unzip = zlib.decompressobj(31)
                    at = raw.find(_MEMBER, 1)
                    raw, self.kept = (raw[at:], b"") if at > 0 else (b"", raw[-2:] if raw[-2:] in (_MEMBER[:2], b"\0" + _MEMBER[:1]) else b"")
            raw = b"".join(out)
        self.buf = self.buf[self.pos :] + raw
        self.pos = 0

    def more(self) -> bool:
        raw = self.file.read(READ_BYTES)
        self.over = not raw
        if raw:
            self.feed(raw)
        return bool(raw)

    def skip(self, mark: bytes) -> bool:
        """Go on behind the next mark; what is before it isn't kept."""
        while (i := self.buf.find(mark, self.pos)) < 0:
            self.pos = max(self.pos, len(self.buf) - len(mark) + 1)
            if not self.more():
                return False
        self.pos = i + len(mark)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (i := self.buf.find(mark, self.pos + max(0, seen - len(mark)))) < 0:
            seen = len(self.buf) - self.pos
            if not self.more():
                return None
        out = self.buf[self.pos : i]
        self.pos = i + len(mark)
        return out

    def exactly(self, n: int) -> bytes:
        if len(self.buf) - self.pos < n:
            parts, have = [self.buf[self.pos :]], len(self.buf) - self.pos
            self.buf, self.pos = b"", 0
            while have < n and self.more():
                parts.append(self.buf)
                have += len(self.buf)
                self.buf = b""
            self.buf, self.pos = b"".join(parts), 0
        out = self.buf[self.pos : self.pos + n]
        self.pos += len(out)
        return out


_LINE = re.compile(rb"\r?\n(?![ \t])")
#: How a gzip member begins.
_MEMBER = b"\x1f\x8b\x08"


def parse(file):
    """Yield ``SCHEMA``'s fields of each record of a binary file; a payload shorter than its Content-Length is marked truncated, bytes between records are skipped, and so is a file that has none."""
    s = _Stream(file)
    while True:
        if not s.skip(b"WARC/1."):
            return
        head = s.until(END.encode())
        if head is None:
            return
        fields: dict[str, list[str]] = {}
        for line in _LINE.split(head)[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        one = lambda k: fields.get(k, [None])[0]
        length = one("content-length")
        n = int(length) if length and length.isdigit() else 0
        body = s.exactly(n)
        yield one("warc-record-id"), one("warc-type"), fields.get("warc-concurrent-to", []), one("warc-target-uri"), one("warc-date"), one("content-type"), body, len(body) < n


def _batches(rows):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[6] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)


def read_records(spark: SparkSession, path: str, tasks: int | None = None, types: tuple[str, ...] | None = None, payloads: bool = True) -> DataFrame:
    """The records of the WARC files under ``path`` as rows of ``SCHEMA``; files are spread over tasks and streamed there.

    ``types``: only records of these.  Without ``payloads`` these are null, and
    what leaves a worker is the headers' fields.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path")
    n = tasks or max(1, files.count())

    def wanted(records):
        for r in records:
            if types is None or r[1] in types:
                yield r if payloads else (*r[:6], None, r[7])

    def run(batches):
        from urllib.parse import unquote

        from pyarrow import fs

        for b in batches:
            for uri in b.column(0).to_pylist():
                if uri.startswith("file:"):
                    system, at = fs.LocalFileSystem(), unquote(re.sub("^file:/+", "/", uri))
                else:
                    system, at = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
                with system.open_input_stream(at, compression=None) as f:
                    yield from _batches(wanted(parse(f)))

    # One file a task: dealt in turn, not by a hash, which would leave tasks without a file.
    return files.repartition(n).mapInArrow(run, SCHEMA)


def assemble_files(spark: SparkSession, path: str) -> DataFrame:
    """``assemble`` of the records under ``path``; files are read and unzipped once, to a table of which each later step reads the columns it needs."""
    return assemble(C.materialize(read_records(spark, path), "warc-records", codec="zstd"))


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: ``(capture_id, target_uri, date, response, requests, metadata)``.

    A capture is a response record with a record id.  A request or metadata
    record belongs to it if either names the other as concurrent; metadata may
    also name, or be named by, a request that belongs to it.  ``response`` is
    ``struct<record_id, content_type, payload, truncated>``, the other two are
    arrays of such structs in the order of their record ids and then payloads;
    they are empty where nothing belongs.  Repeated rows count once; of several
    responses with one id the first by payload is taken.  Records without an
    id, of another type, or of no capture don't appear.  A record that belongs
    to several captures appears in each.  Columns beside ``SCHEMA``'s aren't
    read; an empty table has no captures.
    """
    rows = records.select(*_ARROW.names)
    return _assembled(rows, rows.where("type = 'response'"), rows.where("type in ('request', 'metadata')"))


def _assembled(headers: DataFrame, responses: DataFrame, others: DataFrame) -> DataFrame:
    body = F.struct("record_id", "content_type", "payload", "truncated")
    # Ids only, written once: all linking reads these.
    rows = C.materialize(headers.where("record_id is not null and type in ('request', 'response', 'metadata')").groupBy("record_id", "type", "concurrent_to").agg(F.count(F.lit(1)).alias("n")), "warc-links")
    links = rows.where("size(concurrent_to) > 0").select("record_id", "type", F.explode("concurrent_to").alias("other")).where("other is not null")
    # Undirected links, each end with its type.
    ends = links.join(rows.select(F.col("record_id").alias("other"), F.col("type").alias("other_type")).distinct(), "other")
    both = ends.select(F.col("record_id").alias("a"), F.col("type").alias("ta"), F.col("other").alias("b"), F.col("other_type").alias("tb"))
    both = C.materialize(both.unionByName(both.selectExpr("b as a", "tb as ta", "a as b", "ta as tb")).distinct(), "warc-ends")
    direct = both.where("ta <> 'response' and tb = 'response'").selectExpr("a as record_id", "ta as type", "b as capture_id")
    hop = both.where("ta = 'metadata' and tb = 'request'").selectExpr("a as record_id", "b as via")
    far = hop.join(direct.where("type = 'request'").selectExpr("record_id as via", "capture_id"), "via").select("record_id", "capture_id")
    member = C.materialize(direct.select("record_id", "capture_id").unionByName(far).distinct(), "warc-members")
    # What Spark takes for the size of rows out of a Python source says nothing, so it mustn't choose to broadcast them.
    parts = others.where("record_id is not null").hint("merge").join(member.hint("merge"), "record_id").groupBy("capture_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("type") == "request", body))).alias("requests"), F.array_sort(F.collect_set(F.when(F.col("type") == "metadata", body))).alias("metadata")
    )
    heads = responses.where("record_id is not null").select(F.col("record_id").alias("capture_id"), "target_uri", "date", body.alias("response"))
    again = C.materialize(rows.where("type = 'response'").groupBy(F.col("record_id").alias("capture_id")).agg(F.sum("n").alias("n")).where("n > 1").select("capture_id"), "warc-repeated")
    if not again.isEmpty():
        # Only responses whose id occurs again are ordered, so payloads aren't sorted for the others' sake.
        w = F.row_number().over(_by("capture_id", F.col("response.payload"), F.col("target_uri"), F.col("date"), F.col("response.content_type")))
        one = C.only(heads, again, "capture_id", 96).withColumn("n", w).where("n = 1").drop("n")
        heads = C.without(heads, again, "capture_id", 96).unionByName(one)
    none = F.array().cast(parts.schema["requests"].dataType)
    return heads.hint("merge").join(parts.hint("merge"), "capture_id", "left").select("capture_id", "target_uri", "date", "response", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))


def _by(key: str, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Request, response and metadata records of crawled pages.

    Record ids are derived from the page's id.  The request names its response
    as concurrent, the metadata record the request.  A null url gives no
    target; a null html an empty body.
    """
    key = F.col(id_col).cast("string")
    urn = lambda kind: F.concat(F.lit(f"<urn:page:{kind}:"), key, F.lit(">"))
    url = F.col(url_col)
    path = F.coalesce(F.regexp_extract(url, r"^[a-z]+://[^/]+(/.*)?$", 1), F.lit(""))
    host = F.coalesce(F.regexp_extract(url, r"^[a-z]+://([^/]+)", 1), F.lit(""))
    ask = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    html = F.coalesce(F.col(html_col), F.lit(""))
    got = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(END), html)
    told = F.concat(F.lit("page: "), key, F.lit("\r\n"))
    none = F.array().cast("array<string>")

    def one(kind: str, content: str, payload: Column, links: Column) -> Column:
        return F.struct(
            urn(kind).alias("record_id"), F.lit(kind).alias("type"), links.alias("concurrent_to"), url.alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.lit(content).alias("content_type"), F.encode(payload, "UTF-8").alias("payload"), F.lit(False).alias("truncated")
        )

    three = F.array(
        one("request", "application/http; msgtype=request", ask, F.array(urn("response"))), one("response", "application/http; msgtype=response", got, none), one("metadata", "application/warc-fields", told, F.array(urn("request")))
    )
    return pages.where(F.col(id_col).isNotNull()).select(F.explode(three).alias("r")).select("r.*")
