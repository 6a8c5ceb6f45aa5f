"""WARC archives: written from a table of pages, framed again, assembled into captures.

Writing is Spark's text writer: a row holds the request, response (or revisit)
and metadata records of one capture, and the line separator is what ends a
record.  Reading takes the archives as lines that end in CRLF, in the order in
which they stand, and frames records by their stated lengths, one record in
memory at a time.  Captures are assembled by joins through concurrent-to
identifiers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowforge.llm.storage import shared_path, stored

CRLF = "\r\n"
VERSION = "WARC/1.1"
#: fixed value: the profile of a revisit whose payload has the digest of the record that it refers to
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: payloads of fewer bytes are written again and again
REVISIT_BYTES = 100
#: captures that an archive holds at most
FILE_CAPTURES = 50_000
#: characters that end or part a header line
UNSAFE = [chr(c) for c in (*range(33), 127)]
#: bytes of payload that are handed to Spark together
BATCH_BYTES = 8 << 20
CAPTURES = ("response", "revisit", "resource")
RECORD = (
    "file string, number long, type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string,"
    " content_type string, http_line string, http_length long, declared_digest string, payload_bytes long, payload_sha256 string,"
    " fields array<struct<name:string,value:string>>, payload binary"
)


def _uri(url: Column) -> Column:
    safe = url
    for c in UNSAFE:
        safe = F.replace(safe, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), safe).otherwise(url)


def _uuid(*parts: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column, record_id: Column, date: str, uri: Column, block: Column, content_type: str, further: list[tuple[str, Column]]) -> Column:
    """A record without the CRLFs that end it; a further header whose value is null is left out."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        CRLF,
        F.lit(VERSION),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id),
        F.lit(f"WARC-Date: {date}"),
        line("WARC-Target-URI", uri),
        *[line(name, value) for name, value in further],
        F.lit(f"Content-Type: {content_type}"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(CRLF + CRLF), block)


def first_pages(pages: DataFrame, id_col: str, payload: Column) -> DataFrame:
    """of_digest and first: the smallest id of every payload of REVISIT_BYTES or more that several rows hold."""
    own = pages.select(F.col(id_col).alias("id"), F.sha2(payload, 256).alias("of_digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= REVISIT_BYTES)
    return own.groupBy("of_digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("of_digest", "first")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one capture (request, response or revisit, metadata) per row of ``pages`` to gzipped archives in ``path``.

    Payloads are text (written as UTF-8) or binary.  Of the rows with equal
    payloads of REVISIT_BYTES or more those with the smallest id are
    responses and the others revisits of it, without payload.  Null payloads
    are empty; a null id is larger than all others, and rows whose ids are
    all null are responses.  Unsafe characters of urls are percent-encoded; a
    null url leaves the header out.  Rows that are alike in id and payload
    share a record id.  Other columns are ignored, whatever
    their names.

    The ids of repeated payloads are a table of their own; Spark broadcasts
    it if it is small and shuffles payloads only if it is not.
    """
    bytes_of = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    first = stored(first_pages(pages, id_col, bytes_of), "warc-first")
    own = pages.select(F.col(id_col).alias("id"), _uri(F.col(url_col)).alias("uri"), bytes_of.alias("payload"), F.sha2(bytes_of, 256).alias("digest"))
    met = own.join(first, F.col("digest") == F.col("of_digest"), "left").withColumn("alone", F.when(F.col("id").isNull(), F.monotonically_increasing_id().cast("string")))
    n = F.octet_length("payload")
    again = (n >= REVISIT_BYTES) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    named = met.select(
        "uri",
        F.col("id").cast("string").alias("id"),
        "digest",
        F.coalesce(again, F.lit(False)).alias("again"),
        n.cast("string").alias("n"),
        F.when(~F.coalesce(again, F.lit(False)), F.col("payload").cast("string")).otherwise("").alias("payload"),
        F.coalesce("alone", F.lit("")).alias("alone"),
        F.col("first").cast("string").alias("first"),
    )
    ids = [F.coalesce("id", F.lit("")), F.col("digest"), F.coalesce("uri", F.lit("")), F.col("alone")]
    # a revisit knows the id and the digest of its response, so that these make its record id
    capture = F.when(F.col("again"), _uuid(F.lit("revisit"), *ids)).otherwise(_uuid(F.lit("response"), F.coalesce("id", F.lit("")), F.col("digest"), F.col("alone")))
    named = named.withColumn("capture", capture)
    uri, crlf = F.col("uri"), F.lit(CRLF)
    host = F.regexp_extract(F.coalesce("uri", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    place = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("uri", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^#]*)", 1), F.lit("")), F.lit("/"))
    request = F.concat(F.lit("GET "), place, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n"), F.lit(CRLF + CRLF), F.col("payload"))
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("id"), crlf), F.lit("")), F.lit("payload-length: "), F.col("n"), crlf)
    only_again = lambda value: F.when(F.col("again"), value)
    records = [
        _record(F.lit("request"), _uuid(F.lit("request"), *ids), date, uri, request, "application/http; msgtype=request", [("WARC-Concurrent-To", F.col("capture"))]),
        _record(
            F.when(F.col("again"), "revisit").otherwise("response"),
            F.col("capture"),
            date,
            uri,
            answer,
            "application/http; msgtype=response",
            [
                ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
                ("WARC-Profile", only_again(F.lit(PROFILE))),
                ("WARC-Refers-To", only_again(_uuid(F.lit("response"), F.col("first"), F.col("digest"), F.lit("")))),
            ],
        ),
        _record(F.lit("metadata"), _uuid(F.lit("metadata"), *ids), date, uri, fields, "application/warc-fields", [("WARC-Concurrent-To", F.col("capture"))]),
    ]
    text = F.concat_ws(CRLF + CRLF, *records)
    writer = named.select(text.alias("value")).write.mode("append").option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_CAPTURES)
    writer.text(path)


class BrokenArchive(ValueError):
    pass


class _Framer:
    """Records from the lines of archives."""

    def __init__(self, payloads: bool):
        self.payloads = payloads
        self.file, self.mark, self.number = "", None, 0
        self._between()

    def _between(self) -> None:
        self.state, self.head, self.block, self.size, self.length = "between", [], [], -2, 0

    def line(self, mark: int, path: str | None, line: bytes) -> dict | None:
        """The record that ``line`` completes."""
        if mark != self.mark:
            self.end()
            self.mark, self.file, self.number = mark, path or "", 0
        if self.state == "block":
            self.block.append(line)
            self.size += len(line) + 2
            if self.size < self.length:
                return None
            if self.size > self.length:
                raise BrokenArchive(f"{self.file}: a record is longer than its Content-Length")
            return self._made()
        if self.state == "head":
            if not line:
                self._open()
            elif line[:1] in b" \t" and self.head:
                self.head[-1] += b" " + line.strip()
            else:
                self.head.append(line)
        elif line:
            if not line.startswith(b"WARC/"):
                raise BrokenArchive(f"{self.file}: a record should begin with its version; an archive that is not compressed must lie in one split")
            self.file, self.state = path or self.file, "head"
        return None

    def _open(self) -> None:
        self.state, self.fields = "block", []
        for line in self.head:
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                self.fields.append((name.strip().lower(), value.strip()))
        self.of = dict(reversed(self.fields))
        try:
            self.length = int(self.of["content-length"])
        except (KeyError, ValueError):
            raise BrokenArchive(f"{self.file}: a record has no Content-Length") from None

    def _made(self) -> dict:
        whole = CRLF.encode().join(self.block)
        http_line, http_length, payload, named = None, None, whole, []
        kind = self.of.get("content-type", "")
        if kind.startswith("application/http"):
            top, _, payload = whole.partition(b"\r\n\r\n")
            lines = top.decode("utf-8", "replace").split(CRLF)
            http_line = lines[0]
            for name, _, value in (x.partition(":") for x in lines[1:]):
                if name.strip().lower() == "content-length" and value.strip().isdigit():
                    http_length = int(value)
        elif kind.startswith("application/warc-fields"):
            named = [{"name": n.strip(), "value": v.strip()} for n, colon, v in (x.partition(":") for x in whole.decode("utf-8", "replace").splitlines()) if colon]
        made = {
            "file": self.file,
            "number": self.number,
            "type": self.of.get("warc-type"),
            "record_id": self.of.get("warc-record-id"),
            "concurrent_to": [v for n, v in self.fields if n == "warc-concurrent-to"],
            "refers_to": self.of.get("warc-refers-to"),
            "target_uri": self.of.get("warc-target-uri"),
            "date": self.of.get("warc-date"),
            "content_type": kind or None,
            "http_line": http_line,
            "http_length": http_length,
            "declared_digest": self.of.get("warc-payload-digest"),
            "payload_bytes": len(payload),
            "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "fields": named,
            "payload": payload if self.payloads else None,
        }
        self.number += 1
        self._between()
        return made

    def end(self) -> None:
        if self.state != "between":
            raise BrokenArchive(f"{self.file}: ends within a record")


def _schema() -> pa.Schema:
    text, long, texts = pa.string(), pa.int64(), pa.list_(pa.string())
    kinds = {"file": text, "number": long, "type": text, "record_id": text, "concurrent_to": texts, "refers_to": text, "target_uri": text, "date": text}
    kinds |= {"content_type": text, "http_line": text, "http_length": long, "declared_digest": text, "payload_bytes": long, "payload_sha256": text}
    return pa.schema(list((kinds | {"fields": pa.list_(pa.struct([("name", text), ("value", text)])), "payload": pa.binary()}).items()))


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in ``path``, in any mix of types.

    Archives are gzipped, whole or record by record; uncompressed ones must
    not be larger than a split.  Payloads are what follows the headers of an
    HTTP block, or the block itself; ``payload_bytes`` and ``payload_sha256``
    are of what stands there.  With ``payloads=False`` the column ``payload``
    is null.  A record without a length, one that differs from its length and
    an archive that ends within a record are errors, not losses.
    """
    lines = spark.read.option("lineSep", CRLF).text(path)
    place = F.col("_metadata.file_path")
    source = lines.select(F.xxhash64(place).alias("mark"), F.when(F.col("value").startswith("WARC/"), place).alias("path"), F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        framer, schema, made, size = _Framer(payloads), _schema(), [], 0
        for batch in batches:
            for mark, own, line in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                record = framer.line(mark, own, line)
                if record is not None:
                    made.append(record)
                    size += 500 + (record["payload_bytes"] if payloads else 0)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(made, schema=schema)
                        made, size = [], 0
        framer.end()
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return source.mapInArrow(run, RECORD)


def _members(records: DataFrame) -> DataFrame:
    """capture, record: request and metadata records with the captures that they are concurrent to.

    A member names its capture, is named by it, or names another member that
    does either.
    """
    member = records.where(F.col("type").isin("request", "metadata")).select(
        "record_id", "concurrent_to", F.col("type").alias("role"), F.struct("file", "number", "record_id", "date", "http_line", "fields", "payload").alias("record")
    )
    named = member.select(F.explode("concurrent_to").alias("capture"), "role", "record")
    captures = records.where(F.col("type").isin(*CAPTURES))
    backward = captures.select(F.explode("concurrent_to").alias("member"), F.col("record_id").alias("capture")).distinct()
    by_capture = member.join(backward, F.col("record_id") == F.col("member")).select("capture", "role", "record")
    links = member.select(F.col("record_id").alias("via"), F.explode("concurrent_to").alias("beyond")).distinct()
    further = named.join(links, F.col("capture") == F.col("via")).where(F.col("beyond") != F.col("record.record_id")).select(F.col("beyond").alias("capture"), "role", "record")
    via_named = named.withColumnRenamed("capture", "via").join(backward, F.col("via") == F.col("member")).select("capture", "role", "record")
    return named.unionByName(by_capture).unionByName(further).unionByName(via_named)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (the record), requests and metadata (arrays in the order of the archives).

    A capture is a response, revisit or resource record.  Where several share
    a record id, the records concurrent to it are dealt to them in turn, in
    the order in which all stand.  Captures without request or metadata get
    empty arrays; records that belong to no capture are left out.
    """
    in_order = Window.partitionBy("record_id").orderBy("file", "number")
    captures = records.where(F.col("type").isin(*CAPTURES))
    numbered = captures.select(
        "record_id", F.struct(*captures.columns).alias("capture"), (F.row_number().over(in_order) - 1).alias("turn"), F.count("*").over(Window.partitionBy("record_id")).alias("turns")
    )
    place = lambda x: F.struct(x["file"], x["number"])
    compare = lambda x, y: F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0)
    all_members = _members(records)
    members = all_members.groupBy("capture").agg(
        *[F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("role") == role, F.col("record")))), compare).alias(name) for role, name in (("request", "requests"), ("metadata", "metadata"))]
    )
    joined = numbered.join(members.withColumnRenamed("capture", "of"), F.col("record_id") == F.col("of"), "left")
    kind = dict(members.dtypes)
    own = lambda name: F.filter(F.coalesce(F.col(name), F.array().cast(kind[name])), lambda x, i: i % F.col("turns") == F.col("turn"))
    return joined.select("capture", own("requests").alias("requests"), own("metadata").alias("metadata"))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives (in the shared folder unless ``path`` is given), read them back and give one row per capture.

    Columns: the id, payload_bytes, payload_digest (of the full payload, for
    revisits too), record_type, refers_to (for revisits the id of the
    response).  See :func:`write_archives` for nulls and repeated rows; an
    empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col)
    records = stored(read_records(spark, path, payloads=False), "warc-records")
    kind = pages.schema[id_col].dataType
    page = F.get(F.filter(F.flatten(F.transform("metadata", lambda m: m["fields"])), lambda f: f["name"] == "page-id"), F.lit(0))["value"].try_cast(kind)
    again = F.col("capture.type") == "revisit"
    captures = assemble(records).select(
        page.alias("id"),
        F.col("capture.record_id").alias("record_id"),
        F.col("capture.type").alias("record_type"),
        F.col("capture.refers_to").alias("refers_to"),
        # a revisit keeps the headers of the full payload, but not the payload
        F.when(again, F.col("capture.http_length")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(again, F.regexp_replace("capture.declared_digest", "^sha256:", "")).otherwise(F.col("capture.payload_sha256")).alias("payload_digest"),
    )
    captures = stored(captures, "warc-captures")
    responses = captures.where("record_type = 'response'").groupBy("record_id").agg(F.min("id").alias("first"))
    met = captures.join(responses.withColumnRenamed("record_id", "of"), F.col("refers_to") == F.col("of"), "left")
    return met.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("first").alias("refers_to"))


ORACLE = """
WITH own AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
sized AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM own),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM firsts
"""
