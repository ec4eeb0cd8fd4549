"""WARC: archives written and read with Spark's text files, and transactions assembled.

Writing: a page becomes a request, a response (or revisit) and a metadata record;
the first two name each other through WARC-Concurrent-To. All is built from
strings in the JVM and written as gzipped text whose line end is the record end.

Reading: the version line that starts every record serves as line separator, so
files stream through executors record by record, whatever their size; records end
by their Content-Length, and a payload that holds a version line itself is put
together again.

Assembly: records meet under the identifier of their capture (response, revisit
or resource) and one nested row per capture comes out.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, quoted, staged

HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
CAPTURES = ("response", "revisit", "resource")
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "warc_type string, record_id string, concurrent_to array<string>, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
)


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: five hex digits of ten at a time."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    h = F.sha1(data)
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0"), digits, letters) for i in range(4)))


def with_roles(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, first (struct
    of the response's page_id and url; null where the row is the response).

    Of rows with equal payloads of at least `min_revisit_bytes` bytes, those with
    the smallest page_id (null last) are responses, so a repeated row repeats its
    response. One row per digest is aggregated before the join, whose hot keys
    adaptive execution splits."""
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    x = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.octet_length(data).cast("long").alias("payload_bytes"), base32_sha1(data).alias("payload_digest"))
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = pages.select(base32_sha1(data).alias("payload_digest"), key.alias("first")).groupBy("payload_digest").agg(F.min("first").alias("first"))
    own = (F.col("payload_bytes") < min_revisit_bytes) | F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return x.join(first, "payload_digest").withColumn("first", F.when(~own, F.col("first")))


def record_id(kind: Column | str, page_id: Column, url: Column, digest: Column) -> Column:
    none = F.lit("\x00")
    parts = [F.lit(kind) if isinstance(kind, str) else kind, page_id.cast("string"), url, digest]
    return F.concat(F.lit("<urn:sha1:"), base32_sha1(F.concat_ws("\x01", *(F.coalesce(p, none) for p in parts)).cast("binary")), F.lit(">"))


def _record(kind: Column | str, rid: Column, headers: list[tuple[str, Column]], content_type: str, block: Column, date: str) -> Column:
    head = [F.lit(f"{VERSION}\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), rid, F.lit(f"\r\nWARC-Date: {date}")]
    head += [F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")) for name, value in headers]
    return F.concat(*head, F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", pages_per_file: int = 20_000, min_revisit_bytes: int = 0) -> None:
    """WARC 1.1 archives (gzip, a file one member of `pages_per_file` pages at most)
    of pages (page_id, url, html) under path.

    Null html is an empty payload; null urls give no WARC-Target-URI; blanks and
    control characters of a url are escaped. Payloads are written whole, however long;
    repeated rows repeat their records. Other columns, whatever their names, are not
    written. Empty table: archives without records."""
    x = with_roles(pages, min_revisit_bytes)
    page, url, digest, html = F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("html")
    revisit = F.col("first").isNotNull()
    uri = F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")
    rid = record_id("capture", page, url, digest)
    near = ("WARC-Concurrent-To", rid)
    host = F.coalesce(F.regexp_extract(uri, r"://([^/?#]*)", 1), F.lit(""))
    line = F.concat(F.lit("/"), F.coalesce(F.regexp_extract(uri, r"://[^/?#]*/?([^#]*)", 1), F.lit("")))
    http = F.concat(F.lit(HTTP_OK), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    capture = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        rid,
        [
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
            ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", F.when(revisit, record_id("capture", F.col("first.page_id"), F.col("first.url"), digest))),
        ],
        "application/http;msgtype=response",
        F.concat(http, F.when(revisit, F.lit("")).otherwise(html)),
        date,
    )
    request = _record("request", record_id("request", page, url, digest), [("WARC-Target-URI", uri), near], "application/http;msgtype=request", F.concat(F.lit("GET "), line, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")), date)
    facts = F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in (("page_id", page), ("refers_to_page_id", F.col("first.page_id")))))
    metadata = _record("metadata", record_id("metadata", page, url, digest), [("WARC-Target-URI", uri), near], "application/warc-fields", facts, date)
    end = F.lit("\r\n\r\n")
    x.select(F.concat(request, end, capture, end, metadata)).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", pages_per_file).text(path)


def _fields(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def parse_record(text: bytes) -> tuple | None:
    """The record after its version line; None if text ends before its Content-Length.
    A Content-Length that is no number raises ValueError."""
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = _fields(head)
    by = dict(reversed(fields))
    if not re.fullmatch("[0-9]+", by.get("content-length", "0")):
        raise ValueError(f"record {by.get('warc-record-id')}: Content-Length {by['content-length']!r}")
    length = int(by.get("content-length", 0))
    if len(rest) < length:
        return None
    block, kind = rest[:length], by.get("warc-type")
    digest, n, payload, more = by.get("warc-payload-digest", "").partition(":")[2] or None, None, None, []
    if kind in ("response", "revisit") and by.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        more = _fields(http.partition(b"\r\n")[2])
        n = len(payload)
        if kind == "revisit":
            told = dict(more).get("content-length", "")
            n, payload = int(told) if re.fullmatch("[0-9]+", told) else n, None
        else:
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    elif kind == "resource":
        payload, n = block, length
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    elif by.get("content-type", "").startswith("application/warc-fields"):
        more = _fields(block)
    return (kind, by.get("warc-record-id"), [v for k, v in fields if k == "warc-concurrent-to"], by.get("warc-target-uri"), by.get("warc-refers-to"), digest, n, list(dict(reversed(more)).items()), payload)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, version: str = VERSION) -> DataFrame:
    """One row per record (see RECORD). Digest and length of a response's payload
    are taken from its bytes, those of a revisit from its headers. An archive that
    ends within a record raises ValueError."""
    mark = f"{version}\r\n"
    names = [x.strip().split(" ")[0] for x in RECORD.replace("map<string,string>", "map").split(",")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def parse(batches):
        held = None  # a record whose payload went on after a version line
        for batch in batches:
            rows, size = [], 0
            for text in batch.column(0).to_pylist():
                if held is None and not text.strip():
                    continue
                text = text if held is None else held + mark.encode() + text
                row = parse_record(text)
                held = text if row is None else None
                if row:
                    rows.append(row if payloads else (*row[:-1], None))
                    size += len(row[-1] or b"") if payloads else 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)
        if held is not None:
            raise ValueError("an archive ends within a record")

    lines = spark.read.option("lineSep", mark).text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, capture, request, metadata, copies): one row per capture, each
    part a struct of RECORD's columns, null where there is none.

    A request or metadata record belongs to every capture that its concurrent-to
    identifiers name: an equi-join on the identifier. Where some name none, a record
    also belongs to the captures that name it, and one that neither names a capture
    nor is named by one to those of its identifiers' connected component, if they
    have no such part of their own. Several parts of one kind: the one with the
    smallest record_id. `copies` counts records that share the capture's identifier,
    as repeated pages do. Records without an identifier, or without a capture, give no
    row. Empty table: no rows."""
    is_capture = F.coalesce(F.col("warc_type").isin(*CAPTURES), F.lit(False))
    part = F.struct("record_id", *[quoted(c) for c in records.columns if c != "record_id"])
    rows = records.select(F.explode(F.when(is_capture, F.array("record_id")).otherwise(F.array_distinct("concurrent_to"))).alias("key"), part.alias("p"), F.lit(0).alias("far"))
    captures, others = records.where(is_capture & F.col("record_id").isNotNull()), records.where(~is_capture)
    named = captures.select(F.col("record_id").alias("key"), F.explode("concurrent_to").alias("record_id"))
    targets = others.select("record_id", F.explode("concurrent_to").alias("key"))
    ids = captures.select(F.col("record_id").alias("key"))
    if not named.isEmpty() or not targets.join(ids, "key", "left_anti").isEmpty():
        from linkweave.operators.grouping import connected_components

        linked = targets.join(ids, "key", "left_semi").select("record_id").unionAll(named.select("record_id")).distinct()
        strays = others.join(linked, "record_id", "left_anti")
        rows = rows.unionByName(others.join(named, "record_id").select("key", part.alias("p"), F.lit(0).alias("far")))
        edges = records.select(F.col("record_id").alias("src"), F.explode("concurrent_to").alias("dst"))
        labels = connected_components(edges).withColumnRenamed("node", "record_id")
        # Of each kind a component needs only its least stray, whatever the number of both.
        least = strays.join(labels, "record_id").groupBy("component", "warc_type").agg(F.min_by(part, F.col("record_id")).alias("p"))
        rows = rows.unionByName(captures.select("record_id").distinct().join(labels, "record_id").join(least, "component").select(F.col("record_id").alias("key"), "p", F.lit(1).alias("far")))
    kind, is_one = F.col("p.warc_type"), F.coalesce(F.col("p.warc_type").isin(*CAPTURES), F.lit(False))
    of = lambda fits: F.min_by(F.when(fits, F.col("p")), F.when(fits, F.struct("far", "p.record_id")))
    out = rows.where("key is not null").groupBy(F.col("key").alias("capture_id")).agg(
        of(is_one).alias("capture"), of(kind == "request").alias("request"), of(kind == "metadata").alias("metadata"), F.count_if(is_one).alias("copies")
    )
    return out.where("capture is not null")


def captured(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Pages written to archives in the shared folder, read back and assembled: one
    row per page with page_id, payload_bytes, payload_digest, record_type,
    refers_to (page_id), target_uri. Null html is an empty payload; null ids and urls
    stay null; repeated rows stay repeated. Other columns are not read. Empty table:
    no rows."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes=min_revisit_bytes)
    records = staged(read_archives(spark, path, payloads=False).drop("payload"), "warc-records")
    x = assemble(records).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    fact = lambda name: F.try_element_at(F.col("metadata.fields"), F.lit(name)).cast("long")
    return x.select(
        fact("page_id").alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.warc_type").alias("record_type"),
        fact("refers_to_page_id").alias("refers_to"),
        F.col("capture.target_uri").alias("target_uri"),
    )
