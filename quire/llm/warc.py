"""WARC archives: writing records, reading them back, segment reassembly.

Writing.  Every page becomes a record whose block is an HTTP message in
chunked transfer framing.  Blocks over ``segment_bytes`` are cut into a first
segment and continuation records that name it as their origin.  Of pages with
equal payloads of at least ``min_revisit`` bytes one is the response, that with
the largest id; the others are revisits that refer to it.

Reading.  Archives are parsed record by record by their content lengths.
Segments are grouped by origin, ordered by number, checked against the total
length, joined, and the chunked framing is decoded.

Scale.  Payloads never move but for pages that were cut into segments (a
shuffle of those pages' own bytes by origin).  The join that marks revisits
has one row per repeated payload.  An archive file holds at most
``records_per_file`` records of bounded size, so a reading task does too.
Files are written and read with Spark's own sources.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, stash

VERSION = b"WARC/1.1"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 1000
CHUNK_BYTES = 4096
SEGMENT_BYTES = 32_768
RECORDS_PER_FILE = 4096


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in HTTP chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at:at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """The payload of chunked framing; trailers are skipped.  Raises
    ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        eol = body.index(b"\r\n", at)
        n = int(body[at:eol].split(b";")[0].strip(), 16)
        if n == 0:
            return b"".join(out)
        piece = body[eol + 2:eol + 2 + n]
        if len(piece) != n or body[eol + 2 + n:eol + 4 + n] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(piece)
        at = eol + 4 + n


def head(fields: list[tuple[str, str]]) -> bytes:
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def page_records(page_id: object, url: str | None, payload: bytes, digest: str, kind: str, record_id: str,
                 refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The record of a page, or its segments (without the closing blank lines)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = http + (chunked(payload) if kind == "response" else b"")
    common = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", DATE)]
    if page_id is not None:
        common.append(("WARC-Page-ID", str(page_id)))
    if url:
        common.append(("WARC-Target-URI", " ".join(url.split())))
    common += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        common += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers_to}>")]
    if len(block) <= segment_bytes:
        yield head([*common, ("Content-Length", str(len(block)))]) + block
        return
    cuts = list(range(0, len(block), segment_bytes))
    for n, at in enumerate(cuts, 1):
        part = block[at:at + segment_bytes]
        if n == 1:
            fields = [*common, ("WARC-Segment-Number", "1")]
        else:
            own = hashlib.md5(f"{record_id}/{n}".encode()).hexdigest()
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", DATE),
                      ("WARC-Segment-Origin-ID", f"<urn:uuid:{record_id}>"), ("WARC-Segment-Number", str(n))]
            if n == len(cuts):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield head([*fields, ("Content-Length", str(len(part)))]) + part


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased header fields, block) of every record of an archive."""
    at = 0
    while True:
        while data[at:at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        stop = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode()] = v.strip().decode("utf-8", "replace")
        n = int(fields["content-length"])
        block = data[stop + 4:stop + 4 + n]
        if len(block) != n:
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, block
        at = stop + 4 + n


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_revisit: int = MIN_REVISIT, segment_bytes: int = SEGMENT_BYTES,
                   records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the pages as archives below ``path``.

    The payload is the html in UTF-8, empty for null.  Rows that repeat the
    largest id of their payload give one response, the rest are revisits of
    it.  Null ids lose to all others and null urls are left out; an empty
    table writes an empty folder.
    """
    payload = F.coalesce(pages[html_col].cast("binary"), F.lit(b""))
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"),
                        F.sha1(payload).alias("digest"))
    slim = rows.select("page_id", "digest", F.length("payload").alias("n")).where(F.col("n") >= min_revisit)
    # payloads that occur more than once: the largest id, and how many rows have it
    groups = slim.groupBy("digest").agg(F.max(F.struct(F.col("page_id"))).alias("m"), F.count("*").alias("rows")).where("rows > 1")
    groups = groups.select("digest", F.col("m.page_id").alias("top"))
    top = F.col("page_id").eqNullSafe(F.col("top"))
    ties = slim.join(groups, "digest").where(top).groupBy("digest").agg(F.count("*").alias("tops"))
    groups = groups.join(ties, "digest")
    marked = rows.join(broadcast_if_small(groups), "digest", "left")
    if groups.where("tops > 1").limit(1).count():
        one = marked.where((F.col("tops") > 1) & top).withColumn("nth", F.expr("row_number() OVER (PARTITION BY digest ORDER BY url)"))
        marked = marked.where(~F.coalesce((F.col("tops") > 1) & top, F.lit(False))).withColumn("nth", F.lit(1)).unionByName(one)
    else:
        marked = marked.withColumn("nth", F.lit(1))
    # the response of a repeated payload is named by the payload, all other records by chance
    shared = F.concat_ws("-", *[F.substring(F.md5(F.col("digest").cast("binary")), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    response = F.col("tops").isNull() | (top & (F.col("nth") == 1))
    marked = marked.select(
        "page_id", "url", "payload", "digest", F.when(response, "response").otherwise("revisit").alias("kind"),
        F.when(response & F.col("tops").isNotNull(), shared).otherwise(F.expr("uuid()")).alias("record_id"),
        F.when(~response, shared).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for row in zip(*[c for c in b.columns]):
                for r in page_records(*[v.as_py() for v in row], segment_bytes):
                    out.append(r)
                    held += len(r)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # a record ends with two line ends, which is the line separator here
    (marked.mapInArrow(write, "record binary").select(F.col("record").cast("string"))
     .write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(type, record_id, page_id, url, digest, refers_to, payload, error), one
    row per record but for continuations, which join their origin.

    ``error`` tells what is wrong with a record whose segments are missing,
    whose total length differs or whose framing is broken; its payload is
    null.  Repeated copies of a segment count once; a revisit has no payload.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    fields = ("type", "record_id", "origin", "segment", "total", "page_id", "url", "digest", "refers_to")
    names = ("warc-type", "warc-record-id", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length",
             "warc-page-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            cols = [pa.array([h.get(n) for h, _ in rows], pa.string()) for n in names]
            return pa.RecordBatch.from_arrays([*cols, pa.array([x for _, x in rows], pa.binary())], [*fields, "block"])

        for b in batches:
            for data in b.column(0):
                rows, held = [], 0
                for h, block in parse_records(data.as_py()):
                    rows.append((h, block))
                    held += len(block)
                    if held > 1 << 24:
                        yield flush(rows)
                        rows, held = [], 0
                yield flush(rows)

    records = files.mapInArrow(parse, ", ".join(f"{f} string" for f in fields) + ", block binary")
    whole = records.where("segment is null").select(*[f for f in fields if f not in ("origin", "segment", "total")], "block",
                                                    F.lit(None).cast("string").alias("error"))
    number = F.col("segment").cast("long")
    parts = records.where("segment is not null").groupBy(F.coalesce("origin", "record_id").alias("record_id"), number.alias("segment")).agg(
        *[F.max(f).alias(f) for f in ("total", "page_id", "url", "digest", "refers_to")],
        F.max(F.when(F.col("type") != "continuation", F.col("type"))).alias("type"), F.first("block").alias("block"))
    joined = parts.groupBy("record_id").agg(
        *[F.max(f).alias(f) for f in ("type", "total", "page_id", "url", "digest", "refers_to")],
        F.max("segment").alias("segments"), F.count("*").alias("found"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    joined = joined.withColumn("block", block).withColumn(
        "error", F.when(F.col("type").isNull(), "no first segment").when(F.col("segments") != F.col("found"), "segment missing")
        .when(F.col("total").isNull(), "no last segment").when(F.length("block") != F.col("total").cast("long"), "total length differs"))
    records = whole.unionByName(joined.select(*whole.columns))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, errors = [], []
            for kind, data, error in zip(b["type"].to_pylist(), b["block"], b["error"].to_pylist()):
                payload = None
                if error is None and kind != "revisit":
                    try:
                        top, _, body = data.as_py().partition(b"\r\n\r\n")
                        payload = dechunk(body) if b"transfer-encoding: chunked" in top.lower() else body
                    except ValueError as e:
                        error = f"framing: {e}"
                payloads.append(payload)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [b[n] for n in ("type", "record_id", "page_id", "url", "digest", "refers_to")]
                + [pa.array(payloads, pa.binary()), pa.array(errors, pa.string())],
                ["type", "record_id", "page_id", "url", "digest", "refers_to", "payload", "error"])

    return records.mapInArrow(decode, "type string, record_id string, page_id string, url string, digest string, "
                                      "refers_to string, payload binary, error string")


def resolved_pages(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, error)
    of the rows of :func:`read_archives`; a revisit takes size and page of the
    response that it refers to."""
    own = records.select("type", "record_id", F.col("page_id").cast("long").alias("page_id"),
                         F.when(F.col("type") == "revisit", F.regexp_replace("digest", "^sha1:", "")).otherwise(
                             F.sha1("payload")).alias("payload_digest"),
                         F.regexp_replace("digest", "^sha1:", "").alias("said"),
                         F.length("payload").cast("long").alias("n"), "refers_to", "error")
    # a payload must have the digest that its record states
    own = own.withColumn("error", F.coalesce("error", F.when(F.col("payload_digest") != F.col("said"), "digest differs")))
    own = stash(own, "warc-own")  # read three times below; payloads stay where they are
    target = own.where("type = 'response'").join(
        own.where("type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("target_page"), F.col("n").alias("target_n"))
    plain = own.where("type <> 'revisit'").select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"),
                                                  F.lit(None).cast("long").alias("refers_to"), "error")
    revisits = own.where("type = 'revisit'").join(target, "refers_to", "left").select(
        "page_id", F.col("target_n").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"),
        F.col("target_page").alias("refers_to"), "error")
    return plain.unionByName(revisits)
