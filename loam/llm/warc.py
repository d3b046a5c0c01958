"""Operator 4, WARC with revisit resolution: headers shuffle by payload digest, revisit records join to original responses, and
deduplicated archives are written with fresh headers and read back.

Of the records whose payloads are equal (same SHA-1 and length) and have at least `min_bytes` bytes, the one with the largest
page_id is written as a response and every other as a revisit that refers to it; smaller ones are all responses.

Defined cases: a null html is an empty payload; a null url is written as an empty target; line breaks in a url become %0D and %0A;
a null page_id sorts below all others; rows with one page_id are a record each (of those that tie as the largest, the one with the
largest url is the response; rows equal in all three columns are one record written twice, and alike); an empty table gives empty archives and no rows; extra columns are
ignored.

An archive is a run of gzip members, one a record, as the format asks for random access; every piece of PIECE_BYTES compressed bytes or
more begins with a warcinfo record, and a file holds PIECES of them at most, so files are bounded in bytes (but for one record beyond).
Spark's own text writer makes the files, so its commit protocol covers lost executors and any file system that Spark reaches serves:
what it writes between rows is the zero byte that ends a gzip member of less than 16 MB (the top byte of its length), which each row
leaves out; a piece whose last member is longer ends with an empty member. Its names end in .txt. The reader takes records by their
Content-Length, never by searching for separators, so payloads may hold anything. A very long payload is one record in one row.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, map_arrow, modest_batches, new_path, small, table, written

MIN_BYTES = 0
#: The date that the query writes, so that its archives are the same whenever it runs.
DATE = "2000-01-01T00:00:00Z"
PIECE_BYTES, PIECES = 4 << 20, 32
#: Repeated digests that are broadcast at most, and the bytes of their names.
BEST_ROWS, BEST_BYTES = 200_000, 32 << 20
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, without padding: 160 bits are 32 digits, four to each five hexadecimal ones."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX, BASE32)


def record_id(key: Column) -> Column:
    """A name that follows from the record alone, so a task that runs again writes the same bytes."""
    h = F.md5(key)
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, rid and a rank that tells equal page_ids apart."""
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    out = out.select("*", F.octet_length("html").cast("long").alias("payload_bytes"), base32_sha1(F.col("html")).alias("payload_digest"))
    key = F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "url", "payload_digest")
    return out.withColumn("rid", record_id(key))


def decided(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """headers with original: null for a response, else the struct (page_id, url, rid) of the response it refers to.

    Only digests, lengths and names take part in the shuffle by digest, and they are reduced before it. What comes back is a row for
    each digest that repeats: broadcast while it is small, so that no html moves, and else joined by hot digests and a shuffle."""
    h = headers(pages)
    who = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), F.col("url").alias("u"), F.col("rid").alias("r"))
    on = ["payload_digest", "payload_bytes"]
    best = written(h.filter(F.col("payload_bytes") >= min_bytes).groupBy(*on).agg(F.max(who).alias("best"), F.count("*").alias("n")).filter("n > 1"), "digests")
    bounded = small(best, BEST_ROWS, F.octet_length("best.u") + 120, BEST_BYTES)
    out = h.join(bounded.drop("n"), on, "left") if bounded is not best else join_hot(h, best, on, "left")
    is_best = F.col("best").isNull() | (F.col("best.r") == F.col("rid"))
    return out.withColumn("original", F.when(~is_best, F.col("best"))).drop("best")


def records(decisions: DataFrame, date: str) -> DataFrame:
    """Each record up to the CR LF CR LF that ends it, inclusive."""
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    more = F.concat(field("WARC-Refers-To", F.concat(F.lit("<"), F.col("original.r"), F.lit(">"))), field("WARC-Refers-To-Target-URI", F.col("original.u")), field("WARC-Refers-To-Date", F.lit(date)), field("WARC-Profile", F.lit(PROFILE)))
    return decisions.select(
        F.concat(
            F.lit(VERSION + END),
            field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            field("WARC-Record-ID", F.concat(F.lit("<"), F.col("rid"), F.lit(">"))),
            field("WARC-Date", F.lit(date)),
            field("WARC-Target-URI", F.col("url")),
            field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            F.when(revisit, more).otherwise(F.lit("")),
            field("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
            field("Content-Type", F.lit("application/http; msgtype=response")),
            field("Content-Length", F.octet_length(block).cast("string")),
            F.lit(END),
            block,
            F.lit(END + END),
        ).alias("record")
    )


def member(data: bytes) -> bytes:
    """A gzip member with nothing in it that changes from run to run."""
    packer = zlib.compressobj(wbits=31)
    return packer.compress(data) + packer.flush()


def information(date: str) -> bytes:
    """The warcinfo record that a piece begins with."""
    about = f"software: loam{END}format: {VERSION[:4]} File Format {VERSION[5:]}{END}".encode()
    name = hashlib.md5(about + date.encode()).hexdigest()
    head = [VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-4{name[13:16]}-8{name[17:20]}-{name[20:]}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(about)}", END]
    return END.join(head).encode() + about + (END + END).encode()


def write(pages: DataFrame, out: str, date: str, min_bytes: int = MIN_BYTES, piece_bytes: int = PIECE_BYTES, pieces: int = PIECES) -> None:
    """Archives, of at most `pieces` pieces of about piece_bytes compressed bytes each, under the folder out; date: of the records."""
    first, empty = member(information(date)), member(b"")

    def run(batches):
        held, size, last = [first], 0, 0

        def piece():
            content = b"".join(held + ([empty] if last >= 1 << 24 else []))
            return pa.RecordBatch.from_pydict({"piece": pa.array([content[:-1]], pa.binary())})

        for batch in batches:
            for record in batch.column("record").cast(pa.binary()).to_pylist():
                held.append(member(record))
                size, last = size + len(held[-1]), len(record)
                if size >= piece_bytes:
                    yield piece()
                    held, size = [first], 0
        if size:
            yield piece()

    modest_batches(pages.sparkSession)
    rows = records(decided(pages, min_bytes), date).mapInArrow(run, "piece binary")
    rows.select(F.col("piece").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", pieces).text(out)


def members(content: bytes):
    """What each gzip member of an archive holds."""
    view, at = memoryview(content), 0
    while at < len(content):
        one, parts = zlib.decompressobj(wbits=31), []
        while not one.eof:
            if at >= len(content):
                raise ValueError("the last member of an archive is cut off")
            step = view[at : at + (1 << 16)]
            parts.append(one.decompress(step))
            at += len(step) - len(one.unused_data)
        yield b"".join(parts)


def parsed(content: bytes):
    """(header fields in lower case, block) of each record."""
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:stop].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        begin = stop + 4
        at = begin + int(fields[b"content-length"]) + 4
        yield fields, content[begin : at - 4]


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, rid and refers_rid of each record, from the archives; digests and sizes of responses come from their payloads."""

    def run(batch: pa.RecordBatch) -> dict:
        cols: dict = {c: [] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "url", "rid", "refers_rid")}
        for content in batch.column("content").to_pylist():
            for f, block in (x for one in members(content) for x in parsed(one)):
                if (kind := f[b"warc-type"].decode()) == "warcinfo":
                    continue
                page = f[b"x-page-id"]
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if kind == "response" and f[b"warc-payload-digest"] != b"sha1:" + digest.encode():
                    raise ValueError(f"the payload of {f[b'warc-record-id'].decode()} does not have its digest")
                cols["page_id"].append(int(page) if page else None)
                cols["payload_bytes"].append(len(payload) if kind == "response" else None)
                cols["payload_digest"].append(digest if kind == "response" else None)
                cols["record_type"].append(kind)
                cols["url"].append(f[b"warc-target-uri"].decode())
                cols["rid"].append(f[b"warc-record-id"].strip(b"<>").decode())
                cols["refers_rid"].append(f[b"warc-refers-to"].strip(b"<>").decode() if kind == "revisit" else None)
        return cols

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return map_arrow(files, run, "page_id long, payload_bytes long, payload_digest string, record_type string, url string, rid string, refers_rid string")


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """read() with each revisit's size, digest and refers_to taken from the response it refers to; a response that very many revisits
    refer to meets them by broadcast."""
    rows = written(read(spark, path), "warc-headers")
    found = rows.filter("record_type = 'revisit'")
    counts = found.groupBy("refers_rid").agg(F.count("*").alias("n"))
    originals = rows.filter("record_type = 'response'").select(F.col("rid").alias("refers_rid"), F.col("page_id").alias("o_page"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest")).dropDuplicates(["refers_rid"])
    out = join_hot(found.drop("payload_bytes", "payload_digest"), written(originals.join(counts, "refers_rid"), "originals"), ["refers_rid"], "left")
    revisits = out.select("page_id", F.col("o_bytes").alias("payload_bytes"), F.col("o_digest").alias("payload_digest"), "record_type", F.col("o_page").alias("refers_to"), "url")
    return rows.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "url").unionByName(revisits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), out, DATE)
    return resolved(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def brute(pages: list[tuple], min_bytes: int = MIN_BYTES) -> dict:
    """page_id -> (payload_bytes, payload_digest, record_type, refers_to) for pages (page_id, url, html) of distinct page_ids."""
    best: dict = {}
    for page_id, _, html in pages:
        if len(payload := (html or "").encode()) >= min_bytes:
            best[payload] = max(best.get(payload, page_id), page_id)
    out = {}
    for page_id, _, html in pages:
        payload = (html or "").encode()
        to = best.get(payload, page_id)
        out[page_id] = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), *(("response", None) if to == page_id else ("revisit", to)))
    return out
