"""Operator 8, WARC archives: writing, reading, and reassembly of segmented records.

A page becomes one record whose block is an HTTP response with a chunked body. Of pages with equal payloads, that with
the greatest id is the response and the others are revisits of it, which name the response's target and payload digest.
A record's own id holds the number of its row, so records of rows that share a page id stay apart. A block longer than `segment` bytes is written as a
first segment and continuation records. The archive files come from Spark's text writer with the record's closing blank
lines as its line end, so they land on any file system that Spark knows.

Reading parses each file once, by the records' own lengths and as a stream, and writes what it finds; it groups continuation records by the identifier of
their origin wherever they lie, orders them by segment number, verifies numbers and total length, and then decodes the
chunked framing.

Defined cases: a null payload is empty; payloads may hold any text, also text that looks like a record; a null id counts
as less than any other; rows that repeat an id and a payload are revisits of the greatest, of which all rows with that
id are responses, each written and read as a record of its own, also where the id is null or the payload spans segments; a record whose segments are incomplete comes back with `complete` false and a null payload; an
empty table gives no rows.
"""

from __future__ import annotations

import gzip
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, LEAST_ID, join_with_hot, new_path, number_or_least, remove, written

#: Fixed values of the formats.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
VERSION = "WARC/1.1"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
BATCH_BYTES = 8 << 20


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of binary data in base32: four letters for each five hexadecimal digits."""
    digest, out = F.sha1(payload), []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _bytes(text) -> Column:
    return F.encode(text if isinstance(text, Column) else F.lit(text), "UTF-8")


def _cuts(data: str, size: int) -> str:
    return f"transform(sequence(0L, cast(octet_length({data}) as bigint) - 1, {size}L), at -> substring({data}, cast(at + 1 as int), {size}))"


def plan_records(pages: DataFrame, id_column: str, body_column: str, least_bytes: int = 0) -> tuple[DataFrame, list[str]]:
    """id, row, payload, payload_digest, record_type, refers_to, and the tables that this reads: equal payloads of at least `least_bytes` are one response and its revisits.

    Hot payloads, at most HOT_SHARE of them, meet a broadcast of their digests, and their revisits drop the payload
    there and then; the others meet their group by a shuffle in which each row that needs no group has a key of its own.
    """
    payload = F.coalesce(_bytes(F.col(body_column)), F.lit(b""))
    rows = pages.select(number_or_least(F.col(id_column)).alias("id"), payload.alias("payload"))
    marked = rows.select("id", F.unhex(F.sha2("payload", 256)).alias("content"), F.octet_length("payload").alias("bytes"))
    # Below the least size a row is a group of its own: it never revisits.
    wide = marked.where(F.col("bytes") >= least_bytes).select("id", "content")
    groups, path = written(wide.groupBy("content").agg(F.max("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1"), "payload-groups")
    hot = F.col("n") > max(1, pages.count() // HOT_SHARE)
    hot_groups = F.broadcast(groups.where(hot).select("content", F.col("keep_id").alias("hot_keep")))
    cold_groups = groups.where(~hot).select(F.hex("content").alias("key"), F.col("keep_id").alias("cold_keep"))
    whole = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("content", F.when(F.octet_length("payload") >= least_bytes, F.unhex(F.sha2("payload", 256))))
    met = whole.withColumn("payload_digest", base32_sha1(F.col("payload"))).join(hot_groups, "content", "left")
    revisits = F.col("hot_keep").isNotNull() & (F.col("hot_keep") != F.col("id"))
    grouped = F.col("content").isNotNull() & F.col("hot_keep").isNull()
    keyed = met.select("id", "row", F.when(~revisits, F.col("payload")).alias("payload"), "payload_digest", "hot_keep", F.when(grouped, F.hex("content")).otherwise(F.concat(F.lit("row "), F.col("row").cast("string"))).alias("key"))
    found = keyed.join(cold_groups, "key", "left").withColumn("keep_id", F.coalesce("hot_keep", "cold_keep"))
    revisit = F.col("keep_id").isNotNull() & (F.col("keep_id") != F.col("id"))
    return found.select("id", "row", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keep_id")).alias("refers_to")), [path]


def write_warc(records: DataFrame, to: str, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, date: str = "2020-01-01T00:00:00Z") -> None:
    """Writes `plan_records` as gzipped archive files in the new folder `to`."""
    revisit = F.col("record_type") == "revisit"
    chunks = F.when(F.octet_length("payload") > 0, F.expr(_cuts("payload", chunk))).otherwise(F.array().cast("array<binary>"))
    framed = F.transform(chunks, lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit("\r\n"), c.cast("string"), F.lit("\r\n")))
    block = F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), F.array_join(framed, ""), F.lit("0\r\n\r\n"))).cast("binary")
    cut = records.select("id", "row", "payload_digest", "record_type", "refers_to", block.alias("block"))
    cut = cut.select("*", F.octet_length("block").alias("total"), F.posexplode(F.expr(_cuts("block", segment))).alias("at", "piece"))
    parts = F.ceil(F.col("total") / segment)
    target = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    name = lambda n: F.concat(F.lit("<"), target(F.col("id")), F.lit(":"), F.col("row").cast("string"), F.lit(":"), n.cast("string"), F.lit(">"))
    number = F.col("at") + 1

    def line(key: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{key}: "), value.cast("string"), F.lit("\r\n"))
        return text if when is None else F.when(when, text).otherwise("")

    first, segmented = F.col("at") == 0, F.col("total") > segment
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        line("WARC-Record-ID", name(number)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target(F.col("id"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")), first),
        line("WARC-Refers-To-Target-URI", target(F.col("refers_to")), first & revisit),
        line("WARC-Segment-Number", number, segmented),
        line("WARC-Segment-Origin-ID", name(F.lit(1)), segmented & ~first),
        line("WARC-Segment-Total-Length", F.col("total"), segmented & (number == parts)),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("piece")),
        F.lit("\r\n"),
    )
    value = F.concat(_bytes(head), F.col("piece")).cast("string")
    cut.select(value.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 4000).text(to)


RECORD = "record_id string, record_type string, target string, refers_to string, payload_digest string, origin_id string, segment_number int, total_length long, block binary"
_FIELDS = ("warc-record-id", "warc-type", "warc-target-uri", "warc-refers-to-target-uri", "warc-payload-digest", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length")


def _records(stream):
    """Records of one archive, by their own lengths: (headers with lower-case names, block)."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record must start with its version")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            headers[key.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("the archive ends inside a record")
        yield headers, block


def _parse():
    types = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def batch_of(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_buffer()
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2].to_pybytes() == b"\x1f\x8b" else io.BytesIO(raw)
                rows, size = [], 0
                for headers, block in _records(stream):
                    row = [headers.get(f) for f in _FIELDS]
                    row[6], row[7] = (None if x is None else int(x) for x in row[6:])
                    rows.append((*row, block))
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def decode_chunked(body: bytes) -> bytes:
    """The payload of a chunked body: size lines in hexadecimal, extensions after `;`, trailers after the last chunk."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if len(body) < end + 2 + size:
            raise ValueError("a chunk is cut short")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _payload(block: bytes | None) -> bytes | None:
    if block is None:
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    return decode_chunked(body) if body else b""


def _decode(batches):
    for batch in batches:
        payload = pa.array([_payload(b.as_py()) for b in batch.column("block")], pa.binary())
        names = [n for n in batch.schema.names if n != "block"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), payload], names=[*names, "payload"])


def read_warc(spark: SparkSession, at: str) -> DataFrame:
    """record_id, record_type, target, refers_to (a target), payload_digest, complete, payload of each record of the archives in `at`, segments put together."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).select("content")
    parsed, _ = written(files.mapInArrow(_parse(), RECORD), "warc-parsed")
    single = parsed.where("segment_number IS NULL").select("record_id", "record_type", "target", "refers_to", "payload_digest", F.lit(True).alias("complete"), "block")
    segments = parsed.where("segment_number IS NOT NULL").withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = F.col("segment_number") == 1
    kept = [F.max(F.when(first, F.col(c))).alias(c) for c in ("record_type", "target", "refers_to", "payload_digest")]
    pieces = F.array_sort(F.collect_list(F.struct("segment_number", "block"))).alias("pieces")
    grouped = segments.groupBy("origin").agg(*kept, F.max("total_length").alias("total"), pieces)
    block = F.array_join(F.transform("pieces", lambda p: p["block"].cast("string")), "").cast("binary")
    numbered = F.transform("pieces", lambda p: p["segment_number"]) == F.sequence(F.lit(1), F.size("pieces"))
    whole = grouped.select(F.col("origin").alias("record_id"), "record_type", "target", "refers_to", "payload_digest", "total", numbered.alias("numbered"), block.alias("block"))
    complete = F.coalesce(F.col("numbered") & (F.octet_length("block") == F.col("total")), F.lit(False))
    assembled = whole.select("record_id", "record_type", "target", "refers_to", "payload_digest", complete.alias("complete"), F.when(complete, F.col("block")).alias("block"))
    out = "record_id string, record_type string, target string, refers_to string, payload_digest string, complete boolean, payload binary"
    return single.unionByName(assembled).mapInArrow(_decode, out)


def archive(pages: DataFrame, to: str | None = None, id_column: str = "page_id", body_column: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes every page, reads the archives back: id, payload_bytes, payload_digest, record_type, refers_to.

    What a revisit says of its payload comes from the response that it refers to.
    """
    spark = pages.sparkSession
    own = to is None
    to = to or new_path(spark, "warc")
    records, read = plan_records(pages, id_column, body_column, least_bytes)
    write_warc(records, to)
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1).cast("long")
    digest = F.regexp_extract("payload_digest", "^sha1:(.*)$", 1)
    back = read_warc(spark, to).select(
        number(F.col("target")).alias("id"), "record_type", F.when(F.col("refers_to").isNotNull(), number(F.col("refers_to"))).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("record_type") == "revisit", digest).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
    )
    rows, _ = written(back, "warc-records")
    for path in [*read, *([to] if own else [])]:
        remove(spark, path)
    responses = rows.where("record_type = 'response'").select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    revisits = rows.where("record_type = 'revisit'").select("id", "refers_to", "payload_digest")
    key = ["refers_to", "payload_digest"]
    asked = revisits.groupBy(*key).agg(F.count("*").alias("n"))
    table = responses.select(F.col("id").alias("refers_to"), "payload_digest", "payload_bytes").dropDuplicates(key).join(asked, key)
    found = join_with_hot(revisits, table, key, "n", pages.count()).select("id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    real = [F.nullif(F.col(c), F.lit(LEAST_ID)).alias(n) for c, n in (("id", id_column), ("refers_to", "refers_to"))]
    return responses.unionByName(found).select(real[0], "payload_bytes", "payload_digest", "record_type", real[1])
