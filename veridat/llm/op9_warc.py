"""WARC archives with revisit records.

Headers are grouped by payload digest; each group of equal payloads has one response, and
the others become revisit records that refer to it. Every record is a gzip member of its
own, and Spark's committed text writer writes the members. Archives are read back member by
member, and revisit records are joined with the responses that they refer to.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, fresh_path, numbered, spread_join, written

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MOST_GROUPS = 200_000  # of a digest, an id and an address each: sent to all executors up to here
_MEMBER = 15 << 20  # bytes of a gzip member: below 16 MiB the last byte of its length is zero
_CHUNK = 1 << 14
_EOL = "\r\n"


def resolve(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, row, first) for each row.

    Of rows with equal payloads of at least ``least_bytes``, the one with the smallest
    page_id is the response (``first`` null); the others have it as ``first`` (page_id, row,
    url). A null html is an empty payload. Null ids come after all others. Rows that repeat a
    page_id and its payload keep one response among them; the others refer to it. No rows
    give no rows; further columns are left out.

    Rows are numbered and written once, so both sides of the join agree on them. Groups are
    found on headers only; the least id is taken before the shuffle."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    full = numbered(
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("payload_digest")),
        "row",
    )
    heads = full.where(F.col("payload_bytes") >= least_bytes)
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "url"))
    groups = written(heads.groupBy("payload_digest").agg(least.alias("first"), F.count("*").alias("copies")).where("copies > 1").select("payload_digest", F.struct("first.page_id", "first.row", "first.url").alias("first"), "copies"))
    if groups.count() <= MOST_GROUPS:  # payloads don't move
        known = full.join(F.broadcast(groups), "payload_digest", "left")
    else:
        known = spread_join(full, groups, "payload_digest", F.col("copies") * HOT >= heads.count(), F.col("row"))
    again = (F.col("payload_bytes") >= least_bytes) & F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    return known.select("page_id", "url", "html", "payload_bytes", "payload_digest", "row", F.when(again, F.col("first")).alias("first"))


def _record_id(run: str, row: Column) -> Column:
    """An id of its own for each row of each run, as a UUID."""
    hexed = F.sha2(F.concat(F.lit(f"{run} "), row.cast("string")), 256)
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hexed, "^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", "$1-$2-5$3-8$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))


def _address(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")


def records(resolved: DataFrame, date: str, run: str) -> Column:
    """The text of each record, with fresh headers."""
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_EOL + _EOL))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    origin = F.concat(
        _line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _record_id(run, F.col("first.row"))), _line("WARC-Refers-To-Target-URI", _address(F.col("first.url"))), _line("WARC-Refers-To-Date", F.lit(date))
    )
    return F.concat(
        F.lit(VERSION + _EOL),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(run, F.col("row"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _address(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, origin).otherwise(""),
        F.when(F.col("page_id").isNotNull(), _line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_EOL),
        block,
        F.lit(_EOL + _EOL),
    )


def write_archives(resolved: DataFrame, path: str, date: str | None = None, bytes_per_file: int = 1 << 28, rename: bool = True) -> None:
    """Files ``*.warc.gz`` below ``path``, each begun by a warcinfo record and closed by the
    record that brings it to ``bytes_per_file`` compressed.

    A record is one gzip member (one of 16 MiB or more is several). All members of a record are
    one value, and so are the warcinfo and the first record of a file. Values go to the writer in
    order of (volume, number), which is set before it, so no sort that spills can mix them. The
    text writer ends each value with a zero byte: the last byte of every record's last member,
    which is left out of its value.

    Spark names the files ``*.txt``; with ``rename`` the driver renames them, which is cheap in a
    file system and a copy each in an object store. They are read under both names."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    run = uuid.uuid4().hex

    def info(volume: int) -> bytes:
        fields = f"software: veridat{_EOL}format: WARC File Format 1.1{_EOL}"
        head = f"{VERSION}{_EOL}WARC-Type: warcinfo{_EOL}WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>{_EOL}WARC-Date: {date}{_EOL}Content-Type: application/warc-fields{_EOL}Content-Length: {len(fields)}{_EOL}{_EOL}"
        return (head + fields + _EOL + _EOL).encode()

    def packed(batches):
        volume, number, size = 0, 0, 0
        names = ["volume", "number", "value"]
        for batch in batches:
            out, volumes, numbers, held = [], [], [], 0
            for value in batch.column(0):
                raw = value.as_buffer()
                parts = [info(volume)] if not size else []
                parts += [raw[i : i + _MEMBER] for i in range(0, len(raw), _MEMBER)]
                members = b"".join(gzip.compress(part, 6, mtime=0) for part in parts)
                out.append(members[:-1])
                volumes.append(volume)
                numbers.append(number)
                size += len(members)
                held += len(members)
                number += 1
                if size >= bytes_per_file:
                    volume, size = volume + 1, 0
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(volumes, pa.int32()), pa.array(numbers, pa.int64()), pa.array(out, pa.binary())], names)
                    out, volumes, numbers, held = [], [], [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(volumes, pa.int32()), pa.array(numbers, pa.int64()), pa.array(out, pa.binary())], names)

    values = resolved.select(records(resolved, date, run).cast("binary").alias("value")).mapInArrow(packed, "volume int, number long, value binary")
    ordered = values.sortWithinPartitions("volume", "number").select("volume", F.col("value").cast("string").alias("value"))
    ordered.write.option("lineSep", "\0").partitionBy("volume").text(path)
    if rename:
        _name_files(resolved.sparkSession, path)


def _name_files(spark: SparkSession, path: str) -> None:
    """The text writer's files, named as archives."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files, found = fs.listFiles(root, True), []
    while files.hasNext():
        found.append(files.next().getPath())
    texts = [f for f in found if f.getName().endswith(".txt")]
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda f: fs.rename(f, hadoop.Path(f.getParent(), f.getName().removesuffix(".txt") + ".warc.gz")), texts))


def _inflated(raw: memoryview):
    """The stream that the gzip members of ``raw`` hold, in pieces."""
    at = 0
    while at < len(raw):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(raw):
                raise ValueError("an archive ends within a record")
            piece = raw[at : at + _CHUNK]
            yield member.decompress(piece)
            at += len(piece) - len(member.unused_data)


def _parsed(pieces):
    """(headers, block) of each record of a stream."""
    held = bytearray()
    head, need = None, 0
    for piece in pieces:
        held += piece
        while True:
            if head is None:
                stop = held.find(b"\r\n\r\n")
                if stop < 0:
                    break
                first, *lines = held[:stop].decode().split(_EOL)
                if first != VERSION:
                    raise ValueError(f"not a record of {VERSION}: {first[:40]!r}")
                head = dict(x.split(": ", 1) for x in lines)
                need = int(head["Content-Length"])
                del held[: stop + 4]
            if len(held) < need + 4:
                break
            if held[need : need + 4] != b"\r\n\r\n":
                raise ValueError("a record doesn't end where its length says")
            yield head, bytes(held[:need])
            del held[: need + 4]
            head = None
    if held or head is not None:
        raise ValueError("an archive ends within a record")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(record_id, page_id, url, record_type, refers_to_id, payload_digest, payload_bytes, html)
    of each response and revisit record.

    The payload of a response is hashed anew and must have the digest that its header
    gives. The payload_bytes of a revisit are those that its HTTP header gives; its html is null.
    Without ``payloads``, every html is. A folder without archives gives no rows."""
    schema = "record_id string, page_id long, url string, record_type string, refers_to_id string, payload_digest string, payload_bytes long, html string"
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def row(head, block):
        revisit = head["WARC-Type"] == "revisit"
        stop = block.index(b"\r\n\r\n") + 4
        payload, digest = block[stop:], head["WARC-Payload-Digest"].removeprefix("sha256:")
        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload doesn't have its digest")
        size = int(dict(x.split(": ", 1) for x in block[: stop - 4].decode().split(_EOL)[1:])["Content-Length"]) if revisit else len(payload)
        page = head.get("X-Page-ID")
        return head["WARC-Record-ID"], int(page) if page else None, head["WARC-Target-URI"], head["WARC-Type"], head.get("WARC-Refers-To"), digest, size, payload.decode() if payloads and not revisit else None

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in _parsed(_inflated(memoryview(content.as_buffer()))):
                    if head["WARC-Type"] not in ("response", "revisit"):
                        continue
                    rows.append(row(head, block))
                    size += len(block) if payloads else 200
                    if size > 4_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc.gz,txt}").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, schema)


def restore(found: DataFrame) -> DataFrame:
    """``found`` with ``refers_to``: the page_id of the response that a revisit refers to."""
    found = written(found)
    asked = found.where("refers_to_id is not null").groupBy(F.col("refers_to_id").alias("record_id")).agg(F.count("*").alias("times"))
    origins = written(found.where("record_type = 'response'").join(asked, "record_id").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "times"))
    if origins.count() <= MOST_GROUPS:
        known = found.join(F.broadcast(origins), "refers_to_id", "left")
    else:
        known = spread_join(found, origins, "refers_to_id", F.col("times") * HOT >= found.count(), F.xxhash64("record_id"))
    return known.drop("times")


def op9_warc_revisit(spark, sf_dir) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(resolve(spark.read.parquet(f"{sf_dir}/pages.parquet")), path, rename=False)
    found = restore(read_archives(spark, path, payloads=False).drop("html", "url"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
