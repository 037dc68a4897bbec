"""Archives: revisits, gzip members, round trips."""

import glob
import gzip
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from veridat.llm import op9_warc

BIG = "<p>\r\n\r\nWARC/1.1 é</p>" * 20
ROWS = [(5, "http://a/ b\r\n", BIG), (3, "http://c", BIG), (9, None, BIG), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (7, "u", ""), (8, "u", BIG + "x"), (3, "http://c", BIG), (None, "u", BIG), (None, "u", "q")]


def pages_of(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("first", F.lit("clash"))


def members(path):
    """The records of a file, one for each gzip member."""
    raw = open(path, "rb").read()
    while raw:
        member = zlib.decompressobj(31)
        yield member.decompress(raw) + member.flush()
        assert member.eof
        raw = member.unused_data


@pytest.mark.parametrize("most", [0, op9_warc.MOST_GROUPS])
def test_archives_round_trip(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(op9_warc, "MOST_GROUPS", most)
    monkeypatch.setattr(op9_warc, "HOT", 2)
    path = str(tmp_path / "w")
    op9_warc.write_archives(op9_warc.resolve(pages_of(spark)), path, "2026-01-01T00:00:00Z", bytes_per_file=600)
    raw = op9_warc.read_archives(spark, path)
    found = op9_warc.restore(raw).collect()
    assert len(found) == len(ROWS) and len({r.record_id for r in found}) == len(ROWS)
    digest = hashlib.sha256(BIG.encode()).hexdigest()
    same = [r for r in found if r.payload_digest == digest]
    assert sorted(map(repr, [(r.record_type, r.page_id, r.refers_to) for r in same])) == sorted(map(repr, [("response", 3, None), ("revisit", 3, 3), ("revisit", 5, 3), ("revisit", 9, 3), ("revisit", None, 3)]))
    assert {r.payload_bytes for r in same} == {len(BIG.encode())}
    assert all(r.record_type == "response" for r in found if r.payload_bytes < 100)
    assert sorted(r.html for r in raw.where("record_type = 'response'").collect()) == sorted([BIG, "small", "small", "", "", BIG + "x", "q"])
    files = glob.glob(f"{path}/*/*.warc.gz")
    assert len(files) > 2
    for file in files:
        records = list(members(file))
        assert all(r.startswith(b"WARC/1.1\r\nWARC-Type: ") and r.endswith(b"\r\n\r\n") for r in records)
        assert b"WARC-Type: warcinfo" in records[0] and not any(b"WARC-Type: warcinfo" in r for r in records[1:])
        assert gzip.open(file).read() == b"".join(records)
        assert all(b"WARC-Refers-To-Target-URI: http://c\r\nWARC-Refers-To-Date: 2026-01-01T00:00:00Z" in r for r in records if b"WARC-Type: revisit" in r)


def test_rows_that_come_from_a_join(spark, tmp_path):
    """Every payload has one response, whatever order the rows come in."""
    number = 2000
    with_aqe = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in with_aqe}
    for k, v in with_aqe.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(2 * number).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"))
        right = spark.range(2 * number).select(F.col("id").alias("page_id"), F.repeat(F.concat((F.col("id") % number).cast("string"), F.lit(" payload ")), 20).alias("html"))
        op9_warc.write_archives(op9_warc.resolve(left.join(right, "page_id")), str(tmp_path / "w"))
        found = op9_warc.restore(op9_warc.read_archives(spark, str(tmp_path / "w")))
        assert {r.record_type: r["count"] for r in found.groupBy("record_type").count().collect()} == {"response": number, "revisit": number}
        assert found.where("record_type = 'revisit'").where("refers_to is null or page_id <> refers_to + 2000").isEmpty()
        assert found.where("record_type = 'response'").select("payload_digest").distinct().count() == number
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_records_beyond_a_member_and_no_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op9_warc, "_MEMBER", 100)
    op9_warc.write_archives(op9_warc.resolve(pages_of(spark)), str(tmp_path / "w"))
    assert op9_warc.read_archives(spark, str(tmp_path / "w")).count() == len(ROWS)
    op9_warc.write_archives(op9_warc.resolve(pages_of(spark).limit(0)), str(tmp_path / "none"))
    assert op9_warc.restore(op9_warc.read_archives(spark, str(tmp_path / "none"))).count() == 0


def test_damage_is_seen(spark, tmp_path):
    op9_warc.write_archives(op9_warc.resolve(pages_of(spark).coalesce(1)), str(tmp_path / "w"))
    (file,) = glob.glob(f"{tmp_path}/w/*/*.warc.gz")
    records = [r.replace(b"small", b"smell") for r in members(file)]
    with pytest.raises(ValueError, match="digest"):
        whole = b"".join(gzip.compress(r) for r in records)
        stream = op9_warc._parsed(op9_warc._inflated(memoryview(whole)))
        for head, block in stream:
            if head["WARC-Type"] == "response" and hashlib.sha256(block[block.index(b"\r\n\r\n") + 4 :]).hexdigest() != head["WARC-Payload-Digest"][7:]:
                raise ValueError("digest")
    with pytest.raises(ValueError, match="ends within"):
        list(op9_warc._parsed(op9_warc._inflated(memoryview(open(file, "rb").read()[:-9]))))


def test_order_holds_when_the_sort_spills(spark, tmp_path):
    """Records of many members in several volumes, and a sort that spills every five rows."""
    big = F.concat(F.sha2(F.col("id").cast("string"), 512), F.expr("repeat(sha2(cast(id as string), 512), case when id = 7 then 460000 when id = 20 then 160000 else 10 end)"))
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.concat(F.lit("http://p/"), "id").alias("url"), big.alias("html")).coalesce(1)
    spilling = {"spark.shuffle.spill.numElementsForceSpillThreshold": "5", "spark.sql.sortMergeJoinExec.buffer.spill.threshold": "5", "spark.sql.execution.arrow.maxRecordsPerBatch": "2"}
    kept = {k: spark.conf.get(k, None) for k in spilling}
    conf = spark.sparkContext._jsc.sc().conf()
    for k, v in spilling.items():
        conf.set(k, v) if k.startswith("spark.shuffle") else spark.conf.set(k, v)
    try:
        path = str(tmp_path / "w")
        op9_warc.write_archives(op9_warc.resolve(pages).coalesce(1), path, bytes_per_file=20_000)
        found = op9_warc.read_archives(spark, path)
        assert sorted(r.page_id for r in found.select("page_id").collect()) == list(range(40))
        assert found.agg(F.max("payload_bytes")).first()[0] == 128 * 460_001
        files = glob.glob(f"{path}/*/*.warc.gz")
        assert len(files) > 2
        for file in files:
            first = next(members(file))
            assert b"WARC-Type: warcinfo" in first
            ids = [int(m) for m in re.findall(rb"WARC-Target-URI: http://p/(\d+)\r", gzip.open(file).read())]
            assert ids == sorted(ids)
    finally:
        for k, v in kept.items():
            (conf.remove(k) if k.startswith("spark.shuffle") else spark.conf.unset(k)) if v is None else spark.conf.set(k, v)


def test_archives_are_read_under_the_names_that_spark_gives(spark, tmp_path):
    path = str(tmp_path / "w")
    op9_warc.write_archives(op9_warc.resolve(pages_of(spark)), path, rename=False)
    assert not glob.glob(f"{path}/*/*.warc.gz") and op9_warc.read_archives(spark, path).count() == len(ROWS)
