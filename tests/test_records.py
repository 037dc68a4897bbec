"""Large delimited files: the same rows as one task reads."""

import hashlib
import random

import pytest

from veridat.plans import registered
from veridat.sources import files, records

FIELDS = ["a", "", "two words", "x,y", 'say "hi"', "line\nend", 'both,"\n"', "\n", '"', "é日本", " padded ", "NA", "r\r\nn", "#no comment", "0" * 90]


def quoted(v):
    return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r') else v


def write(path, rows, end="\n", last=True):
    lines = [",".join(quoted(v) for v in r) for r in [("p", "q", "r"), *rows]]
    path.write_bytes((end.join(lines) + (end if last else "")).encode())


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("end", "last", "size"), [("\n", True, 97), ("\n", False, 41), ("\r\n", True, 150), ("\n", True, 4000)])
def test_ranges_give_the_rows_of_the_whole(spark, tmp_path, end, last, size):
    rng = random.Random(size)
    rows = [tuple(rng.choice(FIELDS) for _ in range(3)) for _ in range(300)]
    rows.insert(150, ("long", "x\n" * 500, "goes over many ranges"))
    rows = [r for r in rows if any(r)]
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", rows, end, last)
    write(folder / "b.csv", rows[:40], end, last)
    one = rows_of(files.read_csv(spark, str(folder)))
    held = [tuple(v.replace("\r\n", "\n") for v in r) for r in rows] if end == "\r\n" else rows  # within quotes too
    assert one == sorted(held + held[:40])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        assert records.is_large(spark, str(folder))
        df = files.read_csv(spark, str(folder))
        assert df.rdd.getNumPartitions() > 3 and rows_of(df) == one
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(
    ("line", "inside", "want"),
    [
        ("a,b", False, False), ('a,"b', False, True), ('a,"b"', False, False), ('5" tall,b', False, False), ('a,"b""', False, True), ('"",b', False, False), ('a,""', False, False), ("", False, False), ('"', False, True),
        ("still", True, True), ('end",b', True, False), ('end","again', True, True), ('""still', True, True), ('x"tail,b', True, False), ('"', True, False), ("", True, True),
    ],
)
def test_what_a_line_ends_in(line, inside, want):
    assert records.ends_inside(line, inside) == want


def test_ranges_do_not_follow_the_files_that_a_scan_leaves(spark, tmp_path):
    """Files of which no range ends inside quotes are left out of the scan of pieces; Spark then cuts the others elsewhere."""
    rng = random.Random(5)
    rows = [(str(i), rng.choice(FIELDS[2:]), "line\n" * 40 + "end") for i in range(300)]
    plain = [(str(-i), "a", "b") for i in range(1, 3000)]
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", rows)
    write(folder / "b.csv", plain)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        assert rows_of(records.csv_records(spark, str(folder), ["p", "q", "r"], files._CSV)) == sorted(rows + plain)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_ranges_do_not_follow_the_cores_of_the_moment(spark, tmp_path):
    rows = [(str(i), "a", "line\n" * 40 + "end") for i in range(300)]
    write(tmp_path / "a.csv", rows)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "5")
        df = records.csv_records(spark, str(tmp_path / "a.csv"), ["p", "q", "r"], files._CSV)
        spark.conf.set("spark.sql.files.minPartitionNum", "7")
        assert rows_of(df) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_stray_quotes_and_short_rows(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('p,q,r\n5" tall,b\n6" wide,c,d,e\n\n\nlast,"x\ny",z\n')
    one = rows_of(files.read_csv(spark, str(path)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        assert rows_of(files.read_csv(spark, str(path))) == one and len(one) == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_large_documents_are_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = [(i, rng.choice(["en", None]), "".join(rng.choice(FIELDS) + rng.choice(" \n,") for _ in range(40))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(files, "scratch", lambda spark, name: str(tmp_path / name))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1000")
        found = registered.scan_csv_large(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(str(i), lang or "", hashlib.md5(text.replace("\r", " ").encode()).hexdigest()) for i, lang, text in rows]
    assert sorted(map(tuple, found)) == sorted(want)
    sizes = [p.stat().st_size for p in (tmp_path / "csv").glob("part-*")]
    assert max(sizes) < sum(sizes) / 3
