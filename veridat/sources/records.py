"""Large delimited files read by many tasks.

A line end inside quotes doesn't end a record, so where a byte range of a file begins, only
what comes before tells whether that is inside quotes. A first pass finds for each range what
it would end in, from either beginning; put one behind the other, these say what each range
begins in. The second pass then glues lines to records within each range, and only records
that lie across ranges are put together from their pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, BEGUN, GOES_ON, ENDS, HEADER = 0, 1, 2, 3, 4
_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+)'
_FIELDS = re.compile(f"{_FIELD}(?:,{_FIELD})*+", re.DOTALL)
_CLOSES = re.compile(r'(?:[^"]++|"")*+"[^,]*+', re.DOTALL)
_BLOCKS = "file long, start long, outside boolean, inside boolean"
_PIECES = "file long, start long, kind int, record string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line end stands inside quotes, of a line that begins inside or not. Quotes count
    where a field begins; within them, two are one and one ends them."""
    at = 0
    if inside:
        closed = _CLOSES.match(line)
        if closed is None:
            return True
        at = closed.end()
        if at == len(line):
            return False
        at += 1  # the comma behind the field
    found = _FIELDS.match(line, at)
    return found is None or found.end() < len(line)


def _pinned(spark: SparkSession, path: str) -> SparkSession:
    """A session beside this one in which every scan of the files has the same byte ranges. Spark
    sizes them anew for each scan, by the bytes of those files that its filters leave and by the
    cores of that moment. With one partition asked for, ranges have the largest size, which is set
    to what Spark would take now; where files that are left have less in all, each is one range."""
    conf = spark._jsparkSession.sessionState().conf()
    files, length = spark.read.format("binaryFile").load(path).agg(F.count("*"), F.sum("length")).first()
    cores = int(spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism)
    share = ((length or 0) + files * conf.filesOpenCostInBytes()) // cores
    size = min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), share, 1))
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): each line with the file and byte range that it begins in; lines of
    a range come in order."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batch: pa.RecordBatch):
    """Rows of a batch that are of one range: (file, start, values)."""
    file, start = (batch.column(i).to_numpy() for i in (0, 1))
    cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(file[a]), int(start[a]), batch.column(2).slice(a, b - a)


def range_states(lines: DataFrame) -> DataFrame:
    """_BLOCKS: of each byte range with a quote, whether it ends inside quotes if it begins
    outside them, and if inside."""

    def run(batches):
        at, state = None, None
        rows = []
        for batch in batches:
            for file, start, values in _runs(batch):
                if at != (file, start):
                    if at:
                        rows.append((*at, *state))
                    at, state = (file, start), (False, True)
                for line in values.to_pylist():
                    out = {s: ends_inside(line, s) for s in set(state)}
                    state = out[state[0]], out[state[1]]
        if at:
            rows.append((*at, *state))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "start", "outside", "inside"])

    return lines.where(F.contains("value", F.lit('"'))).mapInArrow(run, _BLOCKS)


def _beginnings(states: list) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], set[int]]:
    """By file, the ranges with quotes and whether each ends inside them, and the files of which
    one does. A range of 128 MB is a row, so even 100 TB are less than a million."""
    ends: dict[int, tuple[list, list]] = {}
    for r in sorted(states, key=lambda r: (r.file, r.start)):
        starts, inside = ends.setdefault(r.file, ([], []))
        inside.append(r.inside if inside and inside[-1] else r.outside)
        starts.append(r.start)
    open_ = {f for f, (_, inside) in ends.items() if any(inside)}
    return {f: (np.array(starts), np.array(inside)) for f, (starts, inside) in ends.items()}, open_


def _glued(lines: DataFrame, ends: dict) -> DataFrame:
    """_PIECES: records, and the pieces of those that lie across ranges: where one has BEGUN, what
    GOES_ON for a whole range, and where it ENDS."""
    shared = lines.sparkSession.sparkContext.broadcast(ends)

    def begins_inside(file: int, start: int) -> bool:
        starts, inside = shared.value.get(file, (np.zeros(0), np.zeros(0, bool)))
        before = int(np.searchsorted(starts, start, "left")) - 1
        return bool(inside[before]) if before >= 0 else False

    def out(file, start, kinds, records):
        n = len(records)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, file, np.int64)), pa.array(np.full(n, start, np.int64)), pa.array(kinds, pa.int32()), pa.array(records, pa.string()) if isinstance(records, list) else records.cast(pa.string())], ["file", "start", "kind", "record"])

    def run(batches):
        at, inside, held, first, header = None, False, [], False, False
        for batch in batches:
            for file, start, values in _runs(batch):
                if at != (file, start):
                    if held:
                        yield out(*at, [GOES_ON if first else BEGUN], ["\n".join(held)])
                    at, held, header = (file, start), [], start == 0
                    first = inside = begins_inside(file, start)
                if not inside and not header and not pc.any(pc.match_substring(values, '"')).as_py():
                    yield out(file, start, np.zeros(len(values), np.int32), values)
                    continue
                kinds, found = [], []
                for line in values.to_pylist():
                    held.append(line)
                    inside = ends_inside(line, inside)
                    if not inside:
                        record = "\n".join(held)
                        kinds.append(ENDS if first else HEADER if header else WHOLE)
                        header = header and record in ("", "\r")  # empty lines may come before it
                        found.append(record)
                        held, first = [], False
                if found:
                    yield out(file, start, kinds, found)
        if held:
            yield out(*at, [GOES_ON if first else BEGUN], ["\n".join(held)])

    return lines.mapInArrow(run, _PIECES)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record) of the files without their headers; a header has to end within the first byte
    range. Empty lines are no records."""
    lines = _lines(_pinned(spark, path), path)  # states and pieces have to be of the same ranges
    ends, open_files = _beginnings(range_states(lines).collect())  # a row for each range
    found = _glued(lines, ends).where(F.col("kind") == WHOLE).select("record")
    if open_files:  # few pieces: two a range at most
        pieces = _glued(lines.where(F.col("file").isin(*open_files)), ends).where(F.col("kind").isin(BEGUN, GOES_ON, ENDS))
        order = Window.partitionBy("file").orderBy("start", F.col("kind") == BEGUN)
        numbered = pieces.withColumns({"n": F.sum(F.when(F.col("kind") == BEGUN, 1).otherwise(0)).over(order), "at": F.row_number().over(order)})
        parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "record"))), lambda x: x["record"])
        found = found.unionByName(numbered.groupBy("file", "n").agg(F.array_join(parts, "\n").alias("record")).select("record"))
    found = spark.range(0).select(F.lit("").alias("record")).unionByName(found)  # a frame of the caller's session
    # a carriage return before the line end that ends a record is part of the line end
    return found.select(F.regexp_replace("record", r"\r\z", "").alias("record")).where("record <> ''")


def is_large(spark: SparkSession, path: str) -> bool:
    """Whether a file is more than one byte range, with line ends that the ranges are cut at."""
    longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    if (longest or 0) <= spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return False
    first = spark.read.text(path, lineSep="\n").first()
    return first is not None and "\r" not in first.value[:-1]


def csv_records(spark: SparkSession, path: str, columns: list[str], options: dict[str, str]) -> DataFrame:
    """The fields of all records, each a text, under the names of ``columns``. Where lines end in
    a carriage return and a line feed, those within quotes become line feeds, as in files that
    one task reads; the first line tells for all files of a folder."""
    names = [f"c{i}" for i in range(len(columns))]
    parsed = F.from_csv("record", F.lit(", ".join(f"{n} string" for n in names)), options)
    found = records(spark, path)
    first = spark.read.text(path, lineSep="\n").first()
    if first is not None and first.value.endswith("\r"):
        found = found.withColumn("record", F.replace("record", F.lit("\r\n"), F.lit("\n")))
    return found.select(parsed.alias("x")).select(*[F.col(f"x.{n}").alias(c) for n, c in zip(names, columns, strict=True)])
