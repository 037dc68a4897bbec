"""Delimited and fixed-width files as frames of text."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import DataQualityError, identifier
from ..functions.text import SPACE
from .records import csv_records, is_large

PREVIEW_ROWS = 20
_NEVER = "\x00veridat-null\x00"  # no field has this text, so none reads as null for it
PARSER_HEADER = "column_name,start_position,field_length,sequence_number"


@dataclass(frozen=True)
class FixedColumn:
    name: str
    start: int  # from 1
    length: int
    sequence: int = 0


@functools.cache
def _local_folder() -> tempfile.TemporaryDirectory:
    """One temporary folder of a local session, removed when Python ends."""
    return tempfile.TemporaryDirectory(prefix="veridat-", ignore_cleanup_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that executors share, spark.checkpoint.dir; only a local
    session gets a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise DataQualityError("spark.checkpoint.dir must name a folder that all executors share.")
        folder = _local_folder().name
    return os.path.join(folder, f"{name}-{uuid.uuid4().hex}")


_CSV = {"quote": '"', "escape": '"', "nullValue": _NEVER, "emptyValue": "", "multiLine": "true", "mode": "PERMISSIVE"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; an empty field is the empty text, never null, and NA is text. Line
    ends may stand inside quotes, also in files of many byte ranges, which as many tasks read."""
    df = spark.read.csv(path, header=True, inferSchema=False, **_CSV)
    if not df.columns:
        raise DataQualityError(f"The file has no columns: {path}")
    if is_large(spark, path):
        df = csv_records(spark, path, df.columns, _CSV)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def fixed_columns(definition: str) -> list[FixedColumn]:
    """Columns from their pasted definition, a header and a line of four parts for each."""
    lines = [x.strip() for x in definition.strip().splitlines() if x.strip()]
    if not lines or lines[0].replace(" ", "") != PARSER_HEADER:
        raise DataQualityError(f"The parser definition has to begin with: {PARSER_HEADER}")
    out = []
    for line in lines[1:]:
        parts = [p.strip() for p in line.split(",")]
        if len(parts) != 4:
            raise DataQualityError(f"A line of the parser definition needs four parts: {line!r}")
        try:
            name, (start, length, sequence) = identifier(parts[0], "column name"), map(int, parts[1:])
        except ValueError as problem:
            raise DataQualityError(f"Not a valid line of the parser definition: {line!r} ({problem})") from None
        if min(start, length, sequence) < 1:
            raise DataQualityError(f"Positions and lengths count from one: {line!r}")
        out.append(FixedColumn(name, start, length, sequence))
    if len({c.name for c in out}) < len(out) or len({c.sequence for c in out}) < len(out):
        raise DataQualityError("Column names and sequence numbers of a parser definition must be unique.")
    return sorted(out, key=lambda c: c.sequence)


def fixed_width(lines: DataFrame, columns: list[FixedColumn]) -> DataFrame:
    """The fields of one-column ``lines``; a short line has empty fields."""
    value = F.col(lines.columns[0])
    field = lambda c: F.translate(F.substring(value, c.start, c.length), "\x00", "")
    return lines.select(*[F.regexp_replace(field(c), rf"\A{SPACE}+|{SPACE}+\z", "").alias(c.name) for c in columns])


def read_fixed_width(spark: SparkSession, path: str, columns: list[FixedColumn]) -> DataFrame:
    """Latin-1 lines cut at fixed places; blank lines don't count."""
    if not columns:
        raise DataQualityError("A fixed-width file needs a parser definition.")
    lines = spark.read.csv(path, sep="\x01", quote="", escape="", encoding="ISO-8859-1", header=False, schema="value string", nullValue=_NEVER, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    kept = lines.select(F.regexp_replace(F.coalesce("value", F.lit("")), r"[\r\n]+\z", "").alias("value")).where(F.col("value").rlike(r"[^\s]"))
    if kept.isEmpty():
        raise DataQualityError(f"The file has no records: {path}")
    return fixed_width(kept, columns)


def read_source(spark: SparkSession, source_type: str, path: str, columns: list[FixedColumn] | None = None) -> DataFrame:
    if source_type == "csv":
        return read_csv(spark, path)
    if source_type == "fixed_width":
        return read_fixed_width(spark, path, columns or [])
    raise DataQualityError(f"Unsupported source_type: {source_type}")


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    return df.limit(rows)
