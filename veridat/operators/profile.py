"""Column profiles."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import DataQualityError
from .rules import col

SAMPLE_SCANNED, SAMPLE_KEPT = 100, 10
INTERNAL = ("_source_file", "_ingested_at", "_load_run_id", "_dq_row_identifier")

# What all samples of a text column have to match.
CURRENCY, PERCENTAGE, INTEGER = r"\$[\d,]+(\.\d+)?", r"\d+(\.\d+)?%", r"\d+"


def infer_type(data_type: T.DataType | str, samples: list[str]) -> str:
    """currency, percentage, integer, year, numeric, date, boolean, text or unknown.

    The catalog's type decides first; only text looks at its samples."""
    name = data_type if isinstance(data_type, str) else data_type.simpleString()
    if re.match(r"(tiny|small|big)?int|long|short|byte", name):
        return "integer"
    if re.match("double|float|decimal|numeric|real", name):
        return "numeric"
    if re.match("date|timestamp", name):
        return "date"
    if name.startswith("bool"):
        return "boolean"
    if not samples:
        return "unknown"
    every = lambda pattern: all(re.fullmatch(pattern, s, re.ASCII) for s in samples)
    if every(CURRENCY):
        return "currency"
    if every(PERCENTAGE):
        return "percentage"
    if every(INTEGER):
        return "year" if all(len(s) == 4 for s in samples) else "integer"
    return "text"


def catalog(df: DataFrame) -> list[tuple[int, str, str]]:
    """(position, column_name, data_type) of a table's own columns, from 1."""
    return [(n, f.name, f.dataType.simpleString()) for n, f in enumerate((f for f in df.schema.fields if f.name not in INTERNAL), 1)]


STATISTICS = "column_name string, row_count long, null_count long, distinct_count long, min_value string, max_value string"


def digest(value: Column) -> tuple[Column, Column, Column]:
    """Two hashes of 64 bits that stand for a text, null for null, and a third that tells
    whether unequal texts share them."""
    known = lambda c: F.when(value.isNotNull(), c)
    return known(F.xxhash64(value)), known(F.xxhash64(F.lit("second"), value)), F.crc32(value)


def statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, row_count, null_count, distinct_count, min_value, max_value), a row for
    each column; least and greatest are of the values as text.

    Two jobs read the columns side by side. One merges least and greatest in each task. In the other
    the columns are unpivoted to (column, digest), and what is shuffled are distinct digests of
    128 bits, however long the values are; each task merges what it has first, so no frequent
    value weighs more than one row for each task. Unequal values of one digest, if there ever are
    any, are an error."""
    columns = columns if columns is not None else [c for c in df.columns if c not in INTERNAL]
    if not columns:
        return df.sparkSession.createDataFrame([], STATISTICS)
    text = df.select(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    ends = text.agg(*[f(f"c{i}").alias(f"{name}{i}") for i in range(len(columns)) for name, f in (("min", F.min), ("max", F.max))])

    def cell(i: int) -> Column:
        first, second, check = digest(F.col(f"c{i}"))
        return F.struct(F.lit(i).alias("i"), first.alias("a"), second.alias("b"), check.alias("check"))

    cells = text.select(F.explode(F.array(*[cell(i) for i in range(len(columns))])).alias("x")).select("x.*")
    values = cells.groupBy("i", "a", "b").agg(F.count("*").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    found = values.groupBy("i").agg(F.sum("n").alias("row_count"), count(F.col("a").isNull()).alias("null_count"), F.count("a").alias("distinct_count"), F.count_if(F.col("low") != F.col("high")).alias("shared"))
    with ThreadPoolExecutor(2) as pool:
        least, counted = pool.submit(ends.first), pool.submit(found.collect)  # one row, and one a column
    least, rows = least.result(), {r.i: r for r in counted.result()}
    if shared := [columns[i] for i, r in rows.items() if r.shared]:
        raise DataQualityError(f"Unequal values have the same digest in columns {shared}.")
    out = [(c, rows[i].row_count, rows[i].null_count, rows[i].distinct_count, least[f"min{i}"], least[f"max{i}"]) if i in rows else (c, 0, 0, 0, None, None) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(out, STATISTICS)


HEAD = 2 * SAMPLE_SCANNED  # rows that are taken first


def samples(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Up to ten distinct trimmed values of each column, in the order in which they come
    among the first hundred that aren't null.

    Two jobs at most, whatever the number of columns: the first rows, which are enough for
    columns with few nulls, then one scan for all others, in which each task keeps the first
    hundred values of each and stops when it has them."""
    found: dict[int, list[str]] = {i: [] for i in range(len(columns))}
    if not columns:
        return {}
    text = df.select(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    head = text.limit(HEAD).collect()
    for i in found:
        found[i] = [r[i] for r in head if r[i] is not None][:SAMPLE_SCANNED]
    if len(head) == HEAD and (open_ := [i for i in found if len(found[i]) < SAMPLE_SCANNED]):
        for i, values in _first_values(text, open_).items():
            found[i] = values
    return {c: [v.strip() for v in list(dict.fromkeys(found[i]))[:SAMPLE_KEPT]] for i, c in enumerate(columns)}


def _first_values(text: DataFrame, wanted: list[int]) -> dict[int, list[str]]:
    """The first values that aren't null of some columns, in the order of partitions and rows."""

    def run(batches):
        left = dict.fromkeys(wanted, SAMPLE_SCANNED)
        for batch in batches:
            for i in [i for i, n in left.items() if n]:
                values = batch.column(batch.schema.get_field_index(f"c{i}")).drop_null().slice(0, left[i])
                if len(values):
                    at = SAMPLE_SCANNED - left[i]
                    left[i] -= len(values)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(values), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(values), pa.int32()), pa.array(range(at, at + len(values)), pa.int32()), values.cast(pa.string())], ["i", "part", "at", "v"])
            if not any(left.values()):
                return

    firsts = text.select(*[f"c{i}" for i in wanted]).mapInArrow(run, "i int, part int, at int, v string")
    order = Window.partitionBy("i").orderBy("part", "at")
    out: dict[int, list[str]] = {i: [] for i in wanted}
    for r in firsts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_SCANNED).orderBy("i", "n").collect():
        out[r.i].append(r.v)
    return out


def profile(df: DataFrame, columns: list[str] | None = None, dataset: str = "") -> list[dict]:
    """A profile of each column, as the miner and the proposers take it."""
    columns = columns if columns is not None else [c for c in df.columns if c not in INTERNAL]
    stats = {r.column_name: r.asDict() for r in statistics(df, columns).collect()}  # one row a column
    seen = samples(df, columns)
    return [
        {
            "dataset_name": dataset, **stats[c], "null_percent": stats[c]["null_count"] / stats[c]["row_count"] * 100 if stats[c]["row_count"] else 0.0,
            "sample_values": seen[c], "inferred_type": infer_type(df.schema[c].dataType, seen[c]),
        }
        for c in columns
    ]
