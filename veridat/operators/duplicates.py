"""Which rows may repeat a key, from compact marks of all keys.

Each key is hashed to one of about 64 places for each row. Tasks send the sorted places of
their rows as compressed differences, about two bytes a row instead of the keys; a place that
was seen before, in the same task or another, is shared. Rows whose place isn't shared have a
key of their own, so only the others, few unless keys repeat, are looked at exactly.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 64  # for each row
RANGE_ROWS = 1 << 18  # rows whose places are compared in one group, about
_HELD = 1 << 19  # rows that a task sorts at once, whatever the table's size
_MARKS = "range long, places binary, again binary"


def _packed(places: np.ndarray) -> bytes:
    """Sorted places as compressed differences, in the narrowest type that holds them."""
    steps = np.diff(places, prepend=np.uint64(0)) if len(places) else places
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(steps) or int(steps.max()) <= np.iinfo(k).max)
    return kind[2].encode() + zlib.compress(steps.astype(kind).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[:1].decode()}").astype(np.uint64))


def place(keys: list[Column], bits: int) -> Column:
    """The place of a row's key; null parts of keys equal each other."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits)


def shared_places(df: DataFrame, keys: list[Column], bits: int) -> DataFrame:
    """(place) of all places that more than one row has."""
    low = max(0, min(bits, (RANGE_ROWS * PLACES).bit_length() - 1))  # bits of a place within its range

    def run(batches):
        def marks(held):
            at = np.concatenate(held).view(np.uint64)
            held.clear()
            at.sort()
            same = at[1:] == at[:-1]
            own, again = at[np.append(True, ~same)], np.unique(at[1:][same])
            found = np.unique(own >> np.uint64(low))
            edges = found[1:] << np.uint64(low)
            parts = zip(found.tolist(), np.split(own, np.searchsorted(own, edges)), np.split(again, np.searchsorted(again, edges)), strict=True)
            within = np.uint64((1 << low) - 1)
            rows = [(r, _packed(x & within), _packed(y & within)) for r, x, y in parts]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "places", "again"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy())
                size += batch.num_rows
            if size >= _HELD:
                yield marks(held)
                size = 0
        if held:
            yield marks(held)

    def compared(table: pa.Table) -> pa.Table:
        own = np.concatenate([_unpacked(x.as_py()) for x in table["places"]])
        own.sort()
        again = [own[1:][own[1:] == own[:-1]], *(_unpacked(x) for x in table["again"].to_pylist())]
        found = np.unique(np.concatenate(again)) + (np.uint64(table["range"][0].as_py()) << np.uint64(low))
        return pa.table([pa.array(found.view(np.int64))], ["place"])

    marks = df.select(place(keys, bits).alias("place")).mapInArrow(run, _MARKS)
    return marks.groupBy("range").applyInArrow(compared, "place long")


def possible(df: DataFrame, keys: list[Column], least: int, most: int) -> DataFrame | None:
    """The rows of ``df`` whose key may be that of another row: all that repeat one, and about
    one in PLACES of the others. None of a table of fewer than ``least`` rows, and if more than ``most``
    places are shared, as those are sent to all executors."""
    number = df.count()
    if number < least:
        return None
    bits = min(62, max(1, (number * PLACES).bit_length()))
    found = shared_places(df, keys, bits).limit(most + 1).toArrow()
    if found.num_rows > most:
        return None
    marks = df.sparkSession.createDataFrame(found).withColumnRenamed("place", "__place") if found.num_rows else df.sparkSession.createDataFrame([], "__place long")
    return df.join(F.broadcast(marks), place(keys, bits) == F.col("__place"), "left_semi")
