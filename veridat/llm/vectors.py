"""Embedding vectors as blocks of whole numbers: every component x becomes floor(scale * x).

A block has up to BLOCK vectors of one length as one matrix, in the narrowest type that
holds them, so work on vectors is matrix work and tables of them are small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
SEGMENTS = 8
SCHEMA = "block long, ids array<bigint>, length int, kind string, data binary, norms binary, most double, least_id long, most_id long"
_KINDS = ("int8", "int16", "int32")


def floors(column: pa.Array, scale: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, usable): floor(scale * x) of all components in a row, where each
    vector begins and ends, and whether it has only finite components. Each floor of a double
    is a double too, so nothing is lost."""
    offs = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    x = (values.fill_null(float("nan")) if values.null_count else values).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
    bad = np.zeros(len(x) + 1, np.int64)
    np.cumsum(~np.isfinite(x), out=bad[1:])
    usable = bad[offs[1:]] == bad[offs[:-1]]
    if column.null_count:
        usable &= column.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    return x, offs, usable


def kind_of(matrix: np.ndarray) -> str:
    top = float(np.abs(matrix).max(initial=0))
    return next((k for k in _KINDS if top <= np.iinfo(k).max), "float64")


def segment_norms(matrix: np.ndarray) -> np.ndarray:
    """The length of each of SEGMENTS pieces of each row."""
    wide = -(-max(matrix.shape[1], 1) // SEGMENTS) * SEGMENTS
    full = np.zeros((len(matrix), wide))
    full[:, : matrix.shape[1]] = matrix
    return np.sqrt((full.reshape(len(matrix), SEGMENTS, -1) ** 2).sum(2))


def matrix_of(kind: str, data, rows: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(rows, -1) if rows and len(data) else np.zeros((rows, 0), kind)


def blocks(vectors: DataFrame, scale: int = 64, length: int | None = None) -> DataFrame:
    """SCHEMA: the vectors of ``vectors`` (vec_id, embedding) in blocks, written once, so all
    later plans agree on a vector's place, (block, position).

    Vectors that are null or hold a null or non-finite component (also one that the scale makes
    non-finite) are left out; with ``length``, those of other lengths too. Null and repeated ids
    stay; other columns don't matter; no vectors give no blocks."""

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            x, offs, usable = floors(batch.column(1), scale)
            sizes = np.diff(offs)
            for size in [length] if length is not None else np.unique(sizes[usable]).tolist():
                rows = np.flatnonzero(usable & (sizes == size))
                for at in range(0, len(rows), BLOCK):
                    part = rows[at : at + BLOCK]
                    m = x[offs[part][:, None] + np.arange(size)]
                    ids = batch.column(0).take(pa.array(part))
                    own = ids.drop_null().to_numpy()
                    kind = kind_of(m)
                    norms = segment_norms(m)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids), pa.array([size], pa.int32()), pa.array([kind]), pa.array([m.astype(kind).tobytes()], pa.binary()),
                            pa.array([norms.tobytes()], pa.binary()), pa.array([float(np.sqrt((norms**2).sum(1)).max())]), pa.array([int(own.min()) if len(own) else None], pa.int64()), pa.array([int(own.max()) if len(own) else None], pa.int64()),
                        ],
                        [f.split()[0] for f in SCHEMA.split(", ")],
                    )
                    number += 1

    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return written(source.mapInArrow(run, SCHEMA), "vectors")
