"""Centroid clustering with block-norm screening, in whole numbers.

Each vector is cut into segments whose lengths are computed once. The lengths of the
segments of a vector and of a centroid bound their distance from below (Cauchy-Schwarz),
so only centroids that the bound leaves open get an exact distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, passing_folders, written
from .vectors import SEGMENTS, blocks, matrix_of, segment_norms

_LIMB = 40  # bits of a part of a sum: long sums of parts can't overflow
_SAFE = 1 << 27  # of components up to here, squared distances of some thousand components fit a long
_MOST = (1 << 63) - 1
_ASSIGNED = "vec_id long, cluster int, distance long, exact int"


class Centroids:
    """Centroids of whole numbers of any size, and their segments' lengths."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.large = max((abs(x) for row in rows for x in row), default=0) >= _SAFE
        self.exact = np.array(rows, object if self.large else np.int64).reshape(len(rows), -1)
        self.norms = segment_norms(self.exact.astype(np.float64))

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, squared distance, number of exact distances) of each row of ``x``.

        Centroids come in the order of their bounds until a bound exceeds the best distance;
        a rounding margin keeps bounds below the truth. Ties go to the smaller number."""
        centres = self.exact
        if self.large or float(np.abs(x).max(initial=0)) >= _SAFE:
            whole = [int(v) for v in x.ravel().tolist()]
            x, centres = np.array(whole, object).reshape(x.shape), centres.astype(object)
        else:
            x = x.astype(np.int64)
        n, k = len(x), len(self.rows)
        low = np.zeros((n, k))
        for s in range(SEGMENTS):
            low += (norms[:, s, None] - self.norms[None, :, s]) ** 2
        low -= 1e-12 * (1 + (norms**2).sum(1)[:, None] + (self.norms**2).sum(1)[None, :])
        order = low.argsort(1)
        bound = np.take_along_axis(low, order, 1)
        best, chosen, count = None, order[:, 0].copy(), np.ones(n, np.int32)
        for rank in range(k):
            if rank == 0:
                best = ((x - centres[chosen]) ** 2).sum(1)
                continue
            open_ = np.flatnonzero(bound[:, rank] <= best.astype(np.float64) * (1 + 1e-12))
            if not len(open_):
                break  # bounds rise with the rank
            other = order[open_, rank]
            d = ((x[open_] - centres[other]) ** 2).sum(1)
            count[open_] += 1
            better = ((d < best[open_]) | ((d == best[open_]) & (other < chosen[open_]))).astype(bool)
            best[open_[better]], chosen[open_[better]] = d[better], other[better]
        return chosen, best, count


def _start(packed: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the least hashes of seed and id; of equal hashes the least
    components first."""

    def run(batches):
        for batch in batches:
            for ids, length, kind, data in zip(*(batch.column(c) for c in ("ids", "length", "kind", "data")), strict=True):
                own = ids.values.to_pylist()
                m = matrix_of(kind.as_py(), data.as_buffer(), len(own)).astype(np.float64)
                hashed = [hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in own]
                few = sorted(range(len(own)), key=lambda i: (hashed[i], m[i].tolist()))[:k]  # of each block
                yield pa.RecordBatch.from_arrays([pa.array([hashed[i] for i in few]), pa.array([m[i].tolist() for i in few], pa.list_(pa.float64()))], ["hash", "x"])

    found = packed.where(F.exists("ids", lambda x: x.isNotNull())).select("ids", "length", "kind", "data").mapInArrow(run, "hash string, x array<double>")
    return [[int(v) for v in r.x] for r in found.orderBy("hash", "x").limit(k).collect()]


def _limbs(value: int) -> list[tuple[int, int]]:
    """Parts of ``value``, the last one signed: sum of part << _LIMB * place."""
    parts, place = [], 0
    while not -(1 << _LIMB) <= value < 1 << _LIMB:
        parts.append((place, value & (1 << _LIMB) - 1))
        value >>= _LIMB
        place += 1
    return [*parts, (place, value)]


def _sums(packed: DataFrame, shared) -> DataFrame:
    """(cluster, at, limb, part): of each cluster its number of vectors (at -1) and the exact
    sum of each component, in parts; each task adds up what it has first."""

    def run(batches):
        centroids = shared.value
        k = len(centroids.rows)
        totals: list = [None] * k
        counts = [0] * k
        for x, norms, _ in _blocks_of(batches):
            chosen, _, _ = centroids.nearest(x, norms)
            large = float(np.abs(x).max(initial=0)) >= _SAFE
            for j in np.unique(chosen).tolist():
                own = x[chosen == j]
                if large:
                    own = np.array([int(v) for v in own.ravel().tolist()], object).reshape(own.shape)
                part = own.sum(0) if large else own.sum(0, dtype=np.int64).astype(object)
                totals[j] = part if totals[j] is None else totals[j] + part
                counts[j] += len(own)
        rows = [(j, -1, *x) for j in range(k) if counts[j] for x in _limbs(counts[j])]
        rows += [(j, at, *x) for j in range(k) if counts[j] for at, v in enumerate(totals[j]) for x in _limbs(int(v))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "at", "limb", "part"])

    return packed.select("ids", "kind", "data", "norms").mapInArrow(run, "cluster int, at int, limb int, part long").groupBy("cluster", "at", "limb").agg(F.sum("part").alias("part"))


def _blocks_of(batches):
    for batch in batches:
        for ids, kind, data, norms in zip(*(batch.column(c) for c in ("ids", "kind", "data", "norms")), strict=True):
            n = len(ids.values)
            yield matrix_of(kind.as_py(), data.as_buffer(), n), np.frombuffer(norms.as_buffer()).reshape(n, SEGMENTS), ids.values


def _moved(rows: list[list[int]], sums: list) -> list[list[int]]:
    """Each centroid that has vectors at the floor of their mean."""
    totals: dict[tuple[int, int], int] = {}
    for r in sums:
        totals[r.cluster, r.at] = totals.get((r.cluster, r.at), 0) + (r.part << _LIMB * r.limb)
    return [[totals[j, at] // totals[j, -1] for at in range(len(row))] if (j, -1) in totals else row for j, row in enumerate(rows)]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, length: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, exact) of each vector, and the final centroids.

    Vectors (vec_id, embedding) of exactly ``length`` components, none null or non-finite, become
    whole numbers floor(scale * x). The first centroids are the ``k`` vectors (all, if there are
    fewer) whose ids have the least hashes with ``seed``; each round assigns all vectors to the
    nearest (ties: the smaller number) and replaces each centroid that has any by the floor of
    their mean; in the end they are assigned once more. ``exact`` tells how many exact
    distances the bounds left. A squared distance that a long can't hold becomes its greatest.

    Rows that repeat an id are vectors each; a null id is one too, but never a first centroid.
    Other columns don't matter; no vectors give no rows and no centroids. To the driver come k x length
    sums a round. The result is written to the shared folder."""
    spark = vectors.sparkSession
    with passing_folders(spark):
        packed = blocks(vectors.select("vec_id", "embedding"), scale, length)
        rows = _start(packed, k, seed)
        if not rows:
            return spark.createDataFrame([], _ASSIGNED), []
        for _ in range(rounds):
            rows = _moved(rows, _sums(packed, spark.sparkContext.broadcast(Centroids(rows))).collect())
        shared = spark.sparkContext.broadcast(Centroids(rows))

        def run(batches):
            for x, norms, ids in _blocks_of(batches):
                chosen, best, count = shared.value.nearest(x, norms)
                best = np.minimum(best, _MOST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(chosen.astype(np.int32)), pa.array(best), pa.array(count)], ["vec_id", "cluster", "distance", "exact"])

        return kept(packed.select("ids", "kind", "data", "norms").mapInArrow(run, _ASSIGNED)), rows


def op12_centroid_clusters(spark, sf_dir) -> DataFrame:
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # one row a centroid
    of, whole = {r.cluster: min(int(r.total), _MOST) for r in sums}, min(sum(int(r.total) for r in sums), _MOST)
    rows = [(j, of.get(j, 0), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Three rounds over (n, pos, x), a row for each component."""
    assign = """a{r} AS MATERIALIZED (
  SELECT n, any_value(vec_id) AS vec_id, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
    SELECT v.n, any_value(v.vec_id) AS vec_id, c.j, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c USING (pos) GROUP BY v.n, c.j) GROUP BY n)"""
    move = """m{r} AS MATERIALIZED (SELECT j, pos, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (n) GROUP BY j, pos),
c{t} AS MATERIALIZED (SELECT c.j, c.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (j, pos))"""
    steps = ",\n".join(f"{assign.format(r=r)},\n{move.format(r=r, t=r + 1)}" for r in range(3))
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), v AS MATERIALIZED (SELECT n, vec_id, unnest(range(1, 65)) AS pos, unnest(e) AS x FROM k),
f AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS j FROM k WHERE vec_id IS NOT NULL QUALIFY j < 16),
c0 AS MATERIALIZED (SELECT j, pos, x FROM v JOIN f USING (n)),
{steps},
{assign.format(r=3)},
h AS (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c3 GROUP BY j)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN h USING (j)
"""


OP12_SQL = _sql()
