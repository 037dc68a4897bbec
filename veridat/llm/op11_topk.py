"""Exact top-k search by distributed histogram selection.

Every query is scored against every row. Its kth best score is located by histograms: each
round counts the scores of all rows in bins of the range at hand, the sums say which bin
holds the kth best, and that bin is the next round's range. Where too many rows tie at the
kth score, the same search goes on over their ids. Then only rows up to what was located are
sent on, ordered and cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, passing_folders, written
from .vectors import BLOCK_BITS, blocks, kind_of, matrix_of

BINS = 256
QUERIES = 1024  # of a block of queries, about
ENOUGH = 4  # a bin is searched no further when up to so many times k rows are within it or above
MOST_BYTES = 64 << 20  # of query blocks sent to all executors; dealt by key beyond
GROUP = 64  # blocks that one block of queries meets in one place, where it is dealt
_SCORE, _TIE, _DONE = 0, 1, 2
_TOP = np.uint64(1 << 63)
_MOST = (1 << 63) - 1
_EVERY = ~np.uint64(0)
# of a query: its id and place; the range of keys of scores, then of ids, that is searched, in bins of a width; how many rows come before it
_STATE = np.dtype([("query", "i8"), ("home", "i8"), ("place", "i4"), ("stage", "i4"), ("before", "i8"), ("low", "u8"), ("end", "u8"), ("width", "u8"), ("id_low", "u8"), ("id_end", "u8"), ("id_width", "u8")])
_BLOCKS = "qblock int, active int, kind string, data binary, most double, state binary"
_FOUND = "qblock int, query int, bin int, n long"


def _order_of_scores(score: np.ndarray) -> np.ndarray:
    """Unsigned keys that rise as scores fall."""
    return ~(score.astype(np.int64).view(np.uint64) ^ _TOP)


def _score_at(key: np.ndarray) -> np.ndarray:
    return (~key ^ _TOP).view(np.int64)


def _order_of_ids(ids: pa.Array) -> np.ndarray:
    """Unsigned keys that rise with ids; a null one comes last."""
    key = ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64) ^ _TOP
    return np.where(ids.is_null().to_numpy(zero_copy_only=False).astype(bool), _EVERY, key)


def _scores(q: np.ndarray, c: np.ndarray, most: float) -> np.ndarray:
    """Inner products, exact: ``most`` bounds them and says which type holds them all. Of
    vectors of unequal length the shorter counts as filled with zeros; what a long can't hold
    becomes its greatest or least value but one."""
    size = min(q.shape[1], c.shape[1])
    q, c = q[:, :size], c[:, :size]
    if most < 1 << 24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    if most < 1 << 52:
        return q.astype(np.float64) @ c.astype(np.float64).T
    whole = lambda m: np.array([int(x) for x in m.ravel().tolist()], object).reshape(m.shape)
    return np.clip(whole(q).dot(whole(c).T) if size else np.zeros((len(q), len(c)), object), -_MOST, _MOST).astype(np.int64)


def _met(pair: dict) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of one block of rows and one of queries: state, scores, ids. A query has less than any
    score with its own row."""
    state = np.frombuffer(pair["q_state"], _STATE)
    q = matrix_of(pair["q_kind"], pair["q_data"], len(state))
    score = _scores(q, matrix_of(pair["kind"], pair["data"], len(pair["ids"])), pair["q_most"] * pair["most"] * 1.001 + 1)
    own = np.flatnonzero(state["home"] == pair["block"])
    score[own, state["place"][own]] = _none(score)
    return state, score, pair["ids"]


def _none(score: np.ndarray):
    return -np.inf if score.dtype.kind == "f" else -_MOST - 1


def _as_scores(bound: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Bounds of scores in the type of the scores, which holds all that lie between."""
    top = {"f4": 1 << 24, "f8": 1 << 53}.get(kind.str[1:], _MOST)
    return np.clip(bound, -top, top).astype(kind)[:, None]


def _by_score(state: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, bin) of the scores that queries of the score stage may need."""
    at = np.flatnonzero(state["stage"] == _SCORE)
    s, own = score[at], state[at]
    if not s.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    high, low = _score_at(own["low"]), _score_at(own["end"])
    s = np.where((s <= _as_scores(high, s.dtype)) & (s >= _as_scores(low, s.dtype)), s, _none(s))
    if s.shape[1] > k:
        # what lies beyond the bin of the block's own kth score can't be needed
        best = np.sort(np.partition(s, s.shape[1] - k, axis=1)[:, -k:], axis=1)
        edge = best[np.arange(len(at)), own["before"]]
        full = edge > _none(s)
        key = _order_of_scores(np.where(full, edge, 0))
        beyond = np.minimum(((key - own["low"]) // own["width"] + np.uint64(1)) * own["width"] - np.uint64(1), own["end"] - own["low"])
        low = np.where(full, _score_at(own["low"] + beyond), low)
    i, j = np.nonzero(s >= _as_scores(low, s.dtype))
    key = _order_of_scores(s[i, j])
    return at[i], ((key - own["low"][i]) // own["width"][i]).astype(np.int64)


def _by_id(state: np.ndarray, score: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(query, bin) of the rows that tie at the kth score of queries of the tie stage."""
    at = np.flatnonzero(state["stage"] == _TIE)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = state[at]
    i, j = np.nonzero(score[at] == _as_scores(_score_at(own["end"]), score.dtype))
    key = _order_of_ids(ids)[j]
    i, key = (x[(key >= own["id_low"][i]) & (key <= own["id_end"][i])] for x in (i, key))
    return at[i], ((key - own["id_low"][i]) // own["id_width"][i]).astype(np.int64)


def _summed(query: np.ndarray, bins: np.ndarray, n: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (query, bin) with summed counts; of each query only those bins before which
    it hasn't ``need`` rows yet, as the bin of the kth row is among them."""
    key, at = np.unique(query * BINS + bins, return_inverse=True)
    n = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
    query, bins = key // BINS, key % BINS
    if len(key):
        before = np.cumsum(n) - n
        first = np.concatenate([[0], np.flatnonzero(np.diff(query)) + 1])
        before -= np.repeat(before[first], np.diff(np.append(first, len(query))))
        query, bins, n = (x[before < need[query]] for x in (query, bins, n))
    return query, bins, n


def _rows(batches):
    """Pairs of blocks one by one, their bytes not copied."""
    plain = {"block", "kind", "most", "q_qblock", "q_kind", "q_most"}
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() if name in plain else column[i].values if name == "ids" else column[i].as_buffer() for name, column in zip(batch.schema.names, batch.columns, strict=True) if name != "salt"}


def _pairs(rows: DataFrame, queries: DataFrame, number: int) -> DataFrame:
    """Each block of rows with each block of queries, which are numbered below ``number``: a
    stated query set against all rows, in blocks. Up to MOST_BYTES of queries are sent to all
    executors, so rows stay where they are; beyond, each block of queries goes to a place for
    each group of blocks of rows."""
    q = queries.drop("active").withColumnsRenamed({c: f"q_{c}" for c in queries.columns})
    named = rows.select("block", "ids", "kind", "data", "most", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("q_qblock"))
    size = queries.agg(F.sum(F.octet_length("data") + F.octet_length("state"))).first()[0] or 0
    if size <= MOST_BYTES:
        return named.join(F.broadcast(q), "q_qblock")
    groups = -(-rows.count() // GROUP)
    dealt = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return named.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).join(dealt.hint("shuffle_hash"), ["q_qblock", "salt"])


def _counts(pairs: DataFrame, k: int) -> DataFrame:
    """(qblock, query, bin, n) of one round: every row is scored and counted."""

    def run(batches):
        held: dict[int, tuple] = {}

        def out(number: int) -> pa.RecordBatch:
            query, bins, n = held.pop(number)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(query), number, np.int32)), pa.array(query.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(n)], ["qblock", "query", "bin", "n"])

        for pair in _rows(batches):
            state, score, ids = _met(pair)
            query, bins = (np.concatenate(x) for x in zip(_by_score(state, score, k), _by_id(state, score, ids), strict=True))
            n = np.ones(len(query), np.int64)
            number = pair["q_qblock"]
            if number in held:
                query, bins, n = (np.concatenate(x) for x in zip(held[number], (query, bins, n), strict=True))
            held[number] = _summed(query, bins, n, k - state["before"])
            if sum(len(x[0]) for x in held.values()) > 2_000_000:
                for each in list(held):
                    yield out(each)
        for each in list(held):
            yield out(each)

    return pairs.mapInArrow(run, _FOUND).groupBy("qblock", "query", "bin").agg(F.sum("n").alias("n"))


def _narrow(s: np.void, bins: np.ndarray, n: np.ndarray, k: int, least_id: int, most_id: int) -> None:
    """Moves the range of one query to the bin that holds its kth row."""
    total, need = np.cumsum(n), k - int(s["before"])
    if not len(total) or total[-1] < need:  # fewer rows than are asked for: all are in
        s["stage"] = _DONE
        return
    at = int(np.searchsorted(total, need))
    s["before"] += int(total[at] - n[at])
    few = int(s["before"] + n[at]) <= ENOUGH * k
    low, end, width = ("id_low", "id_end", "id_width") if s["stage"] == _TIE else ("low", "end", "width")
    first = int(s[low]) + int(bins[at]) * int(s[width])
    last = min(first + int(s[width]) - 1, int(s[end]))
    s[low], s[end], s[width] = first, last, -(-(last - first + 1) // BINS)
    if few or (first == last and s["stage"] == _TIE):
        s["stage"] = _DONE
    elif first == last:  # too many rows of one score
        s["stage"], s["id_low"], s["id_end"], s["id_width"] = _TIE, least_id, most_id, -(-(most_id - least_id + 1) // BINS)


def _narrowed(queries: DataFrame, counts: DataFrame, k: int, least_id: int, most_id: int) -> DataFrame:
    """The query blocks with the ranges of the next round; a block has some thousand queries
    and BINS counts for each at most."""

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        state = np.frombuffer(left["state"][0].as_py(), _STATE).copy()
        query, bins, n = (right[c].to_numpy().astype(np.int64) for c in ("query", "bin", "n"))
        order = np.lexsort((bins, query))
        bounds = np.searchsorted(query[order], np.arange(len(state) + 1))
        for i in np.flatnonzero(state["stage"] != _DONE):
            own = order[bounds[i] : bounds[i + 1]]
            _narrow(state[i], bins[own], n[own], k, least_id, most_id)
        active = int((state["stage"] != _DONE).sum())
        new = {"active": pa.array([active], pa.int32()), "state": pa.array([state.tobytes()], pa.binary())}
        return pa.table([new.get(c, left[c]) for c in left.schema.names], left.schema.names)

    return written(queries.groupBy("qblock").cogroup(counts.groupBy("qblock")).applyInArrow(step, _BLOCKS), "queries")


def _query_blocks(rows: DataFrame, every: int, number: int, bound: int) -> DataFrame:
    """The vectors whose id ``every`` divides, in ``number`` blocks, with the range of all scores."""

    def chosen(batches):
        for batch in batches:
            for block, ids, kind, data in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("block", "ids", "kind", "data")), strict=True):
                own = np.flatnonzero(pc.equal(_remainder(ids.values, every), 0).fill_null(False).to_numpy(zero_copy_only=False))
                m = matrix_of(kind.as_py(), data.as_buffer(), len(ids.values))[own].astype(np.float64)
                if len(own):
                    yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(own)), pa.array(np.full(len(own), block.as_py())), pa.array(own.astype(np.int32)), pa.array([x.tobytes() for x in m], pa.binary())], ["query", "home", "place", "data"])

    def packed(found: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x) for x in found["data"].to_pylist()]
        m = np.zeros((len(parts), max(map(len, parts))))
        for row, x in zip(m, parts, strict=True):
            row[: len(x)] = x
        state = np.zeros(len(parts), _STATE)
        for c in ("query", "home", "place"):
            state[c] = found[c].to_numpy()
        ends = _order_of_scores(np.array([bound, -bound]))
        state["low"], state["end"], state["width"], state["id_end"] = ends[0], ends[1], -(-(2 * bound + 1) // BINS), _EVERY
        kind = kind_of(m)
        most = float(np.sqrt((m**2).sum(1)).max())
        return pa.table([pa.array([found["qblock"][0].as_py()], pa.int32()), pa.array([len(parts)], pa.int32()), pa.array([kind]), pa.array([m.astype(kind).tobytes()], pa.binary()), pa.array([most]), pa.array([state.tobytes()], pa.binary())], [x.split()[0] for x in _BLOCKS.split(", ")])

    found = rows.select("block", "ids", "kind", "data").mapInArrow(chosen, "query long, home long, place int, data binary")
    dealt = found.withColumn("qblock", F.pmod(F.xxhash64("home", "place"), F.lit(number)).cast("int"))
    return written(dealt.groupBy("qblock").applyInArrow(packed, _BLOCKS), "queries")


def _remainder(ids: pa.Array, every: int) -> pa.Array:
    return pc.subtract(ids, pc.multiply(pc.divide(ids, every), every))


def _located(pairs: DataFrame) -> DataFrame:
    """(row, query_id, score, vec_id, times): what lies within the ranges that were located."""

    def run(batches):
        for pair in _rows(batches):
            state, score, ids = _met(pair)
            edge = _as_scores(_score_at(state["end"]), score.dtype)
            i, j = np.nonzero(score >= edge)
            found = score[i, j].astype(np.int64)
            key = _order_of_ids(ids)[j]
            kept_ = (found > _score_at(state["end"])[i]) | (key <= state["id_end"][i])
            i, j, found, key = i[kept_], j[kept_], found[kept_], key[kept_]
            if not len(i):
                continue
            order = np.lexsort((key, found, i))
            i, j, found, key = i[order], j[order], found[order], key[order]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (found[1:] != found[:-1]) | (key[1:] != key[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(i)))
            i, j = i[first], j[first]
            row = (state["home"][i] << BLOCK_BITS) | state["place"][i]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(state["query"][i]), pa.array(found[first]), ids.take(pa.array(j)), pa.array(times)], ["row", "query_id", "score", "vec_id", "times"])

    return pairs.mapInArrow(run, "row long, query_id long, score long, vec_id long, times long")


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query, a row of ``vectors`` (vec_id, embedding)
    whose vec_id ``every`` divides, the ``k`` rows of highest score but its own (all, if there
    are fewer); of equal scores the smaller vec_id first, null ones last.

    The score is the inner product of the vectors' whole numbers floor(scale * x); of vectors of
    unequal length the shorter counts as filled with zeros. Vectors that are null or hold null
    or non-finite components take no part. Rows that repeat an id are rows each, as queries
    and as candidates; a null id is no query. Other columns don't matter, and no query gives
    no rows. The result is written to the shared folder."""
    spark = vectors.sparkSession
    with passing_folders(spark):
        rows = blocks(vectors.select("vec_id", "embedding"), scale)
        divided = F.aggregate("ids", F.lit(0).cast("long"), lambda n, x: n + F.when(x % every == 0, 1).otherwise(0))
        queries, most, least_id, most_id, unnamed = rows.agg(F.sum(divided), F.max("most"), F.min("least_id"), F.max("most_id"), F.max(F.exists("ids", lambda x: x.isNull()))).first()
        if not queries:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        bound = min(_MOST, int(most * most * 1.001) + 1)
        least_id, most_id = least_id + (1 << 63), int(_EVERY) if unnamed else most_id + (1 << 63)
        number = -(-queries // QUERIES)
        asked = _query_blocks(rows, every, number, bound)
        while not (active := asked.where("active > 0")).isEmpty():
            asked = _narrowed(asked, _counts(_pairs(rows, active, number), k), k, least_id, most_id)
        found = _located(_pairs(rows, asked, number))
        order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        reached = found.withColumn("upto", F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") - F.col("times") < k)
        ranks = F.explode(F.sequence(F.col("upto") - F.col("times") + 1, F.least("upto", F.lit(k).cast("long"))))
        return kept(reached.select("query_id", ranks.alias("rank"), "vec_id", "score").withColumn("rank", F.col("rank").cast("int")))


def op11_exact_topk(spark, sf_dir) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.n AS n, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) <= 20
"""
