"""Top-k search and clustering of vectors against plain versions."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from veridat.llm import op11_topk, op12_centroids, vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def rows_of(number, length=64, seed=7, size=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, size / 8) for _ in range(length)], 0) for i in range(number)]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floored(v):
    return [math.floor(64 * x) for x in v]


def plain_top(rows, k=20, every=20):
    own = [(i, floored(v)) for i, v, *_ in rows if usable(v)]
    out = []
    for n, (q, a) in enumerate(own):
        if q is None or q % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c is None, c or 0) for m, (c, b) in enumerate(own) if m != n)[:k]
        out += [(q, r, None if none else c, -s) for r, (s, none, c) in enumerate(found, 1)]
    return out


def top(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return [tuple(r) for r in op11_topk.search(df, **more).select("query_id", "rank", "vec_id", "score").collect()]


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


HARD = [
    (0, None, 1), (20, [1.0, None], 1), (40, [float("nan")] * 3, 1), (60, [float("inf")], 1), (80, [], 1), (100, [0.5, -0.5, 2.0], 1), (None, [0.5] * 4, 1), (None, [0.5] * 4, 1),
    (100, [0.5, -0.5, 2.0], 1), (7, [0.5, -0.5, 2.0], 1), (-20, [-1.0, 1e-9], 1), (9, [3.0], 1), (9, [3.0], 1),
]


@pytest.mark.parametrize("dealt", [False, True])
def test_search_equals_a_plain_search(spark, monkeypatch, dealt):
    monkeypatch.setattr(op11_topk, "QUERIES", 4)
    if dealt:
        monkeypatch.setattr(op11_topk, "MOST_BYTES", 0)
        monkeypatch.setattr(op11_topk, "GROUP", 2)
        monkeypatch.setattr(vectors, "BLOCK", 50)
    rows = rows_of(300)
    same(top(spark, rows), plain_top(rows))


def test_search_with_many_ties_and_copies(spark, monkeypatch):
    """A third of all rows are equal, so the kth score ties beyond any bin of scores."""
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rows = rows_of(300, 8)
    rows = [(i * 10**12, rows[0][1] if i % 3 == 0 else v, 0) for i, v, _ in rows]
    same(top(spark, rows, k=5), plain_top(rows, 5))
    many = rows_of(30, 4) + [(3, [0.9] * 4, 0)] * 120 + [(None, [0.9] * 4, 0)] * 50  # one id, again and again
    same(top(spark, many, k=5), plain_top(many, 5))


def test_search_of_odd_rows(spark):
    same(top(spark, HARD, k=3), plain_top(HARD, 3))
    same(top(spark, HARD, k=50), plain_top(HARD, 50))
    assert top(spark, []) == [] and top(spark, [(1, [1.0], 0)]) == [] and top(spark, [(0, [1.0], 0)]) == []


@pytest.mark.parametrize("size", [1e4, 1e7])
def test_search_of_large_numbers(spark, size):
    """Scores beyond what single and double precision hold exactly."""
    rows = rows_of(60, 8, size=size)
    same(top(spark, rows, k=7), plain_top(rows, 7))


def plain_clusters(rows, k=16, rounds=3, length=64):
    own = [(i, floored(v)) for i, v, *_ in rows if usable(v) and len(v) == length]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in own if i is not None)[:k]
    centres = [v for _, v in first]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in own:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centres)]
    return [(i, near(v)[1], min(near(v)[0], 2**63 - 1)) for i, v in own], centres


@pytest.mark.parametrize(("rows", "length"), [(rows_of(400), 64), (rows_of(30, 3), 3), (rows_of(9), 64), (rows_of(60, 5, size=1e9), 5), (HARD * 2, 3), (rows_of(5, 2) * 20, 2), (rows_of(40, 1, size=0.1), 1), ([], 64)])
def test_clusters_equal_plain_ones(spark, rows, length):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("clash")).repartition(3)
    found, centres = op12_centroids.cluster(df, length=length)
    want, plain = plain_clusters(rows, length=length)
    assert centres == plain
    same([tuple(r) for r in found.select("vec_id", "cluster", "distance").collect()], want)


def test_bounds_prune_and_keep_the_nearest(spark):
    """Vectors that lie in one segment each: most centroids need no exact distance."""
    rows = [(i, [9 * x if n // 8 == i % 8 else x / 9 for n, x in enumerate(v)], 0) for i, v, _ in rows_of(320)]
    found, _ = op12_centroids.cluster(spark.createDataFrame(rows, SCHEMA))
    assert found.agg(F.avg("exact")).first()[0] < 9
    want, _ = plain_clusters(rows)
    same([tuple(r) for r in found.select("vec_id", "cluster", "distance").collect()], want)


def test_sums_in_parts():
    for v in (0, 1, -1, 1 << 40, -(1 << 40) - 1, 3**90, -(3**90)):
        assert sum(part << op12_centroids._LIMB * place for place, part in op12_centroids._limbs(v)) == v
        assert all(-(1 << 40) <= part < 1 << 40 for _, part in op12_centroids._limbs(v))
