"""The blocked product: overlaps, tiles, leaders, and rows that come from a join."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridat.llm import graph, op4_lm_score, op6_jaccard, op7_quality
from veridat.llm.common import word_hash

from test_corpus import _components, prose


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_confuse_stay_apart(docs_of, n):
    a, b = thue_morse(n)
    assert len(set(word_hash([a, b]).tolist())) == 2
    docs = docs_of([(1, a), (2, b), (3, f"{a}\n{b}"), (4, f"{a} one two three"), (5, f"{b} one two three")])
    assert [r.component_id for r in op6_jaccard.link_classes(docs).orderBy("doc_id").collect()] == [1, 2, 3, 4, 5]
    assert all(r.n_dup_lines == 0 for r in op7_quality.judge(docs).collect())
    known = {r.doc_id: r.n_known for r in op4_lm_score.score(docs, docs.where("doc_id = 1")).collect()}
    assert known == {1: 2, 2: 1, 3: 2, 4: 2, 5: 1}


def test_overlaps_equal_sets():
    rng = np.random.default_rng(31)
    rows = [np.unique(rng.integers(-30, 30, rng.integers(1, 90))) for _ in range(60)]
    digest = rng.permutation(1000)[:60] - 500
    a, b = (x.ravel() for x in np.triu_indices(60, 1))
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([rng.permutation(r) for r in rows])))
    for percent, chunk in ((30, 1 << 21), (45, 64)):
        got = op6_jaccard.overlapping(digest, lists, digest[a], digest[b], percent, chunk)
        want = [100 * len(np.intersect1d(rows[i], rows[j])) >= percent * len(np.union1d(rows[i], rows[j])) for i, j in zip(a, b, strict=True)]
        assert got.tolist() == want and any(want) and not all(want)


@pytest.mark.parametrize("percent", [80, 85])
def test_blocks_are_few_and_lose_no_link(percent):
    """A set of n is in no more blocks than the columns that a linking one may lack, and one."""
    rng = np.random.default_rng(33)
    linked = 0
    for _ in range(300):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        new = lambda most: rng.integers(1, 2**63, rng.integers(0, most), dtype=np.uint64)
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, len(a) - rng.integers(0, n // 8 + 2))], new(n // 8 + 2)]))
        hot = np.sort(rng.permutation(a)[: int(rng.choice([0, 0.5, 1]) * len(a))].view(np.int64))
        doc, key = op6_jaccard._block_keys(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]), percent, hot, rng.integers(2, 9, len(hot)))
        assert all(np.count_nonzero(doc == i) <= (100 - percent) * len(x) // 100 + 1 for i, x in enumerate((a, b)))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (len(a) + len(b) - common):
            assert set(key[doc == 0]) & set(key[doc == 1])
            linked += 1
    assert 100 < linked < 300


def group_texts(rng, words=80):
    """A large group of near copies around each base, some texts that share long passages, copies."""
    vocabulary = [f"v{i}" for i in range(400)]
    passage = prose(rng, vocabulary, 45)
    texts = []
    for _ in range(4):
        base = prose(rng, vocabulary, words).split()
        for _ in range(35):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [f"{passage} {prose(rng, vocabulary, 25)}" for _ in range(60)]
    return texts + rng.sample(texts, 30)


@pytest.mark.parametrize(("tile", "few", "share"), [(4, 0, 0.9), (7, graph.FEW, 0.0)])
def test_small_tiles_and_many_leaders(docs_of, monkeypatch, tile, few, share):
    monkeypatch.setattr(op6_jaccard, "TILE", tile)
    monkeypatch.setattr(op6_jaccard, "LARGE", 1)
    monkeypatch.setattr(op6_jaccard, "WORTH", share)
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(32)
    docs = docs_of([(i if i % 9 else None, t) for i, t in enumerate(group_texts(rng))])
    want, groups = _components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(repr, map(tuple, op6_jaccard.link_classes(docs).collect()))) == sorted(map(repr, want))
    assert op6_jaccard.one_of_each(docs).count() == groups


def test_equal_numbers_of_unequal_sets_are_told_apart(docs_of, monkeypatch):
    plain = op6_jaccard.digests

    def clash(bounds, gram, seed=0):
        first, second = plain(bounds, gram, seed)
        return (first % 2 if seed == 0 else first), second

    monkeypatch.setattr(op6_jaccard, "digests", clash)
    docs = docs_of([(i, f"w{i // 2} x y z") for i in range(10)])
    assert sorted((r.doc_id, r.component_id) for r in op6_jaccard.link_classes(docs).collect()) == [(i, i - i % 2) for i in range(10)]


def test_one_of_each_of_rows_from_a_join(spark):
    number = 600
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(2 * number).select(F.col("id").alias("doc_id"), F.lit("clash").alias("row"), F.lit("clash").alias("__row"))
        texts = spark.range(2 * number).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(x), F.col("id") % number) for x in "abcdefg"]).alias("text"))
        docs = ids.join(texts, "doc_id")
        left = op6_jaccard.one_of_each(docs)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.select("doc_id").collect()) == list(range(number))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
