"""Columns of op6 that several sets have are counted over all partitions, and come behind the others."""

import numpy as np

from veridat.llm import op6_jaccard
from veridat.llm.common import signed


def test_marks_are_counted_over_all_blobs(spark):
    rng = np.random.default_rng(41)
    parts = [np.concatenate([rng.zipf(1.5, 4000) % 5000 * 777_777, rng.integers(0, 2**32, 4000)]).astype(np.uint32) for _ in range(6)]
    blobs = [(int(b), blob) for part in parts for b, _, blob in zip(*op6_jaccard._packed(part), strict=True)]
    df = spark.createDataFrame(blobs, "bucket long, marks binary").repartition(3)
    mark, n = np.unique(np.concatenate(parts), return_counts=True)
    often = n >= op6_jaccard.REPEATED
    assert sorted(map(tuple, op6_jaccard._repeated(df).collect())) == list(zip(mark[often].tolist(), n[often].tolist(), strict=True))


def test_the_most_repeated_ones_are_known(spark, monkeypatch):
    rows = [(i, 5 + i % 4) for i in range(40)]
    repeated = spark.createDataFrame(rows, "mark long, n long")
    for most, least in ((100, 5), (39, 6), (20, 7), (19, 8), (9, None)):
        monkeypatch.setattr(op6_jaccard, "MOST_HOT", most)
        want = [r for r in rows if least and r[1] >= least]
        assert list(zip(*(x.tolist() for x in op6_jaccard._most_repeated(repeated)), strict=True)) == want


def test_first_columns_are_those_that_few_have():
    rng = np.random.default_rng(42)
    gram = np.sort(rng.integers(0, 2**64, 400, dtype=np.uint64))
    low = gram[signed(gram) >= 0]
    shared = np.sort(rng.permutation(low)[:100])
    _, key = op6_jaccard._block_keys(np.array([0, 400]), gram, 85, np.zeros(0, np.int64), None, op6_jaccard._marks(shared), np.full(100, 9))
    kept = np.setdiff1d(gram, shared)[:61]  # 400 - 340 + 1 in the order of hashes
    assert set(key.tolist()) == set(signed(op6_jaccard.mix(kept)).tolist())


def test_unlike_texts_that_share_passages_are_not_compared(spark, monkeypatch):
    """Six texts share each passage, one in each partition; all pairs of them were compared."""
    asked, plain = [], op6_jaccard._verifier

    def verifier(*args):
        verify = plain(*args)

        def counted(pairs):
            asked.append(pairs.count())
            return verify(pairs)

        return counted

    monkeypatch.setattr(op6_jaccard, "_verifier", verifier)
    passage = [" ".join(f"p{g}w{j}" for j in range(40)) for g in range(20)]
    rows = [(100 * i + g, f"{passage[g]} " + " ".join(f"d{i}g{g}w{j}" for j in range(160))) for i in range(6) for g in range(20)]
    rows += [(1000 + g, f"{rows[100 + g][1]} more") for g in range(10)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in op6_jaccard.link_classes(docs).collect()}
    assert found == {i: i if i < 1000 else 500 + i - 1000 for i, _ in rows}
    assert sum(asked) < 30, asked
