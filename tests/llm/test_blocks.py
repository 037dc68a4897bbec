"""Blocks of op6 are cut by sizes and places, and lose no link by it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridat.llm import op6_jaccard


def blocks_of(spark, sets, percent, hot=np.zeros(0, np.int64)):
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    doc, key = op6_jaccard._block_keys(bounds, np.concatenate(sets), percent, hot, np.full(len(hot), 5))
    place = op6_jaccard._places(doc, key, np.diff(bounds), percent)
    return spark.createDataFrame(list(zip(place.tolist(), doc.tolist(), strict=True)), "place long, digest long")


@pytest.mark.parametrize("percent", [60, 85])
def test_cut_blocks_hold_every_link_within_bounds(spark, percent):
    rng = np.random.default_rng(36)
    base = [np.unique(rng.integers(1, 2**63, n, dtype=np.uint64)) for n in (1, 2, 3, 7, 40, 250, 900)]
    sets = []
    for b in base:
        for _ in range(14):
            less = rng.permutation(b)[: max(1, len(b) - rng.integers(0, len(b) // 16 + 2))]
            sets.append(np.unique(np.concatenate([less, rng.integers(1, 2**63, rng.integers(0, len(b) // 16 + 2), dtype=np.uint64)])))
    common = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    links = {(a, b) for b in range(len(sets)) for a in range(b) if not np.array_equal(sets[a], sets[b]) and 100 * common(a, b) >= percent * (len(sets[a]) + len(sets[b]) - common(a, b))}
    hot = np.sort(rng.permutation(np.concatenate(base))[:200].view(np.int64))
    members = op6_jaccard._members(blocks_of(spark, sets, percent, hot).union(blocks_of(spark, sets[:30], percent, hot)))
    a, b = members.alias("a"), members.alias("b")
    met = {tuple(r) for r in a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.digest") < F.col("b.digest")) & op6_jaccard._within("a.", "b.")).select("a.digest", "b.digest").distinct().collect()}
    assert len(links) > 100 and links <= met


def test_codes_of_sizes_never_fall():
    code = op6_jaccard._places(np.arange(5000), np.zeros(5000, np.int64), np.arange(1, 5001), 85) >> op6_jaccard.CODE
    assert (np.diff(code) >= 0).all() and len(op6_jaccard.SIZE_STEPS) < 1 << op6_jaccard.CODE


def test_texts_of_unlike_sizes_that_share_a_passage_arent_compared(docs_of, monkeypatch):
    """All share eight words; no two have sizes that let them link, but for one pair."""
    asked, plain = [], op6_jaccard._verifier

    def verifier(*args):
        verify = plain(*args)

        def counted(pairs):
            asked.append(pairs.count())
            return verify(pairs)

        return counted

    monkeypatch.setattr(op6_jaccard, "_verifier", verifier)
    shared = "one passage that stands in all these texts"
    texts = [f"{shared} " + " ".join(f"d{i}w{j}" for j in range(int(10 * 1.5**i))) for i in range(14)]
    docs = docs_of([*enumerate(texts), (99, f"{texts[9]} more")])
    found = {r.doc_id: r.component_id for r in op6_jaccard.link_classes(docs).collect()}
    assert found == {i: i for i in range(14)} | {99: 9}
    assert sum(asked) == 1
