"""Which columns of op6 are frequent, and what a task holds in Python to find them."""

import tracemalloc

import numpy as np
import pyarrow as pa

from veridat.llm import op6_jaccard
from veridat.llm.common import flat, signed


class Seen:
    def mapInArrow(self, run, schema):
        self.run = run


def test_a_task_of_the_first_scan_holds_no_more_with_more_texts():
    rng, passage = np.random.default_rng(34), "one passage that stands in each of these texts"

    def batches(number):
        for i in range(number):
            text = rng.integers(97, 123, 1 << 20, dtype=np.uint8)
            text[3::4] = 32
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([f"{text.tobytes().decode()}{passage}"]), pa.array([i]), pa.array([i])], ["rid", "text", "doc_id", "content"])

    wanted = set(signed(op6_jaccard.shingle_sets(flat(pa.array([passage])), 4)[1]).tolist())
    op6_jaccard._first_scan(seen := Seen(), 4, 0)
    peaks = []
    for number in (8, 24):
        rows, found = 0, {}
        tracemalloc.start()
        try:
            for out in seen.run(batches(number)):
                kind, key, n = (out.column(i).to_numpy() for i in (0, 5, 4))
                rows += np.count_nonzero(kind == 0)
                found |= dict(zip(key[kind == 1].tolist(), n[kind == 1].tolist(), strict=True))
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
        assert rows == number and set(found) >= wanted and all(found[k] >= number for k in wanted)
    assert len(found) < 2 * len(wanted)
    assert peaks[1] < 1.2 * peaks[0] and peaks[1] < 150e6, peaks


def test_no_frequent_key_is_missed(monkeypatch):
    monkeypatch.setattr(op6_jaccard, "MOST_HOT", 100)
    monkeypatch.setattr(op6_jaccard, "SKETCH", 1 << 10)
    rng = np.random.default_rng(35)
    often, every = op6_jaccard.Often(), []
    for turn in range(60):
        # some keys are frequent only early, some only late
        part = np.concatenate([rng.zipf(1.3, 800) + 1_000_000 * (turn // 20), rng.integers(-(2**62), 2**62, 400)])
        every.append(part)
        often.add(*np.unique(part, return_counts=True))
    keys, n = np.unique(np.concatenate(every), return_counts=True)
    frequent = dict(zip(*(x[n * 100 >= n.sum()].tolist() for x in (keys, n)), strict=True))
    found = dict(zip(*(x.tolist() for x in often.found()), strict=True))
    assert len(frequent) >= 10 and all(found[k] >= m for k, m in frequent.items()) and len(found) <= 100
