"""What a task of op4's counts holds in Python."""

import tracemalloc

import numpy as np
import pyarrow as pa

from veridat.llm import op4_lm_score


def test_counts_of_a_large_batch_are_merged_by_slices(spark):
    class Seen:
        def __getattr__(self, name):
            return lambda *args: self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    seen = Seen()
    op4_lm_score.corpus_counts(seen)
    texts = np.random.default_rng(3).integers(97, 123, (12, 1 << 20), dtype=np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes().decode() for t in texts])], ["text"])
    found = 0
    tracemalloc.start()
    try:
        for out in seen.run([batch]):
            found += int(out.column(2).to_numpy()[out.column(0).to_numpy() == 1].sum())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == texts.size + len(texts) and peak < 350e6
