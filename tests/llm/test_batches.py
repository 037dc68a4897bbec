"""How much text reaches Python at once in the pipeline."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.mark.parametrize("stage", ["quality", "deduplicate"])
def test_batches_follow_the_length_of_texts(spark, docs_of, tmp_path, stage):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    try:
        getattr(corpus_pipeline, stage)(spark, docs_of([(1, "a text")]), str(tmp_path))
        texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 1500).alias("text"))
        sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
        assert sum(r.n for r in sizes) == 4000 and max(r.size for r in sizes) < 6 << 20
    finally:
        spark.conf.unset(name)
