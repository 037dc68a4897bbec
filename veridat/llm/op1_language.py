"""Language identification by prediction by partial matching.

For each language a byte context tree is learned from labelled documents; a text goes
to the language whose frozen tree codes it in the fewest bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, chance, over_texts, share_of
from .ppm import Model, gram_counts

UNKNOWN = "und"
ORDER = 3


def train(labelled: DataFrame, docs_per_language: int = 1500) -> tuple[list[str], Model]:
    """Trees of all languages of ``labelled`` (doc_id, text, lang), with all contexts that were
    seen twice.

    ``docs_per_language`` bounds the expected number of whole documents that a language
    learns from; a hash of the id and the text chooses them. Languages with fewer use all;
    repeated rows count each; null labels are left out, null texts count as empty ones; no
    labelled row gives no language."""
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect() if r.lang is not None}
    if not counts:
        return [], Model([])
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(share_of(docs_per_language, n)))])
    chosen = labelled.where(chance("doc_id", "text", F.lit("language")) < share[F.col("lang")])
    found = gram_counts(chosen, "lang", ORDER).toArrow()  # bounded, as the sample is
    langs = sorted(set(found["label"].unique().to_pylist()))
    by = [found.filter(pc.equal(found["label"], x)) for x in langs]
    return langs, Model([(x["gram"].to_numpy(), x["n"].to_numpy()) for x in by], ORDER)


def identify(docs: DataFrame, langs: list[str], model: Model) -> DataFrame:
    """``lang_pred``, ``score`` (posterior under equal priors) and ``bits`` for each row.

    A null text or one without a letter, or any text if no language was learned, is
    ``und`` with score 0. Ties go to the first language in alphabetical order. Repeated
    rows each get a row, an empty table none; other columns of ``docs`` don't matter."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, model))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, bits double"

    def work(part: pa.RecordBatch, text):
        names, trees = shared.value
        letters = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
        if not names:
            none = pa.nulls(part.num_rows, pa.float64())
            return pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array([UNKNOWN] * part.num_rows), pa.array(np.zeros(part.num_rows)), none], ["doc_id", "held_out", "lang_pred", "score", "bits"])
        bits = trees.bits(text)
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        with np.errstate(under="ignore"):
            score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        pred = np.where(letters, np.array(names, object)[best], UNKNOWN)
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(3), pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(least, pa.float64(), mask=~letters)],
            ["doc_id", "held_out", "lang_pred", "score", "bits"],
        )

    columns = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        (bucket(F.col("doc_id"), 4) == 2).alias("held_out"),
    )
    return over_texts(columns, work, schema)


def op1_language_id(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = docs.where((bucket(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    return identify(docs, *train(labelled))
