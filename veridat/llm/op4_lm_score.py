"""Language-model scores: a word unigram base and prediction by partial matching.

The word counts and the byte context tree come from all training documents. Scoring
needs each document's words beside their corpus counts: words with more than one in
``HEAVY`` of all tokens (at most ``HEAVY`` of them, by pigeonhole) are resolved in the
scan, the others are joined with the counts by word. Byte contexts likewise: those that
are heavy are a tree that the scan holds, every other symbol meets the counts of its
context by the context's nearest bytes, so the model grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bucket, counted, flat, merged, numbered, over_texts, signed, slices, written
from .ppm import BITS, DROPPED, Model, code_lengths, ngrams, tables

HEAVY = 200_000
ORDER = 5  # bytes of context
NEAR = 3  # what shares so many nearest bytes of a context is resolved together
HEAVY_GRAMS = 2_000_000  # grams of lighter contexts that the scan holds too: those with one in so many of all bytes
MIN_PARTS, PART_BYTES = 256, 1 << 22
BIT_SCALE = 10**7  # as SCALE, for bits
SCALE = 10**12  # logarithms are added as whole numbers of this fraction, so no order of rows matters
_END_WORD = 0x656E64  # the key of the token that ends a document
_LOG2_10 = float(np.log2(10))


def corpus_counts(train: DataFrame) -> DataFrame:
    """(kind, key, n): kind 0 counts words by hash, kind 1 byte n-grams, over all of ``train``."""

    def run(batches):
        held = [([], []), ([], [])]
        ends = 0

        def batch_of(kind, keys, ns):
            for at in range(0, len(keys), 100_000):
                k = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(ns[at : at + 100_000])], ["kind", "key", "n"])

        for batch in batches:
            for part in slices(batch):
                text = flat(part.column(0))
                ends += text.n
                h = signed(Words(text).hashes())
                for slot, (key, n) in zip(held, (counted(np.sort(h)), ngrams(text, ORDER)), strict=True):
                    slot[0].append(key)
                    slot[1].append(n)
                for kind, slot in enumerate(held):
                    if sum(map(len, slot[0][1:])) > 1_000_000:  # by slices, as a batch may have many
                        key, n = merged(*slot)
                        slot[0][:], slot[1][:] = [key], [n]
                        if len(key) > 2_000_000:
                            yield from batch_of(kind, key, n)
                            slot[0].clear()
                            slot[1].clear()
        for kind, slot in enumerate(held):
            yield from batch_of(kind, *merged(*slot))
        if ends:
            yield from batch_of(0, np.array([_END_WORD]), np.array([ends]))

    return train.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, train: DataFrame, max_contexts: int = 60_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    ``base_score`` follows the contract, rounded to 6 decimals; ``score`` is the log10
    probability of the text's bytes and its end under the frozen tree, which has all contexts
    that were seen twice. The scan holds those with at least one in ``max_contexts`` of all
    bytes, so its share is bounded whatever the corpus, and a join resolves the others;
    ``max_contexts`` doesn't change the scores. A null text is
    the empty one, whose only token is the end. Repeated rows get a row each; with no
    training documents N and V are 0 and no token is known (log10 of 1/(0 + 1*(0 + 1)))."""
    spark = docs.sparkSession
    counts = written(corpus_counts(train), "counts")
    words = counts.where("kind = 0")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    denominator = float(total.n + total.v + 1)
    cost = lambda c: F.round(F.log10((c + 1.0) / F.lit(denominator)) * SCALE).cast("long")

    heavy = words.where((F.col("n") * HEAVY >= total.n) & (F.col("key") != _END_WORD)).select("key", cost(F.col("n")).alias("cost")).orderBy("key").toArrow()
    end_n = total.n and words.where(F.col("key") == _END_WORD).agg(F.sum("n")).first()[0] or 0
    model = spark.sparkContext.broadcast((heavy["key"].to_numpy(), heavy["cost"].to_numpy()))

    source = numbered(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")), "rid").select("rid", "text", "doc_id")
    head = "head struct<doc_id: long, n_tokens: long, known: long, cost: long>"

    def work(part: pa.RecordBatch, text):
        keys, costs = model.value
        words_ = Words(text)
        h, doc = signed(words_.hashes()), words_.doc_of()
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        known = np.bincount(doc[hit], minlength=text.n).astype(np.int64)
        pre = np.zeros(len(h) + 1, np.int64)
        np.cumsum(np.where(hit, costs[at], 0) if len(keys) else np.zeros(len(h), np.int64), out=pre[1:])
        sums = pre[words_.docs[1:]] - pre[words_.docs[:-1]]
        tail_doc, tail = doc[~hit], h[~hit]
        order = np.lexsort((tail, tail_doc))
        tail_doc, tail = tail_doc[order], tail[order]
        first = np.flatnonzero(np.concatenate([[True], (tail[1:] != tail[:-1]) | (tail_doc[1:] != tail_doc[:-1])])) if len(tail) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(tail)))
        rid = part.column(0).to_numpy()
        heads = pa.StructArray.from_arrays(
            [part.column(2), pa.array(words_.counts + 1), pa.array(known), pa.array(sums)], ["doc_id", "n_tokens", "known", "cost"]
        )
        # a row for each document, keyed by its row so that they spread, and one for each rarer word of it
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([rid, rid[tail_doc[first]]])), pa.array(np.concatenate([~rid, tail[first]])), pa.array(np.concatenate([np.zeros(text.n, np.int64), n])), pa.concat_arrays([heads, pa.nulls(len(first), heads.type)])],
            ["rid", "key", "times", "head"],
        )

    rows = over_texts(source, work, f"rid long, key long, times long, {head}")
    joined = rows.join(words.select("key", "n"), "key", "left")
    known = F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)
    rare = lambda c: F.when(F.col("head").isNull(), c).otherwise(0)
    parts = joined.select("rid", "head", rare(known).alias("known"), rare(F.col("times") * cost(F.coalesce("n", F.lit(0)))).alias("cost"), F.lit(0).cast("long").alias("bits"))
    grams = counts.where("kind = 1").select(F.col("key").alias("gram"), "n")
    bytes_ = _byte_bits(source, grams, max_contexts).select("rid", F.lit(None).cast(parts.schema["head"].dataType).alias("head"), F.lit(0).cast("long").alias("known"), F.lit(0).cast("long").alias("cost"), "bits")
    sums = parts.unionByName(bytes_).groupBy("rid").agg(F.max("head").alias("head"), F.sum("known").alias("known"), F.sum("cost").alias("cost"), F.sum("bits").alias("bits"))
    whole = F.col("cost") + F.col("head.cost") + cost(F.lit(end_n))
    return sums.select(
        F.col("head.doc_id").alias("doc_id"),
        F.col("head.n_tokens").alias("n_tokens"),
        (F.col("known") + F.col("head.known") + F.lit(1 if end_n else 0)).cast("long").alias("n_known"),
        F.lit(total.n).cast("long").alias("train_tokens"),
        F.round(whole / SCALE, 6).alias("base_score"),
        (F.col("bits") / F.lit(-BIT_SCALE * _LOG2_10)).alias("score"),
    )


def _byte_bits(source: DataFrame, grams: DataFrame, most: int) -> DataFrame:
    """(rid, bits): sums of code lengths, some rows for each row of ``source`` (rid, text)."""
    trained = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    asked = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    number = max(MIN_PARTS, max(trained, asked) // PART_BYTES)
    near = grams.groupBy(F.col("gram").bitwiseAND((1 << BITS * NEAR) - 1).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # at most 257^3, whatever the corpus
    short = tables(near["gram"].to_numpy(), near["n"].to_numpy(), range(NEAR))
    spark = source.sparkSession
    lows = spark.sparkContext.broadcast(short)
    context = F.shiftright("gram", BITS).bitwiseAND((1 << BITS * NEAR) - 1)
    mixed = (context * F.lit(2654435761)).bitwiseAND(F.lit(2**32 - 1)) * F.lit(number)
    known = grams.select(F.shiftright(mixed, 32).alias("part"), "gram", "n")

    def lengths(counted: pa.Table, gram: np.ndarray) -> np.ndarray:
        long_ = tables(counted["gram"].to_numpy(), counted["n"].to_numpy(), range(NEAR, ORDER + 1))
        return np.rint(code_lengths(lows.value + long_, gram) * BIT_SCALE).astype(np.int64)

    def often(counted: pa.Table) -> pa.Table:
        gram = counted["gram"].to_numpy()[counted["n"].to_numpy() * HEAVY_GRAMS >= trained]
        return pa.table({"gram": gram, "bits": lengths(counted, gram)})

    tree = _tree(grams, most)
    held = known.groupBy("part").applyInArrow(often, "gram long, bits long").orderBy("gram").toArrow()
    held = held.filter(pa.array(~tree.holds(held["gram"].to_numpy())))
    model = spark.sparkContext.broadcast((tree, held["gram"].to_numpy(), held["bits"].to_numpy()))

    def scan(batches):
        for batch in batches:
            for piece in slices(batch):
                text = flat(piece.column(1))
                rid = piece.column(0).to_numpy()
                tree, grams_, costs = model.value
                bits, doc, gram = tree.whole(text)
                bits = np.rint(bits * BIT_SCALE).astype(np.int64)
                if len(grams_):
                    at = np.minimum(np.searchsorted(grams_, gram), len(grams_) - 1)
                    hit = grams_[at] == gram
                    np.add.at(bits, doc[hit], costs[at[hit]])
                    doc, gram = doc[~hit], gram[~hit]
                offset = (rid - rid[0]).astype(np.int32)
                part = ((((gram >> BITS) & ((1 << BITS * NEAR) - 1)) * 2654435761 & (2**32 - 1)) * number) >> 32  # as in ``known``
                own = int(rid[0]) % number
                order = np.argsort(part, kind="stable")
                part, doc, gram = part[order], offset[doc[order]], gram[order]
                there = np.unique(np.append(part, own))
                bounds = pa.array(np.append(np.searchsorted(part, there), len(part)).astype(np.int32))
                mine = pa.array(np.where(np.arange(len(there) + 1) > np.searchsorted(there, own), text.n, 0).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(there), pa.array(np.full(len(there), rid[0])), pa.ListArray.from_arrays(bounds, pa.array(doc)), pa.ListArray.from_arrays(bounds, pa.array(gram)),
                        pa.ListArray.from_arrays(mine, pa.array(offset)), pa.ListArray.from_arrays(mine, pa.array(bits)),
                    ],
                    ["part", "base", "doc", "gram", "whole", "bits"],
                )

    def resolve(counted: pa.Table, rows: pa.Table) -> pa.Table:
        def of(name, kind):
            column = rows[name].combine_chunks()
            size = column.value_lengths().to_numpy(zero_copy_only=False)
            return np.repeat(rows["base"].to_numpy(), size), column.flatten().to_numpy(zero_copy_only=False).astype(kind)

        if not rows.num_rows:
            return pa.table({"rid": pa.array([], pa.int64()), "bits": pa.array([], pa.int64())})
        base, doc = of("doc", np.int64)
        gram, at = np.unique(of("gram", np.int64)[1], return_inverse=True)
        whole = of("whole", np.int64)
        rid, bits = merged([base + doc, sum(whole)], [lengths(counted, gram)[at], of("bits", np.int64)[1]])
        return pa.table({"rid": rid, "bits": bits})

    rows = source.select("rid", "text").mapInArrow(scan, "part long, base long, doc array<int>, gram array<long>, whole array<int>, bits array<long>")
    return known.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(resolve, "rid long, bits long")


def _tree(grams: DataFrame, most: int) -> Model:
    """A model of the contexts that the scan holds; at most ``most`` of each length are.

    What a lighter context holds still counts for its suffixes: its first byte is dropped."""
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rest = grams
    for order in range(ORDER, 1, -1):
        bits = BITS * order
        context = F.shiftright("gram", BITS).bitwiseAND((1 << bits) - 1)
        heavy = grams.groupBy(context.alias("context")).agg(F.sum("n").alias("m")).where(F.col("m") * most >= total).select("context", F.lit(True).alias("heavy"))
        at = rest.withColumn("context", context).join(heavy, "context", "left")
        dropped = F.col("gram").bitwiseAND((1 << bits) - 1) + F.lit(sum(DROPPED << BITS * j for j in range(order, ORDER + 1)))
        rest = at.select(F.when(F.col("heavy"), F.col("gram")).otherwise(dropped).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))
    found = rest.toArrow()
    return Model([(found["gram"].to_numpy(), found["n"].to_numpy())] if found.num_rows else [], ORDER, most)


def op4_lm_score(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = bucket(F.col("doc_id"), 7) == 2
    scored = score(docs, docs.where(~held))
    return scored.select("doc_id", (bucket(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
