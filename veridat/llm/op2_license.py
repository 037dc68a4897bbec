"""License scan by diagonal voting.

Every rolling word k-gram hash of every text is joined with the template positions that
have it. A match votes for the diagonal (text position minus template position);
neighbouring diagonals of a text and template are merged into a span, which is verified
by the share of the template's k-grams that it has and by its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _NOT_WORD, Flat, Words, over_texts, row_key, signed


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False  # a phrase counts only where all of its words stand consecutively


# The phrases of the contract.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)

# Common notices of public licenses.
NOTICES = (
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("mit-release", "released under the mit license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _words(text: str) -> Words:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(Flat(raw, np.array([0, len(raw)])), _NOT_WORD)


def template_positions(spark, templates, k: int) -> tuple[DataFrame, list[int]]:
    """(gram, template, label, phrase, tpos, width, grams) and the k-gram widths in use."""
    rows, widths = [], set()
    for i, t in enumerate(templates):
        words = _words(t.text)
        n = len(words.starts)
        width = n if t.phrase else min(k, n)
        at, gram = words.grams(words.hashes(), width)
        widths.add(width)
        rows += [(int(g), i, t.label, t.phrase, int(p), width, len(at), n) for p, g in zip(at, signed(gram), strict=True)]
    schema = "gram long, template int, label string, phrase boolean, tpos int, width int, grams int, words int"
    return spark.createDataFrame(rows, schema), sorted(widths)


def scan(docs: DataFrame, templates=PHRASES + NOTICES, k: int = 4, slack: int = 2, least: float = 0.6) -> DataFrame:
    """Spans per text: (rid, doc_id, n_words, spans), a row for each input row.

    ``spans`` is an array of (label, phrase, start, end, score), in words. ``slack`` is the
    gap up to which neighbouring diagonals are merged, ``least`` the least share of a
    template's k-grams. Null and empty texts have no words and no spans; repeated rows
    stay apart; extra columns are ignored; an empty table gives no rows. Of equally long places
    each is a span of its own, and the diagonals of one template are merged in their order,
    so ties can't change a result."""
    table, widths = template_positions(docs.sparkSession, templates, k)

    def work(part: pa.RecordBatch, text):
        words = Words(text, _NOT_WORD)
        h, docs_of = words.hashes(), words.doc_of()
        rid = part.column(0).to_numpy()
        who, pos, gram = [np.arange(text.n)], [np.full(text.n, -1)], [words.counts.astype(np.int64)]
        for width in widths:
            at, g = words.grams(h, width)
            own = docs_of[at]
            who.append(own)
            pos.append(at - words.docs[own])
            gram.append(signed(g))
        who, pos, gram = np.concatenate(who), np.concatenate(pos).astype(np.int32), np.concatenate(gram)
        ids = part.column(2)
        ids = pa.concat_arrays([ids, pa.nulls(len(who) - len(ids), ids.type)])
        return pa.RecordBatch.from_arrays([pa.array(rid[who]), ids, pa.array(pos), pa.array(gram)], ["rid", "doc_id", "pos", "gram"])

    rows = over_texts(docs.select(row_key().alias("rid"), "text", F.col("doc_id").cast("long").alias("doc_id")), work, "rid long, doc_id long, pos int, gram long")
    # the templates are a parameter of some hundred words, whatever the size of the input
    hits = rows.join(F.broadcast(table.withColumnRenamed("gram", "tgram")), (F.col("gram") == F.col("tgram")) & (F.col("pos") >= 0), "left").where(F.col("template").isNotNull() | (F.col("pos") < 0))
    votes = (
        hits.repartition(F.col("rid"))
        .withColumn("diagonal", F.when(F.col("template").isNotNull(), F.col("pos") - F.col("tpos")))
        .groupBy("rid", "template", "diagonal")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max(F.when(F.col("pos") < 0, F.col("gram"))).alias("n_words"),
            F.count("*").alias("votes"),
            F.min("pos").alias("start"),
            F.max(F.col("pos") + F.col("width")).alias("end"),
            *[F.first(x).alias(x) for x in ("label", "phrase", "grams", "words")],
        )
    )
    w = Window.partitionBy("rid", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(w)
    first = F.coalesce(gap > F.when(F.col("phrase"), 0).otherwise(slack), F.lit(True))
    groups = votes.withColumn("group", F.sum(first.cast("int")).over(w))
    merged = groups.groupBy("rid", "template", "group").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("end").alias("end"), *[F.first(x).alias(x) for x in ("label", "phrase", "grams", "words")]
    )
    score = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    length = F.col("end") - F.col("start")
    good = F.when(F.col("phrase"), F.col("votes") >= F.col("grams")).otherwise((score >= least) & (length <= 1.5 * F.col("words") + slack))
    span = F.when(good, F.struct("label", "phrase", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), score.alias("score")))
    return merged.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list(span).alias("spans"))


def op2_license_scan(spark, sf_dir) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["phrase"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
