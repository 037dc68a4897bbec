"""Benchmark decontamination with SimHash over windows of an item's size.

Built-in functions only. Windows lie wherever the shingles that a text shares with the items of
a size weigh enough for the similarity asked, in whatever order they stand. Each window's weighted SimHash meets
those of the items of its size by a multi-index: 64 bits fall into RADIUS + 1 blocks, and
two fingerprints within RADIUS bits agree on one block at least. Pairs that are within the
radius are verified by exact weighted-shingle similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, kept, numbered, written

RADIUS = 18  # of 64 bits; at similarity 0.8 the expected distance is below 10
MOST_ITEM_SHINGLES = 2_000_000  # sent to all executors up to here, joined by shuffle beyond
MOST_WINDOWED = 1_000_000  # documents with windows, likewise


def _words(column: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _shingles(words: Column, width: int) -> Column:
    """The hash of ``width`` words from each place."""
    last = F.size(words) - width
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<bigint>"))


def _blocks(value: Column) -> Column:
    """(index, bits) of each of the RADIUS + 1 parts of 64 bits."""
    parts, at = [], 0
    for i in range(RADIUS + 1):
        width = 64 // (RADIUS + 1) + (i < 64 % (RADIUS + 1))
        parts.append(F.struct(F.lit(i).alias("index"), F.shiftrightunsigned(value, at).bitwiseAND((1 << width) - 1).alias("bits")))
        at += width
    return F.array(*parts)


def _fingerprints(shingles: DataFrame, key: list[str]) -> DataFrame:
    """Weighted SimHash and total weight of the rows (key..., shingle, weight) of each key."""
    bit = lambda b: F.shiftrightunsigned("shingle", b).bitwiseAND(F.lit(1))
    sums = shingles.groupBy(*key).agg(F.sum("weight").alias("total"), *[F.sum(F.when(bit(b) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{b}") for b in range(64)])
    value = F.lit(0).cast("long")
    for b in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(*key, "total", value.alias("fingerprint"))


def items_table(benchmark: DataFrame, width: int = 5) -> DataFrame:
    """(item_id, size, width, grams) of items with a word. Items shorter than ``width`` words
    are one shingle of all their words."""
    base = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words")).withColumn("size", F.size("words")).where("size > 0")
    grams = F.lit(None).cast("array<bigint>")
    for w in range(1, width + 1):
        grams = F.when(F.least("size", F.lit(width)) == w, _shingles(F.col("words"), w)).otherwise(grams)
    return base.select("item_id", "size", F.least("size", F.lit(width)).alias("width"), grams.alias("grams"))


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, similarity): the best window for each pair.

    A shingle weighs 1 + log((1 + items) / (1 + items that have it)), so what many items
    share counts less; similarity is the weight of the common shingles over that of all.
    Windows are clipped at a text's ends. Null and empty texts and items match nothing;
    rows with equal ids count as one document with several texts; of equally similar
    windows the first aligned one counts, else the first."""
    items = kept(items_table(benchmark, width))
    widths = [r[0] for r in items.select("width").distinct().collect()]  # five values at most
    number = items.count()
    each = items.select("item_id", "size", "width", F.posexplode("grams").alias("place", "shingle"))
    weights = kept(each.groupBy("shingle").agg(F.countDistinct("item_id").alias("n")).select("shingle", (1 + F.log((F.lit(float(number)) + 1) / (F.col("n") + 1))).alias("weight")))
    heaviest = F.lit(1.0) + F.log(F.lit(float(number) + 1))
    small = each.count() <= MOST_ITEM_SHINGLES
    sent = F.broadcast if small else (lambda df: df)

    # the items' side
    item_rows = each.select("item_id", "size", "shingle").distinct().join(sent(weights), "shingle")
    item_prints = _fingerprints(item_rows, ["item_id", "size"])
    item_weights = item_rows.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("shingle", "weight"))).alias("weights"))
    known = kept(item_prints.join(item_weights, "item_id"))

    # windows: all starts from which the shared shingles of a size weigh enough. A similarity is at
    # most their weight over the item's, so starts below the least item's share match nothing.
    key = F.xxhash64("doc_id", "text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    worded = texts.select(key.alias("key"), _words(F.col("text")).alias("words"))
    anchors = None
    for w in widths:
        places = worded.select("key", F.size("words").alias("length"), F.posexplode(_shingles(F.col("words"), w)).alias("at", "shingle"))
        own = each.where(F.col("width") == w).select("shingle", "size", "width").distinct().join(sent(weights), "shingle")
        hit = places.join(sent(own), "shingle").select("key", "size", "width", "length", "at", "weight")
        anchors = hit if anchors is None else anchors.unionByName(hit)
    if anchors is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, first_word long, last_word long, similarity double")
    ahead = F.col("size") - F.col("width")
    # a shingle counts for the starts from at - ahead to at; rows with equal texts have equal places
    changes = anchors.dropDuplicates(["key", "size", "at"]).select(
        "key", "size", "width", "length", F.explode(F.array(F.struct((F.col("at") - ahead).alias("at"), F.col("weight")), F.struct((F.col("at") + 1).alias("at"), (-F.col("weight")).alias("weight")))).alias("x")
    )
    steps = changes.groupBy("key", "size", "width", "length", F.col("x.at").alias("at")).agg(F.sum("x.weight").alias("weight"))
    along = Window.partitionBy("key", "size").orderBy("at")
    ranges = steps.withColumn("shared", F.sum("weight").over(along)).withColumn("to", F.lead("at").over(along) - 1)
    least = item_prints.groupBy("size").agg((F.min("total") * similarity - 1e-6).alias("least"))
    first, last = F.greatest(F.col("at"), F.lit(0)), F.least(F.col("to"), F.greatest(F.col("length") - F.col("size"), F.lit(0)))
    heavy = ranges.join(sent(least), "size").where((F.col("shared") >= F.col("least")) & (first <= last))
    starts = heavy.select("key", "size", "width", F.explode(F.sequence(first, last)).alias("start"))
    wanted = kept(starts.groupBy("key").agg(F.collect_list(F.struct("size", "width", "start")).alias("windows")))
    chosen = F.broadcast(wanted) if wanted.count() <= MOST_WINDOWED else wanted

    # whole windows of those texts, each with its distinct shingles
    source = texts.select(key.alias("key"), "doc_id", _words(F.col("text")).alias("words")).join(chosen, "key")
    length = F.size("words")
    begin = F.greatest(F.lit(0), F.least(F.col("w.start"), length - F.col("w.size")))
    cut = source.select("doc_id", "words", F.explode("windows").alias("w")).select("doc_id", F.col("w.size").alias("size"), F.col("w.width").alias("width"), begin.alias("start"), F.slice("words", begin + 1, F.least(length, F.col("w.size"))).alias("inside"), (begin >= length - F.col("w.size")).alias("edge")).where(F.size("inside") >= F.col("width"))
    grams = F.lit(None).cast("array<bigint>")
    for w in widths:
        grams = F.when(F.col("width") == w, _shingles(F.col("inside"), w)).otherwise(grams)
    windows = kept(cut.select("doc_id", "size", "start", F.size("inside").alias("words"), F.array_distinct(grams).alias("grams"), grams.alias("places"), "edge").withColumn("window", F.xxhash64("doc_id", "size", "start", "grams")).dropDuplicates(["window"]))

    rows = windows.select("window", F.explode("grams").alias("shingle")).join(sent(weights), "shingle", "left").withColumn("weight", F.coalesce("weight", heaviest))
    prints = _fingerprints(rows, ["window"]).join(windows, "window")
    indexed = prints.withColumn("block", F.explode(_blocks(F.col("fingerprint")))).select("window", "size", "fingerprint", "block")
    item_index = known.withColumn("block", F.explode(_blocks(F.col("fingerprint")))).select("item_id", "size", F.col("fingerprint").alias("item_print"), "block")
    met = indexed.join(sent(item_index), ["size", "block"])
    near = met.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("window", "item_id").distinct()

    pair = near.join(prints.select("window", "doc_id", "start", "words", "grams", "total", "places", "edge"), "window").join(sent(known.select("item_id", "weights", F.col("total").alias("item_total"))), "item_id").join(sent(items.select("item_id", F.col("grams").alias("item_places"))), "item_id")
    common = F.aggregate(F.array_intersect("grams", F.map_keys("weights")), F.lit(0.0), lambda a, s: a + F.col("weights")[s])
    scored = pair.withColumn("common", common).withColumn("similarity", F.col("common") / (F.col("total") + F.col("item_total") - F.col("common"))).where(F.col("similarity") >= similarity - 1e-9)
    # of equally similar windows, first those that have a shingle at the item's place or end with the text
    aligned = F.col("edge") | F.coalesce(F.exists(F.zip_with("places", "item_places", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x), F.lit(False))
    best = scored.withColumn("aligned", aligned).groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.round("similarity", 9)).alias("s"), (~F.col("aligned")).alias("off"), "start", "words")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start").cast("long").alias("first_word"), (F.col("b.start") + F.col("b.words") - 1).cast("long").alias("last_word"), F.round(-F.col("b.s"), 6).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the rows that hold a passage like an item's text. Each row is judged by
    its own text, so rows without a passage stay whatever ids they share."""
    row = free_name(docs, "row")
    rows = numbered(docs, row)
    found = find(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, similarity)
    hit = written(found.select(F.col("doc_id").alias(row)).distinct())
    return rows.join(F.broadcast(hit) if hit.count() <= MOST_WINDOWED else hit, row, "left_anti").drop(row)


def op5_decontaminate(spark, sf_dir) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark
), it AS (
  SELECT item_id, len(ws) AS n, least(5, len(ws)) AS k, ws FROM i WHERE len(ws) > 0
), ig AS (
  SELECT item_id, n, k, unnest(range(0, n - k + 1)) AS place, ws FROM it
), igs AS (
  SELECT item_id, n, k, place, array_to_string(ws[place + 1:place + k], ' ') AS g FROM ig
), f AS (
  SELECT g, 1 + ln((1.0 + (SELECT count(*) FROM it)) / (count(DISTINCT item_id) + 1)) AS weight FROM igs GROUP BY g
), dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL
), dg AS (
  SELECT doc_id, k, unnest(range(0, greatest(len(ws) - k + 1, 0))) AS place, ws FROM dw, (SELECT DISTINCT k FROM it)
), hits AS (
  SELECT DISTINCT doc_id, dg.k, n, greatest(0, least(dg.place - igs.place, len(ws) - n)) AS start, ws FROM dg JOIN igs ON dg.k = igs.k AND array_to_string(ws[dg.place + 1:dg.place + dg.k], ' ') = g
), wins AS (
  SELECT doc_id, k, n, start, ws[start + 1:start + n] AS part FROM hits
), wg AS (
  SELECT DISTINCT doc_id, k, n, start, len(part) AS size, unnest(list_transform(range(1, len(part) - k + 2), lambda x: array_to_string(part[x:x + k - 1], ' '))) AS g FROM wins
), weighed AS (
  SELECT wg.*, coalesce(weight, 1 + ln(1.0 + (SELECT count(*) FROM it))) AS weight FROM wg LEFT JOIN f USING (g)
), total AS (
  SELECT doc_id, n, start, sum(weight) AS total FROM weighed GROUP BY ALL
), ids AS (
  SELECT DISTINCT item_id, n, g, weight FROM igs JOIN f USING (g)
), itotal AS (
  SELECT item_id, sum(weight) AS total FROM ids GROUP BY 1
), shared AS (
  SELECT doc_id, item_id, w.n, start, size, sum(w.weight) AS common FROM weighed AS w JOIN ids ON w.n = ids.n AND w.g = ids.g GROUP BY ALL
), scored AS (
  SELECT shared.*, common / (total.total + itotal.total - common) AS similarity FROM shared JOIN total USING (doc_id, n, start) JOIN itotal USING (item_id)
)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS first_word, CAST(start + size - 1 AS BIGINT) AS last_word, round(similarity, 6) AS similarity FROM scored
WHERE similarity >= 0.8 - 1e-9 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
