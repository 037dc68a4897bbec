"""Similarity join of documents on word n-grams.

The documents are the rows, the n-grams the columns of a sparse incidence matrix. What is
asked for is where its product with itself, the overlaps of all pairs, is large. That product
is formed in blocks, and only those that can hold such an overlap:

1. Equal rows are one class. What follows works on classes, so a group of copies costs
   no more than one of them.
2. Two rows that link share so many columns that, with all columns in one order, the first
   one they share is among the first few of each: a block is what has the same column
   there (see _block_keys). Frequent and repeated columns come last. Sizes and the column's place in both
   rows bound how much two rows can share from it on; a block is cut where no pair of rows
   can link by that bound (see _places), and what is alone then leaves.
3. In each block all rows meet the block's least row. While blocks that aren't one component
   after that are large, all their rows meet a few more leaders of other components, chosen
   by hashes. A pair of rows that components join already needs no cell of the product.
4. Blocks that are still open are cut into tiles of TILE rows. A cell is a pair of tiles, so
   a block of any size is many small cells. Pairs pass the bounds on sizes and on parity bits.
5. What passed is multiplied: the incidence rows are dealt to row blocks, and each pair of
   row blocks accumulates the overlap counts of its pairs, one quarter of the columns after
   another; a pair leaves as soon as the columns to come can't lift it over its bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, Words, counted, flat, free_name, fresh_path, kept, mix, numbered, passing_folders, row_key, signed, slices, spread_join, written
from .graph import components

MOST_HOT = 500_000  # columns known as frequent: those with more than one in so many of all entries; counted ones known as repeated
REPEATED = 5  # sets from which on a counted column is repeated
BUCKETS, REST = 1 << 10, 22  # of marks: by their first bits, and how many bits are left
PENDING = 1 << 20  # marks that a task holds
SKETCH = 1 << 22  # places of each of the two tables that count a task's columns
LEADERS, ROUNDS, WORTH = 8, 2, 0.05
LARGE = 10  # pairs in open blocks for each row of them, from which on leaders come first
TILE = 256  # rows of a tile
CODE = 10  # bits of the code of a size
ROW_BLOCKS, BLOCK_ENTRIES = 12, 1 << 21  # at least so many row blocks; entries of one
STEPS = 4  # parts of the columns, between which pairs leave
_SHORT = ("f0", "f1", "f2", "f3")
MOST_CHOSEN = 1_000_000  # texts or rows whose keys are sent to the scan; with more, a join by shuffle selects them


def shingle_sets(text, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by document, ascending in each: (bounds, hashes)."""
    words = Words(text)
    h, doc = words.hashes(), words.doc_of()
    at, gram = words.grams(h, k)
    own = doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        extra = []
        for d in short:
            whole = words.counts[d : d + 1].astype(np.uint64)
            for i in range(words.docs[d], words.docs[d + 1]):
                whole = mix(whole * np.uint64(31) + h[i : i + 1])
            extra.append(whole)
        own, gram = np.concatenate([own, short]), np.concatenate([gram, *extra])
    order = np.lexsort((gram, own))
    own, gram = own[order], gram[order]
    first = np.concatenate([[True], (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])])[: len(own)]
    own, gram = own[first], gram[first]
    return np.searchsorted(own, np.arange(text.n + 1)), gram


def _sum_by(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    pre = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=pre[1:])
    return pre[bounds[1:]] - pre[bounds[:-1]]


def digests(bounds: np.ndarray, gram: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each set, the same for equal sets. Sets with an equal first number and
    another second one show that ``seed`` doesn't do (see _linked)."""
    turn = np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    a = _sum_by(bounds, mix(gram + np.uint64(0x51ED270B) + turn))
    b = _sum_by(bounds, mix(gram ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(3))
    size = np.diff(bounds).astype(np.uint64)
    return signed(mix(a + size + turn)), signed(mix(b + mix(size)))


def parity_lanes(bounds: np.ndarray, gram: np.ndarray) -> pa.Array:
    """Bits by document, in lanes of 64: how many of its shingles fall on each, modulo 2.

    Two sets differ in at least as many elements as bits. There are as many bits as
    shingles, up to the next power of two; a longer row of bits is folded to compare it."""
    size = np.diff(bounds)
    lanes = np.left_shift(1, np.ceil(np.log2(np.maximum(size / 64, 1))).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(lanes)])
    doc = np.repeat(np.arange(len(size)), size)
    bit = offs[doc] * 64 + ((gram >> np.uint64(20)).astype(np.int64) & (64 * lanes[doc] - 1))
    odd = (np.bincount(bit, minlength=64 * offs[-1]) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))


def short_parity(bounds: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """256 such bits by document, as four columns."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    odd = np.bincount(doc * 256 + ((gram >> np.uint64(40)).astype(np.int64) & 255), minlength=256 * (len(bounds) - 1)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(-1, 4)


def _differing_bits(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    folded = lambda x, i: F.get(x, i).bitwiseXOR(F.when(F.size(x) > least, F.get(x, i + least)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(F.sequence(F.lit(0), least - 1), F.lit(0), lambda n, i: n + F.bit_count(folded(a, i).bitwiseXOR(folded(b, i))))


def _short_bits(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}{f}").bitwiseXOR(F.col(f"{b}{f}"))) for f in _SHORT), F.lit(0))


def _block_keys(bounds: np.ndarray, gram: np.ndarray, percent: int, hot: np.ndarray, times: np.ndarray | None = None, marks: np.ndarray | None = None, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, key): the blocks that each set is in, so that sets that link share one.

    All columns have one order: by hash, the frequent ones (``hot``, sorted, with their ``times``) and
    the repeated ones (``marks``, likewise) behind the others and by how frequent they are. A set of n shares at least m of them with
    any that it links with, so the first shared one is among its first n - m + 1: with all of
    these behind it, at most m - 1 would be shared. Each of those columns is a key, and the
    first shared one is a key of both sets."""
    size = np.diff(bounds)
    every = np.repeat(np.arange(len(size)), size)
    rank = np.zeros(len(gram), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, signed(gram)), len(hot) - 1)
        rank = np.where(hot[at] == signed(gram), 1 if times is None else 1 + times[at], 0)
    if marks is not None and len(marks):
        low = np.flatnonzero(signed(gram) >= 0)
        own = _marks(gram[low])
        at = np.minimum(np.searchsorted(marks, own), len(marks) - 1)
        rank[low] = np.maximum(rank[low], np.where(marks[at] == own, 1 + marked[at], 0))
    if rank.any():
        gram = gram[np.lexsort((rank, every))]  # stable: hashes ascend among equals
    first = np.arange(len(gram)) - bounds[:-1][every] <= (size - _least_shared(size, percent))[every]
    return every[first], signed(mix(gram[first]))


def _marks(gram: np.ndarray) -> np.ndarray:
    """Marks of 32 bits of the columns in the lower half of hashes, ``gram``. These are counted, as the
    first columns of a set are among them unless most of its columns are repeated. Columns that
    share a mark count together, which moves them alike in the order of all sets."""
    return (gram >> np.uint64(31)).astype(np.uint32)


def _packed(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(bucket, number, blob) of ``marks``. A blob has the sorted rests of a bucket, the first byte of
    all before the second of all, so that it compresses to about half."""
    marks = np.sort(marks)
    bucket, n = counted(marks >> np.uint32(REST))
    ends = np.cumsum(n)
    rest = (marks & np.uint32((1 << REST) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return bucket.astype(np.int64), n, [rest[a:b].T.tobytes() for a, b in zip(ends - n, ends, strict=True)]


def _repeated(blobs: DataFrame) -> DataFrame:
    """(mark, n) of the marks that at least REPEATED sets have, of blobs (bucket, marks). A task holds one bucket."""

    def out(bucket, held):
        rest = [np.frombuffer(x, np.uint8).reshape(3, -1).astype(np.uint32) for x in held]
        mark, n = counted(np.sort(np.concatenate([x[0] | x[1] << np.uint32(8) | x[2] << np.uint32(16) for x in rest])))
        often = n >= REPEATED
        return pa.RecordBatch.from_arrays([pa.array((bucket << REST) + mark[often].astype(np.int64)), pa.array(n[often])], ["mark", "n"])

    def run(batches):
        at, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != at and held:
                    yield out(at, held)
                    held = []
                at = bucket
                held.append(blob.as_py())
        if held:
            yield out(at, held)

    return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "mark long, n long")


def _most_repeated(repeated: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(marks, times), sorted, of the most frequent ones, MOST_HOT at most."""
    by_times = sorted(map(tuple, repeated.groupBy("n").count().collect()), reverse=True)
    total = np.cumsum([0, *(c for _, c in by_times)])[1:]
    fit = np.count_nonzero(total <= MOST_HOT)
    chosen = repeated.where(F.col("n") >= by_times[fit - 1][0]) if fit else repeated.limit(0)
    chosen = chosen.orderBy("mark").toArrow()
    return chosen["mark"].to_numpy().astype(np.uint32), chosen["n"].to_numpy()


def _size_steps() -> np.ndarray:
    """The sizes at which codes begin: each up to 100, then steps of two hundredths."""
    steps = [1]
    while steps[-1] < 1 << 31:
        steps.append(max(steps[-1] + 1, steps[-1] + steps[-1] // 50))
    return np.array(steps)


SIZE_STEPS = _size_steps()


def _places(doc: np.ndarray, key: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """The keys of _block_keys, their last 2 * CODE bits replaced by two codes of sizes.

    Say a set of n has the column at place i of its order. With a set of x whose first shared
    column it is, it shares n - i at most, and so can link only if x is (n - i) * (100 + p) / p - n
    at most. The codes are those of n and of that bound; two sets can link by this block only if the
    size of each is within the bound of the other (see _within). Larger sizes never have smaller
    codes, so codes refuse no pair that sizes don't."""
    n = size[doc]
    at = np.arange(len(doc)) - np.searchsorted(doc, doc)
    most = (n - at) * (100 + percent) // percent - n
    code = lambda x: np.searchsorted(SIZE_STEPS, np.maximum(x, 1), "right") - 1
    return (key & -(1 << 2 * CODE)) | (code(n) << CODE) | code(most)


def _within(a: str, b: str) -> Column:
    """Whether the size of each of two rows of a block is within the bound of the other."""
    return (F.col(f"{a}step") <= F.col(f"{b}reach")) & (F.col(f"{b}step") <= F.col(f"{a}reach"))


def _members(blocks: DataFrame) -> DataFrame:
    """(key, digest, step, reach, times, least, meets) of the blocks (place, digest) in which some rows
    may link: codes of size and bound, the block's rows and least row, and whether bounds let both link.

    In the order of sizes, a row that is beyond the bounds of all before begins a block of its own."""
    code = lambda shift: F.shiftright("place", shift).bitwiseAND(F.lit((1 << CODE) - 1)).cast("int")
    rows = blocks.repartition(F.shiftright("place", 2 * CODE)).select(F.shiftright("place", 2 * CODE).alias("key"), code(CODE).alias("step"), code(0).alias("reach"), "digest")
    sized = Window.partitionBy("key").orderBy("step", "reach", "digest")
    rows = rows.withColumns({"before": F.max("reach").over(sized.rowsBetween(Window.unboundedPreceding, -1)), "after": F.lead("step").over(sized)})
    new = F.col("before").isNull() | (F.col("step") > F.col("before"))
    last = F.col("after").isNull() | (F.col("after") > F.greatest("before", "reach"))
    rows = rows.where(~(new & last)).withColumn("run", F.max(F.when(new, F.col("step"))).over(sized.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run, row = Window.partitionBy("key", "run"), F.struct("digest", "step", "reach")
    rows = rows.select("key", "run", "digest", "step", "reach").distinct().withColumns({"low": F.min(row).over(run), "high": F.max(row).over(run), "times": F.count("*").over(run)})
    rows = rows.where((F.col("low.digest") != F.col("high.digest")) & ((F.col("times") > 2) | _within("low.", "high.")))
    return rows.select((F.shiftleft("key", CODE) + F.col("run")).alias("key"), "digest", "step", "reach", "times", F.col("low.digest").alias("least"), _within("", "low.").alias("meets"))


def _least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with any set that a set of n can link with."""
    return -(-(percent * n) // 100)


def link_classes(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Documents link when 100 * overlap >= percent * union of their sets of distinct k-word
    shingles; one with fewer words has its whole sequence as its only shingle. A null or
    empty text has no shingle and links with nothing: its component is its own id. Rows
    with equal ids are documents of their own with that id. ``component_id`` is the least
    id that links reach; a null id counts only where a whole component has no other. An
    empty table gives no rows; other columns don't matter."""
    rows = docs.select(row_key().alias("rid"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    return _linked(rows, k, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` without the rows whose component has one with a smaller id (then: an earlier
    one). Null ids come last; texts without a shingle stay, repeated rows are one group; an
    empty table gives an empty one. Rows are numbered and written first."""
    row = free_name(docs, "row")
    rows = numbered(docs, row)
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "drop")
    with passing_folders(spark):
        found = _linked(rows.select(F.col(row).alias("rid"), "text", F.col("doc_id").cast("long").alias("doc_id")), k, percent)
        found.where(~F.col("stays")).select(F.col("rid").alias(row)).write.parquet(path)
    drop = spark.read.parquet(path)
    return rows.join(F.broadcast(drop) if drop.count() <= MOST_CHOSEN else drop, row, "left_anti").drop(row)


def _linked(docs: DataFrame, k: int, percent: int, seed: int = 0) -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, stays) of the rows (rid, text, doc_id)."""
    source = docs.select("rid", "text", "doc_id", F.xxhash64("text").alias("content"))
    spark = docs.sparkSession

    # rows, their classes, and which columns are frequent
    found = written(_first_scan(source, k, seed))
    rows = found.where("kind = 0")
    entries = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = found.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * MOST_HOT >= entries).orderBy("key").toArrow()
    repeated = _most_repeated(written(_repeated(found.where("kind = 2").select(F.col("key").alias("bucket"), "marks"))))
    frequent = spark.sparkContext.broadcast((hot["key"].to_numpy(), hot["n"].to_numpy(), *repeated))
    classes = rows.where("n > 0").groupBy(F.col("key").alias("digest")).agg(
        F.first("n").alias("n"), F.min("content").alias("content"), F.first("lanes").alias("lanes"), *[F.first(f).alias(f) for f in _SHORT],
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"), F.min("check").alias("low"), F.max("check").alias("high"),
    )
    classes = written(classes)
    if not classes.where("low <> high").isEmpty():  # by chance, two sets have the same number
        return _linked(docs, k, percent, seed + 1)

    # blocks
    members = written(_members(source.select("text").mapInArrow(_blocks(k, percent, frequent, seed), "place long, digest long")))

    verify = _verifier(source, classes, k, percent, seed)
    links = verify(members.where("digest <> least and meets").select(F.col("least").alias("a"), F.col("digest").alias("b")).distinct())
    joined = kept(components(links))
    members = members.where("times > 2")  # in a block of two, both have met

    short = classes.select("digest", "n", *_SHORT)
    again = lambda links: kept(components(links.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))))  # noqa: E731  what is joined already counts as one link for each node
    tested = None
    for turn in range(ROUNDS + 1):
        placed, open_ = _open(members, joined)
        size = open_.agg(F.sum("size"), F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()
        if turn == ROUNDS or not size[0] or size[1] <= LARGE * size[0]:
            break
        wide = written(placed.join(open_.where(F.col("size") > 2 * LARGE), "key").join(short, "digest"))
        lead = wide.groupBy("key").agg(F.max("size").alias("size"), *[F.min_by(F.struct("digest", "component", "step", "reach", "n", *_SHORT), F.xxhash64("digest", F.lit(turn * LEADERS + i))).alias(f"x{i}") for i in range(LEADERS)])
        # the rows of a large block meet its leaders in several places
        places = F.ceil(F.col("size") / F.lit(TILE)).cast("int")
        lead = lead.select("key", F.explode(F.sequence(F.lit(0), places - 1)).alias("place"), F.array_distinct(F.array(*[f"x{i}" for i in range(LEADERS)])).alias("xs")).select("key", "place", F.explode("xs").alias("x"))
        apart = (F.col("component") != F.col("x.component")) & _within("", "x.") & _may_link(F.col("n"), F.col("x.n"), _short_bits("", "x."), percent)
        met = wide.withColumn("place", F.pmod(F.xxhash64("digest"), places).cast("int")).join(lead, ["key", "place"]).where(apart).select(F.least("digest", "x.digest").alias("a"), F.greatest("digest", "x.digest").alias("b")).distinct()
        met = written(met if tested is None else met.join(tested, ["a", "b"], "left_anti"))
        tested = met if tested is None else tested.unionByName(met)
        found_links = verify(met)
        many = found_links.count()
        if not many:
            break
        joined = again(found_links)
        if many < WORTH * met.count():  # most pairs don't link, so leaders no longer save much
            placed, open_ = _open(members, joined)
            break

    # cells of the blocks that aren't one component yet
    more = verify(_cells(written(placed.join(open_, "key").join(short, "digest")), percent))
    if not more.isEmpty():
        joined = again(more)

    # the least id of each component, by classes; rows follow their class
    own = written(classes.select("digest", "first").join(joined, F.col("digest") == F.col("node"), "left").select("digest", "first", F.coalesce("component", "digest").alias("component")))
    groups = written(own.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("times")).where("times > 1"))
    own = spread_join(own, groups, "component", F.col("times") * HOT >= own.count(), F.xxhash64("digest")).select(F.col("digest").alias("key"), F.coalesce("least", "first").alias("least"))
    copies = rows.groupBy("key").agg(F.count("*").alias("times"))
    own = written(own.join(copies, "key"))
    full = spread_join(rows.select("rid", "doc_id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")), own, "key", F.col("times") * HOT >= rows.count(), F.xxhash64("rid"))
    alone = F.col("key").isNull()
    return full.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), (alone | (F.col("least.rid") == F.col("rid"))).alias("stays"))


def _open(members: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` with their components, and (key, size) of the blocks that have several."""
    placed = members.join(joined, F.col("digest") == F.col("node"), "left").select("key", "digest", "step", "reach", "least", F.coalesce("component", "digest").alias("component"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high")
    return placed, written(open_.select("key", "size"))


def _cells(left: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open blocks that are in two components and pass the bounds.

    ``left``: (key, size, digest, step, reach, least, component, n, bits). Each block is cut into tiles; the
    rows of a tile go to one cell for each tile of the block."""
    tiles = F.ceil(F.col("size") / F.lit(TILE)).cast("int")
    cut = left.withColumn("own", F.pmod(F.xxhash64("digest"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    a = cut.where("own <= other").withColumnsRenamed({"own": "i", "other": "j"}).alias("a")
    b = cut.where("own >= other").withColumnsRenamed({"own": "j", "other": "i"}).alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    once = (F.col("a.i") < F.col("a.j")) | (F.col("a.digest") < F.col("b.digest"))
    apart = (F.col("a.component") != F.col("b.component")) & (F.col("a.digest") != F.col("a.least")) & (F.col("b.digest") != F.col("b.least"))
    met = a.join(b, same & once & apart & _within("a.", "b.") & _may_link(F.col("a.n"), F.col("b.n"), _short_bits("a.", "b."), percent))
    return met.select(F.least("a.digest", "b.digest").alias("a"), F.greatest("a.digest", "b.digest").alias("b")).distinct()


def _first_scan(source: DataFrame, k: int, seed: int) -> DataFrame:
    """kind 0: a row for each document; kind 1: shingles that a partition has in more than
    one in MOST_HOT of its entries (a frequent column is so in some partition); kind 2: marks
    of the columns of each class, once for each task, by buckets."""

    def beside(kind, n, key, kind_of_lanes, marks=None):
        none = pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), none, none, none, pa.array(n), pa.array(key), none, pa.nulls(len(key), kind_of_lanes), *[none] * 4, pa.array(marks, pa.binary()) if marks else pa.nulls(len(key), pa.binary())], _names)

    def packed(held, kind_of_lanes):
        bucket, n, blobs = _packed(np.concatenate(held))
        return beside(2, n, bucket, kind_of_lanes, blobs)

    def run(batches):
        often, seen, held, pending = Often(), set(), [], 0
        for batch in batches:
            for part in slices(batch):
                text = flat(part.column(1))
                bounds, gram = shingle_sets(text, k)
                often.add(*counted(np.sort(signed(gram))))
                n_docs = text.n
                lanes = parity_lanes(bounds, gram)
                digest, check = digests(bounds, gram, seed)
                short = [pa.array(x) for x in short_parity(bounds, gram).T.copy()]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n_docs, np.int32)), part.column(0), part.column(2), part.column(3), pa.array(np.diff(bounds)), pa.array(digest), pa.array(check), lanes, *short, pa.nulls(n_docs, pa.binary())], _names)
                new = np.array([d not in seen and not seen.add(d) for d in digest.tolist()], bool)
                marks = _marks(gram[np.repeat(new, np.diff(bounds)) & (signed(gram) >= 0)])
                if len(marks):
                    held.append(marks)
                    pending += len(marks)
                if pending >= PENDING:
                    yield packed(held, lanes.type)
                    held, pending = [], 0
        if held:
            yield packed(held, lanes.type)
        key, n = often.found()
        if len(key):
            yield beside(1, n, key, lanes.type)

    _names = ["kind", "rid", "doc_id", "content", "n", "key", "check", "lanes", *_SHORT, "marks"]
    return source.mapInArrow(run, "kind int, rid long, doc_id long, content long, n long, key long, check long, lanes array<long>, f0 long, f1 long, f2 long, f3 long, marks binary")


class Often:
    """Keys that make up one in MOST_HOT of all that was added, in memory that doesn't grow.

    A key counts in one place of each of two tables. The lesser of both is its count, or more
    where others share both places: no frequent key is missed, and as a table has eight places
    for each of MOST_HOT keys, what is found beside them is nearly as frequent."""

    def __init__(self):
        self.tables = np.zeros((2, SKETCH), np.int32)
        self.total, self.keys, self.pending = 0, [], 0

    def _places(self, keys: np.ndarray) -> list[np.ndarray]:
        h = mix(keys.view(np.uint64))
        return [((h >> np.uint64(32 * i)) & np.uint64(SKETCH - 1)).astype(np.int64) for i in range(2)]

    def _frequent(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.minimum(*(table[at] for table, at in zip(self.tables, self._places(keys), strict=True))).astype(np.int64)
        often = (n > 1) & (n * MOST_HOT >= self.total)
        return keys[often], n[often]

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        """``keys``, distinct, were seen ``n`` more times each."""
        for table, at in zip(self.tables, self._places(keys), strict=True):
            np.add.at(table, at, n.astype(np.int32))
        self.total += int(n.sum())
        new, _ = self._frequent(keys)  # a key that is frequent in the end is so when it comes last
        self.keys.append(new)
        self.pending += len(new)
        if self.pending > MOST_HOT:
            self.found()

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """The frequent keys with their counts."""
        keys, n = self._frequent(np.unique(np.concatenate([np.zeros(0, np.int64), *self.keys])))
        self.keys, self.pending = [keys], 0
        return keys, n


def _blocks(k: int, percent: int, frequent, seed: int):
    """(place, digest) of the blocks of each document's class, once for each task: what many
    copies send to a block grows with the tasks, not with the copies."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                text = flat(part.column(0))
                bounds, gram = shingle_sets(text, k)
                digest, _ = digests(bounds, gram, seed)
                keep = np.array([d not in seen and not seen.add(d) for d in digest.tolist()], bool)
                doc, key = _block_keys(bounds, gram, percent, *frequent.value)
                place, keep = _places(doc, key, np.diff(bounds), percent), keep[doc]
                yield pa.RecordBatch.from_arrays([pa.array(place[keep]), pa.array(digest[doc[keep]])], ["place", "digest"])

    return run


def _may_link(na: Column, nb: Column, bits: Column, percent: int) -> Column:
    """The bounds on sizes and on bits: |A xor B| <= (100 - p) / (100 + p) * (|A| + |B|)."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * bits <= (100 - percent) * (na + nb))


def _verifier(source: DataFrame, classes: DataFrame, k: int, percent: int, seed: int):
    def verify(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that link."""
        meta = lambda s: classes.select(F.col("digest").alias(s), F.col("n").alias(f"n{s}"), F.col("lanes").alias(f"l{s}"))
        near = pairs.join(meta("a"), "a").join(meta("b"), "b")
        bits = _differing_bits(F.col("la"), F.col("lb"))
        near = written(near.where(_may_link(F.col("na"), F.col("nb"), bits, percent)).select("a", "b"))
        chosen = written(near.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(classes.select("digest", "content", "n"), "digest"))
        entries = chosen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not entries:
            return near
        return written(_product(near, _sets(source, chosen, k, seed), max(ROW_BLOCKS, entries // BLOCK_ENTRIES), percent))

    return verify


def _product(near: DataFrame, sets: DataFrame, number: int, percent: int) -> DataFrame:
    """Those of ``near`` (a, b) whose rows of the incidence matrix (digest, shingles) overlap
    enough, found in the cells of ``number`` by ``number`` row blocks."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(number))
    dealt = near.withColumn("cell", block("a") * number + block("b"))
    rows = dealt.select(F.col("cell").alias("place"), F.explode(F.array("a", "b")).alias("digest")).distinct().join(sets, "digest")

    def multiply(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        ok = overlapping(rows["digest"].to_numpy(), rows["shingles"].combine_chunks(), a, b, percent)
        return pa.table({"a": a[ok], "b": b[ok]})

    return dealt.groupBy("cell").cogroup(rows.groupBy("place")).applyInArrow(multiply, "a long, b long")


def overlapping(digest: np.ndarray, shingles: pa.Array, a: np.ndarray, b: np.ndarray, percent: int, chunk: int = 1 << 21) -> np.ndarray:
    """Which pairs of the rows ``digest`` have the overlap that a link needs.

    The overlap of a pair grows by one for each column of its smaller row that the other has."""
    if not len(a):
        return np.zeros(0, bool)
    order = np.argsort(digest)
    a, b = order[np.searchsorted(digest, a, sorter=order)], order[np.searchsorted(digest, b, sorter=order)]
    size = shingles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    names, column = np.unique(shingles.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    entry = np.sort(np.repeat(np.arange(len(size)), size) * len(names) + column)
    need = -(-percent * (size[a] + size[b]) // (100 + percent))
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    overlap = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    for step in range(STEPS):
        cuts = lambda x, s: first[x] + size[x] * s // STEPS
        lo, hi = cuts(a[left], step), cuts(a[left], step + 1)
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
            pair, n = left[at:to], (hi - lo)[at:to]
            which = np.repeat(np.arange(len(pair)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:to], n)
            asked = b[pair][which] * len(names) + column[place]
            hit = entry[np.minimum(np.searchsorted(entry, asked), len(entry) - 1)] == asked
            overlap[pair] += np.bincount(which[hit], minlength=len(pair))
            at = to
        left = left[overlap[left] + (first[a[left] + 1] - hi) >= need[left]]
    ok = np.zeros(len(a), bool)
    ok[left] = True
    return ok


def _sets(source: DataFrame, chosen: DataFrame, k: int, seed: int) -> DataFrame:
    """(digest, shingles) of the chosen classes (digest, content), once each. Each class gives
    the hash of one of its texts, so that only such texts are cut into shingles again; others
    with that hash by chance give sets that no class asks for."""
    content = kept(chosen.select("content").distinct())
    texts = source.join(F.broadcast(content) if content.count() <= MOST_CHOSEN else content, "content", "left_semi").select("text")

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                bounds, gram = shingle_sets(flat(part.column(0)), k)
                digest, _ = digests(bounds, gram, seed)
                size = np.diff(bounds)
                rows = [i for i in np.flatnonzero(size) if digest[i] not in seen and not seen.add(digest[i])]
                if rows:
                    offs = np.concatenate([[0], np.cumsum(size[rows])]).astype(np.int32)
                    values = np.concatenate([signed(gram[bounds[i] : bounds[i + 1]]) for i in rows])
                    yield pa.RecordBatch.from_arrays([pa.array(digest[rows]), pa.ListArray.from_arrays(pa.array(offs), pa.array(values))], ["digest", "shingles"])

    return texts.mapInArrow(run, "digest long, shingles array<long>").dropDuplicates(["digest"])


def op6_ngram_jaccard(spark, sf_dir) -> DataFrame:
    return link_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM p JOIN n AS a ON x = a.doc_id JOIN n AS b ON y = b.doc_id WHERE 100 * c >= 85 * (a.n + b.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON other = x
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""
