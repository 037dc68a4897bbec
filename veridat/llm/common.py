"""Helpers that the corpus operators share: flat Arrow text, word hashes, the shared folder.

Texts reach Python as Arrow batches. A batch is cut into slices of about
``SLICE_BYTES`` and every slice is handled as one flat byte array with document
offsets, so the work on words and bytes is vectorised and memory is bounded by the
slice (or by the longest single text).
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_PRIME = 0x9E3779B97F4A7C15
_GRAM = 0xD1342543DE82EF95
LONG = 256  # bytes
_LAST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_NOT_WORD = np.zeros(256, bool)
_NOT_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- session


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session, whose
    executors are this machine, gets a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif sc.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="veridat-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later jobs don't compute it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


_passing: list[list[str]] = []


@contextlib.contextmanager
def passing_folders(spark: SparkSession):
    """What ``written`` makes inside is removed at the end; what is to stay has to be
    written by then, and by other means."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            removed(spark, path)


def written(df: DataFrame, name: str = "kept") -> DataFrame:
    """As ``kept``, in columns: plans over it read those they need."""
    path = fresh_path(df.sparkSession, name)
    if _passing:
        _passing[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a key for each row in a column ``name``, so repeated or null ids stay apart.

    The rows are written with their keys: two plans over the result agree on them, which
    two plans that number the rows anew needn't do after a join or a shuffle."""
    return written(df.withColumn(name, row_key()), "numbered")


HOT = 2_000  # keys with more than one in so many of all rows count as frequent; there are at most so many
SALTS = 1_009


def spread_join(left: DataFrame, right: DataFrame, key: str, often: Column, spread: Column) -> DataFrame:
    """Left join on ``key`` with a table that has one row for each key at most and was written.

    Rows of it where ``often`` holds, at most HOT, are sent to all executors, so that the rows
    of a frequent key stay where they are; ``spread`` deals them, and those without a key, to
    places in which nothing is joined."""
    value = [c for c in right.columns if c != key]
    hot = right.where(often).select(key, F.struct(*value).alias("hot_"))
    cold = right.where(~often).select(key, F.struct(*value).alias("cold_"), F.lit(0).alias("salt_"))
    out = left.join(F.broadcast(hot), key, "left")
    out = out.withColumn("salt_", F.when(F.col("hot_").isNull() & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(spread, F.lit(SALTS))).cast("int"))
    out = out.join(cold, [key, "salt_"], "left").withColumn("value_", F.coalesce("hot_", "cold_"))
    return out.select(*left.columns, *[F.col(f"value_.{v}").alias(v) for v in value])


def bucket(column: Column, modulus: int) -> Column:
    """crc32 of a value as text, modulo ``modulus``; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def share_of(wanted: int, total: int) -> float:
    """The share of ``total`` rows that gives ``wanted`` of them, all if there are fewer."""
    return min(1.0, wanted / max(total, 1))


def chance(*columns: Column | str) -> Column:
    """A number from 0 to 1 that the columns' values choose, fine enough for any share of rows."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 62)).cast("double") / float(1 << 62)


def row_key() -> Column:
    """A key for each row within one plan; see ``numbered`` for one that plans share."""
    return F.monotonically_increasing_id()


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- flat text


class Flat:
    """Some documents as one byte array: document i is data[offs[i]:offs[i + 1]]."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n = data, offs, len(offs) - 1

    @property
    def lens(self) -> np.ndarray:
        return np.diff(self.offs)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums per document of one value per byte."""
        pre = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=pre[1:])
        return pre[self.offs[1:]] - pre[self.offs[:-1]]


def flat(column: pa.Array) -> Flat:
    """The texts of an Arrow string column (null: empty) without a copy of each text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    if len(column) == 0 or bufs[1] is None:
        return Flat(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return Flat(data, offs - offs[0])


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Row slices of about SLICE_BYTES of text; a longer text is a slice of its own."""
    ends = flat(batch.column(batch.schema.get_field_index(text))).offs
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def over_texts(df: DataFrame, work: Callable[[pa.RecordBatch, Flat], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on every slice of ``df``, which has a column ``text``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = work(part, flat(part.column(part.schema.get_field_index("text"))))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- words

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a slice: byte bounds, document bounds (``docs``) and 64-bit hashes."""

    def __init__(self, text: Flat, breaks: np.ndarray = _WHITE, lower: bool = True):
        self.text = text
        self.data = _LOWER[text.data] if lower else text.data
        self.starts, self.ends = runs(~breaks[self.data], text.offs)
        self.docs = np.searchsorted(self.starts, text.offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.text.n), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where k words of one document start, and the hash of those words."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(_GRAM) + hashes[j : j + n]
        last = np.repeat(self.docs[1:], self.counts)[:n]
        at = np.flatnonzero(np.arange(n) + k <= last)
        return at, mix(out[at] + np.uint64(k))


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of True, cut at document bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: lanes of eight bytes, each mixed with what came
    before; spans beyond LONG bytes by BLAKE2b."""
    size = ends - starts
    out = (size.astype(np.uint64) + np.uint64(1)) * np.uint64(_GRAM)
    wide = np.zeros(len(data) // 8 + 2, "<u8")
    wide.view(np.uint8)[: len(data)] = data
    at, whole = np.flatnonzero(size <= LONG), len(starts)
    done = 0
    while len(at):
        place = starts[at] + done
        base, shift = place >> 3, ((place & 7) << 3).astype(np.uint64)
        lane = (wide[base] >> shift) | ((wide[base + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        lane &= _LAST[np.minimum(size[at] - done, 8)]
        value = mix((out[at] ^ lane) * np.uint64(_PRIME) + np.uint64(done))
        if len(at) == whole:
            out = value
        else:
            out[at] = value
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of given words, the same as Words.hashes() finds."""
    raw = [w.encode() for w in words]
    offs = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), offs[:-1], offs[1:])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """True for each byte that begins a code point."""
    return (data & 0xC0) != 0x80


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))[: len(k)]
    return k[first], np.add.reduceat(c, first) if len(first) else c[:0]


def counted(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if not len(sorted_values):
        return sorted_values, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return sorted_values[first], np.diff(np.append(first, len(sorted_values)))
