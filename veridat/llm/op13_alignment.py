"""Alignment of the tokens of two tokenizers.

The texts of a batch stand in one array of bytes, each behind a space. The ends of both
tokenizers' tokens are counted by byte once; where both have an end, a group of tokens
ends. Prefix sums of the counts say which tokens overlap and, between documents' offsets,
what each document has.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Flat, flat, fresh_path, kept, over_texts, passing_folders, removed, written

FOLDER = "/opt/tokenizers"
MOST_PAIRS = 1 << 20  # pairs of ids sent to all executors; rarer ones are joined
_HELD = 4_000_000  # pairs that a task holds before it adds them up
_FEATURES = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary"
# Fixed value: how byte-level tokenizers cut a text into words.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile("[^\x00-ɏ]")  # characters whose kind all versions of the pattern agree on lie below


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself where it is
    printable, else the next letter from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes by id, one behind the other."""

    def __init__(self, tokens: list[bytes]):
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        shown = [str(i).encode() for i in range(len(tokens))]
        self.width = max(map(len, shown), default=0) + 1
        self.digits = np.zeros((len(tokens), self.width), np.uint8)
        for i, s in enumerate(shown):
            self.digits[i, : len(s)] = np.frombuffer(s, np.uint8)
        self.n_digits = np.array([len(s) for s in shown], np.int64)

    def __len__(self) -> int:
        return len(self.lens)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one behind the other."""
        n = self.lens[ids]
        ends = np.cumsum(n)
        return self.data[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Pair:
    """Both tokenizers, made from the contents of their files."""

    def __init__(self, model_a: str, model_b: bytes):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.first = tokenizers.Tokenizer.from_str(model_a)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        letters = byte_letters()
        entries = self.first.get_vocab(with_added_tokens=True)
        by_id = {i: t for t, i in entries.items()}
        self.a = Vocabulary([bytes(letters[c] for c in by_id[i]) if i in by_id and all(c in letters for c in by_id[i]) else by_id.get(i, "").encode() for i in range(max(by_id) + 1)])
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces])
        self.fast = self._ranked(json.loads(model_a), letters)

    def _ranked(self, model: dict, letters: dict[str, int]):
        """The first tokenizer by ranks, several times faster, where its merges stand in the
        order of the ids that they make and nothing but the usual pattern cuts its words."""
        pre = model.get("pre_tokenizer") or {}
        rules = model["model"]
        merged = [m if isinstance(m, str) else " ".join(m) for m in rules.get("merges", [])]
        vocabulary = rules["vocab"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("normalizer") and rules.get("type") == "BPE" and not any(rules.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        made = [vocabulary.get(m.replace(" ", "", 1)) for m in merged]
        added = {t["content"] for t in model.get("added_tokens", [])}
        own = {t: i for t, i in vocabulary.items() if t not in added}
        if not plain or None in made or any(x >= y for x, y in zip(made, made[1:], strict=False)) or len(own) != 256 + len(made) or sum(len(t) == 1 for t in own) != 256:
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks={bytes(letters[c] for c in t): i for t, i in own.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text by both; the first gets it behind a space, the second adds one."""
        first: list = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if not t:
                first[i] = []
            elif self.fast is not None and not _PLAIN.search(t):
                first[i] = self.fast.encode_ordinary(" " + t)
            else:
                slow.append(i)
        for i, e in zip(slow, self.first.encode_batch_fast([" " + texts[i] for i in slow], add_special_tokens=False), strict=True):
            first[i] = e.ids
        return first, self.second.encode(texts, num_threads=1)


_ready: dict[str, Pair] = {}


def _pair(files: tuple[str, bytes]) -> Pair:
    """Both tokenizers, made once in each worker."""
    key = hashlib.sha256(files[0].encode() + files[1]).hexdigest()
    if key not in _ready:
        _ready[key] = Pair(*files)
    return _ready[key]


def load(folder: str = FOLDER, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model") -> tuple[str, bytes]:
    """The contents of the tokenizers' files, some MB, which executors get from the driver."""
    with open(os.path.join(folder, first), encoding="utf-8") as a, open(os.path.join(folder, second), "rb") as b:
        return a.read(), b.read()


def _ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where each document's begin and end."""
    offs = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, offs[-1]), offs


def _spaced(text: Flat) -> Flat:
    """Each document that isn't empty behind a space."""
    n = text.lens + (text.lens > 0)
    offs = np.concatenate([[0], np.cumsum(n)])
    data = np.full(offs[-1], 0x20, np.uint8)
    moved = np.arange(len(text.data)) + np.repeat(offs[1:] - text.lens - text.offs[:-1], text.lens)
    data[moved] = text.data
    return Flat(data, offs)


def _spell(vocabulary: Vocabulary, ids: np.ndarray, offs: np.ndarray, text: Flat) -> np.ndarray:
    """Which documents the bytes of their tokens spell."""
    size = vocabulary.lens[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    begin, end = ends[offs[:-1]], ends[offs[1:]]
    same = end - begin == text.lens
    spelled = vocabulary.joined(ids)
    at = np.repeat(begin - text.offs[:-1], np.where(same, text.lens, 0))
    place = np.flatnonzero(np.repeat(same, text.lens))
    wrong = np.zeros(len(text.data), bool)
    wrong[place] = text.data[place] != spelled[place + at]
    return same & (text.per_doc(wrong) == 0)


def _only(ids: np.ndarray, offs: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(offs)
    return ids[np.repeat(good, n)], np.concatenate([[0], np.cumsum(np.where(good, n, 0))])


class Aligned:
    """Documents whose tokens of both kinds spell the same bytes, concatenated."""

    def __init__(self, a: np.ndarray, a_offs: np.ndarray, b: np.ndarray, b_offs: np.ndarray, pair: Pair):
        self.a, self.a_offs, self.b, self.b_offs, self.pair = a, a_offs, b, b_offs, pair
        self.ends_a, self.ends_b = np.cumsum(pair.a.lens[a]), np.cumsum(pair.b.lens[b])
        total = int(self.ends_a[-1]) if len(a) else 0
        at_a, at_b = (np.bincount(x, minlength=total + 1) for x in (self.ends_a, self.ends_b))
        self.upto_b = np.cumsum(at_b)  # ends of B tokens up to each byte
        self.cuts = np.cumsum((at_a > 0) & (at_b > 0))

    def _bytes(self) -> np.ndarray:
        return np.concatenate([[0], self.ends_a])[self.a_offs]

    def groups(self) -> np.ndarray:
        """Groups of each document."""
        return np.diff(self.cuts[self._bytes()]) if len(self.a) else np.zeros(len(self.a_offs) - 1, np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A token, B token) places of all overlaps, and the number of each document."""
        starts = self.ends_a - self.pair.a.lens[self.a]
        first = self.upto_b[starts]
        n = self.upto_b[self.ends_a - 1] - first + 1
        i = np.repeat(np.arange(len(self.a)), n)
        j = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(i))
        per = np.concatenate([[0], np.cumsum(n)])
        return i, j, np.diff(per[self.a_offs])

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for the pair of ids of each link, and the number of links of each document."""
        i, j, n = self.links()
        return self.a[i] * len(self.pair.b) + self.b[j], n

    def hashes(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;...`` of each document; '' without tokens."""
        if not len(self.a):
            return [""] * (len(self.a_offs) - 1)
        group_a, group_b = self.cuts[self.ends_a - 1], self.cuts[self.ends_b - 1]
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        before_b = np.searchsorted(group_b, group_a, "left")
        before_a = np.searchsorted(group_a, group_b, "right")
        n = len(self.a) + len(self.b)
        width = max(self.pair.a.width, self.pair.b.width)
        signs, size = np.zeros((n, width), np.uint8), np.zeros(n, np.int64)
        for ids, place, last, vocabulary, mark in ((self.a, np.arange(len(self.a)) + before_b, last_a, self.pair.a, b"|"), (self.b, np.arange(len(self.b)) + before_a, last_b, self.pair.b, b";")):
            own = np.zeros((len(ids), width), np.uint8)
            own[:, : vocabulary.width] = vocabulary.digits[ids]
            own[np.arange(len(ids)), vocabulary.n_digits[ids]] = np.where(last, mark[0], ord(","))
            signs[place], size[place] = own, vocabulary.n_digits[ids] + 1
        ends = np.concatenate([[0], np.cumsum(size)])
        line = signs[np.arange(width) < size[:, None]].tobytes()
        bounds = ends[self.a_offs + self.b_offs].tolist()
        return [hashlib.sha256(memoryview(line)[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(bounds, bounds[1:], strict=False)]


def _texts(column: pa.Array) -> list[str]:
    try:
        return column.fill_null("").to_pylist()
    except UnicodeDecodeError:  # bytes that no token spells
        return [x.decode(errors="replace") for x in column.fill_null("").cast(pa.binary()).to_pylist()]


def _packed(ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
    raw = memoryview(ids.astype("<u4").tobytes())
    return [bytes(raw[4 * x : 4 * y]) for x, y in zip(offs.tolist(), offs[1:].tolist(), strict=False)]


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = flat(column)
    return np.frombuffer(text.data.tobytes(), "<u4").astype(np.int64), text.offs // 4


def tokens(docs: DataFrame, files: tuple[str, bytes]) -> DataFrame:
    """A row for each document of ``docs`` (doc_id, text): _FEATURES, of which ``a`` and ``b`` are
    its ids, four bytes each; those of a text that is null or empty, or that the tokens of
    either kind don't spell, are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def work(part: pa.RecordBatch, text: Flat):
        pair = _pair(shared.value)
        (a, a_offs), (b, b_offs) = (_ids(x) for x in pair.encode(_texts(part.column(2))))
        spaced = _spaced(text)
        good = _spell(pair.a, a, a_offs, spaced) & _spell(pair.b, b, b_offs, spaced)
        (a, a_offs), (b, b_offs) = _only(a, a_offs, good), _only(b, b_offs, good)
        found = Aligned(a, a_offs, b, b_offs, pair)
        values = [np.diff(a_offs), np.diff(b_offs), found.groups(), found.links()[2]]
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), *[pa.array(v.astype(np.int64)) for v in values], pa.array(found.hashes()), pa.array(_packed(a, a_offs), pa.binary()), pa.array(_packed(b, b_offs), pa.binary())], [f.split()[0] for f in _FEATURES.split(", ")]
        )

    return over_texts(docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text"), work, _FEATURES)


def _aligned(part: pa.RecordBatch, pair: Pair) -> Aligned:
    return Aligned(*_unpacked(part.column(part.schema.get_field_index("a"))), *_unpacked(part.column(part.schema.get_field_index("b"))), pair)


def _pieces(batches, size: int = 1 << 20):
    """Rows of about ``size`` ids."""
    for batch in batches:
        n = batch.column(batch.schema.get_field_index("n_links")).to_numpy()
        ends, at = np.concatenate([[0], np.cumsum(n)]), 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, ends[at] + size, "right")) - 1, at + 1)
            yield batch.slice(at, to - at)
            at = to


def pair_counts(found: DataFrame, files: tuple[str, bytes]) -> DataFrame:
    """(pair, n, best): how many links of all documents each pair of ids has, and whether its B
    id has none of more. Each task adds up its own links first."""
    shared = found.sparkSession.sparkContext.broadcast(files)
    size = len(_pair(files).b)

    def run(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting, number = [], 0

        def added(keys, counts, waiting):
            own, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (keys[:0], counts[:0])
            every, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, at, np.concatenate([counts, n]))
            return every, total

        out = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["pair", "n"])
        for part in _pieces(batches):
            codes, _ = _aligned(part, _pair(shared.value)).codes()
            waiting.append(codes)
            number += len(codes)
            if number > _HELD:
                keys, counts = added(keys, counts, waiting)
                waiting, number = [], 0
                if len(keys) > _HELD:
                    yield out(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        keys, counts = added(keys, counts, waiting)
        for at in range(0, len(keys), 1 << 16):
            yield out(keys[at : at + (1 << 16)], counts[at : at + (1 << 16)])

    counts = written(found.select("n_links", "a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = (F.col("pair") % size).cast("int").alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))  # as many rows as the second vocabulary has ids, at most
    return written(counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def _frequent(counts: DataFrame, most: int) -> tuple[pa.Table, int]:
    """The pairs of at least a power of two links, the least for which there are at most
    ``most``, and that power."""
    level = F.floor(F.log2("n")).cast("int").alias("level")
    by = {r.level: r["count"] for r in counts.groupBy(level).count().collect()}  # 63 rows at most
    cut, total = 63, 0
    for at in sorted(by, reverse=True):
        if (total := total + by[at]) > most:
            break
        cut = at
    return counts.where(F.col("n") >= F.lit(1 << cut if cut < 63 else (1 << 63) - 1)).orderBy("pair").toArrow(), cut


def align(docs: DataFrame, folder: str = FOLDER, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of
    ``docs`` (doc_id, text).

    Both tokenizers encode space and text without special tokens, whose strings are plain text. Where
    tokens of both end, a group ends; A and B tokens whose bytes overlap are links. A pair of
    ids counts the links of all documents that it has; ``count_sum`` adds up the counts of a
    document's links, ``n_best`` are its links whose count is the highest of their B id, ties
    included. A text that is null or empty, or that the tokens of either kind don't spell, has
    zeros and an empty hash. Repeated rows and null ids are documents each, in the counts too;
    an empty table gives no rows; other columns don't matter.

    Up to ``most_pairs`` frequent pairs are sent to all executors; the others are joined. The
    result is written to the shared folder."""
    spark = docs.sparkSession
    files = load(folder, first, second)
    path = fresh_path(spark, "tokens")
    with passing_folders(spark):
        source = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
        tokens(source, files).write.option("compression", "zstd").parquet(path)
        found = spark.read.parquet(path)
        counts = pair_counts(found, files)
        heavy, cut = _frequent(counts, most_pairs)
        shared = spark.sparkContext.broadcast((files, heavy["pair"].to_numpy(), heavy["n"].to_numpy(), heavy["best"].to_numpy(zero_copy_only=False)))
        out = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<bigint>, times array<bigint>"

        def score(batches):
            files, pairs, n, best = shared.value
            for part in _pieces(batches):
                codes, links = _aligned(part, _pair(files)).codes()
                own, at = np.unique(codes, return_inverse=True)
                place = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
                known = pairs[place] == own if len(pairs) else np.zeros(len(own), bool)
                value = np.where(known, n[place], 0) if len(pairs) else np.zeros(len(own), np.int64)
                good = known & best[place] if len(pairs) else known
                ends = np.concatenate([[0], np.cumsum(links)])
                per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])  # noqa: B023, E731
                rare = np.flatnonzero(~known[at])
                doc = np.searchsorted(ends, rare, "right") - 1
                key, times = np.unique(np.stack([doc, codes[rare]], 1), axis=0, return_counts=True) if len(rare) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
                offs = pa.array(np.searchsorted(key[:, 0], np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(7)], pa.array(per(good[at].astype(np.int64))), pa.array(per(value[at])), pa.ListArray.from_arrays(offs, pa.array(np.ascontiguousarray(key[:, 1]))), pa.ListArray.from_arrays(offs, pa.array(times.astype(np.int64)))], [x.split()[0] for x in out.split(", ")]
                )

        scored = found.mapInArrow(score, out)
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        light = counts.where(F.col("n") < F.lit(1 << cut if cut < 63 else (1 << 63) - 1))
        if not light.isEmpty():
            scored = written(scored, "scored")
            asked = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), "x.times")
            added = asked.join(light, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
            more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
            scored = scored.join(added, "row", "left").withColumns({"count_sum": more("count_sum", "more_sum"), "n_best": more("n_best", "more_best")})
        result = kept(scored.select(*names))
    removed(spark, path)
    return result


def op13_align_tokens(spark, sf_dir) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
