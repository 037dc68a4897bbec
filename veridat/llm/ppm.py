"""Prediction by partial matching over bytes with frozen statistics.

The context tree has the contexts of up to ``order`` bytes. Its statistics come from Spark
jobs that count byte n-grams; a text begins after boundary symbols and ends with one, so the
probabilities of all texts sum to one. A frozen tree is compiled into a table: for each kept
context, the exact code length of each symbol by escape method C (escape weight: the number
of distinct symbols) with exclusion of the symbols that longer contexts have seen. A context
that isn't kept counts as its longest kept suffix (variable order).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Flat, flat, merged, slices

END = 256  # the boundary symbol
SYMBOLS = 257
BITS = 9
_MASK = (1 << BITS) - 1
DROPPED = _MASK  # stands for the far bytes of a context that was too light to be kept
LONGEST = 6  # n-grams of 7 symbols still fit 63 bits
_DENSE = 3  # contexts up to here are found by one table, longer ones byte by byte


def stream(text: Flat, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with ``order`` boundaries between documents; where each document begins.

    Predicted are the symbols from begin[i] to begin[i + 1] - order (included), the
    document's bytes and one boundary."""
    out = np.full(len(text.data) + order * (text.n + 1), END, np.uint16)
    doc = np.repeat(np.arange(1, text.n + 1, dtype=np.int64), text.lens)
    out[np.arange(len(text.data)) + order * doc] = text.data
    return out, text.offs + order * np.arange(1, text.n + 2)


def _predicted(begin: np.ndarray, size: int, order: int) -> np.ndarray:
    skip = np.zeros(size, bool)
    skip[:order] = True
    for j in range(1, order):
        skip[begin[1:] - order + j] = True
    return np.flatnonzero(~skip)


def ngrams(text: Flat, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, symbol) codes of a slice, BITS for each symbol, with their counts."""
    s, begin = stream(text, order)
    present = np.flatnonzero(np.bincount(s, minlength=SYMBOLS))
    k = len(present)
    kind = np.uint32 if k ** (order + 1) < 2**32 else np.uint64
    dense = np.zeros(SYMBOLS, kind)
    dense[present] = np.arange(k)
    d = dense[s]
    at = _predicted(begin, len(s), order)
    code = d[at - order]
    for j in range(order - 1, -1, -1):
        code = code * kind(k) + d[at - j]
    code.sort()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    n = np.diff(np.append(first, len(code)))
    code, gram = code[first].astype(np.int64), np.zeros(len(first), np.int64)
    for j in range(order + 1):
        gram |= present[code % k].astype(np.int64) << (BITS * j)
        code //= k
    return gram, n


def gram_counts(df: DataFrame, label: str, order: int) -> DataFrame:
    """(label, gram, n) over all texts of ``df``, merged in each partition before the shuffle."""

    def run(batches):
        held: dict[object, tuple[list, list]] = {}
        for batch in batches:
            for part in slices(batch):
                labels = part.column(1).to_pylist()
                for value in dict.fromkeys(labels):
                    own = part.column(0).take(pa.array([i for i, x in enumerate(labels) if x == value]))
                    keys, ns = held.setdefault(value, ([], []))
                    gram, n = ngrams(flat(own), order)
                    keys.append(gram)
                    ns.append(n)
                    if sum(map(len, keys)) > 1_000_000:
                        held[value] = tuple([x] for x in merged(keys, ns))
        for value, (keys, ns) in held.items():
            gram, n = merged(keys, ns)
            for at in range(0, len(gram), 100_000):
                g = gram[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(g), pa.string()), pa.array(g), pa.array(n[at : at + 100_000])], ["label", "gram", "n"])

    rows = df.select("text", label).mapInArrow(run, "label string, gram long, n long")
    return rows.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def _context(gram: np.ndarray, order: int) -> np.ndarray:
    return (gram >> BITS) & ((1 << (BITS * order)) - 1)


class Model:
    """Frozen trees of some labels, compiled. table[node * width + symbol, label]: bits.

    Kept are the contexts that were seen twice; with ``most``, of each length only those that
    hold at least one in ``most`` of all symbols."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], order: int = 3, most: int | None = None):
        self.order = order
        every = np.concatenate([g for g, _ in grams]) if grams else np.zeros(0, np.int64)
        seen = np.unique(np.concatenate([(every >> (BITS * j)) & _MASK for j in range(order + 1)] + [np.array([END])]))
        seen = seen[seen <= END]
        self.width = w = len(seen) + 1  # the last one: a byte that was never seen
        self.dense = np.full(SYMBOLS, w - 1, np.int32)
        self.dense[seen] = np.arange(len(seen))
        total = sum(int(n.sum()) for _, n in grams)
        rows = [np.zeros(1, np.int64)]
        for o in range(1, order + 1):
            keys, ns = merged([_context(g, o) for g, _ in grams], [n for _, n in grams])
            # a kept context's suffix is kept too, so a longer one is found from it
            whole = ((keys >> (BITS * (o - 1))) & _MASK) <= END
            kept = _find(rows[o - 1], keys & ((1 << (BITS * (o - 1))) - 1))[1]
            rows.append(keys[(ns >= 2) & (most is None or ns * most >= total) & whole & kept])
        self.nodes = sum(map(len, rows))
        base = np.cumsum([0] + [len(r) for r in rows])
        self.deepest, self.longest = int(base[order]), rows[order]
        table = np.full((self.nodes, w, max(1, len(grams))), np.log2(SYMBOLS), np.float32)
        for j, (g, n) in enumerate(grams):
            counts = [self._counts(g, n, o, rows[o]) for o in range(order + 1)]
            for o in range(order + 1):
                for lo in range(0, len(rows[o]), 2048):
                    part = rows[o][lo : lo + 2048]
                    table[base[o] + lo : base[o] + lo + len(part), :, j] = self._bits(part, o, lo, counts, rows)
        self.table = table.reshape(self.nodes * w, -1)
        # nodes of short contexts by their symbols, then children by the byte before
        self.where = np.zeros(w, np.int32)
        for o in range(1, min(order, _DENSE) + 1):
            if o > 1:
                self.where = np.tile(self.where, w)
            code = np.zeros(len(rows[o]), np.int64)
            for p in reversed(range(o)):
                code = code * w + self.dense[(rows[o] >> (BITS * p)) & _MASK]
            self.where[code] = base[o] + np.arange(len(code))
        self.children = []
        for o in range(_DENSE + 1, order + 1):
            child = np.full(len(rows[o - 1]) * w, -1, np.int32)
            parent, _ = _find(rows[o - 1], rows[o] & ((1 << (BITS * (o - 1))) - 1))
            child[parent * w + self.dense[rows[o] >> (BITS * (o - 1))]] = base[o] + np.arange(len(rows[o]))
            self.children.append((int(base[o - 1]), int(base[o]), child))

    def _counts(self, g, n, order, rows) -> np.ndarray:
        """Counts of the symbols after each context of ``rows``."""
        out = np.zeros(len(rows) * self.width, np.float32)
        at, ok = _find(rows, _context(g, order))
        out += np.bincount(at[ok] * self.width + self.dense[g[ok] & _MASK], weights=n[ok], minlength=len(out))
        return out.reshape(len(rows), self.width)

    def _bits(self, part, order, lo, counts, rows) -> np.ndarray:
        return _code_bits((counts[o][_find(rows[o], part & ((1 << (BITS * o)) - 1))[0]] for o in range(order, -1, -1)), len(part), self.width)

    def _placed(self, text: Flat):
        """Symbols, places of the predicted ones, their nodes and cells, and the first one of each document."""
        order, w = self.order, self.width
        s, begin = stream(text, order)
        d = self.dense[s]
        at = _predicted(begin, len(s), order)
        code = np.zeros(len(at), np.int32)
        for j in range(min(order, _DENSE), 0, -1):
            code = code * w + d[at - j]
        node = self.where[code]
        for j, (lo, hi, child) in enumerate(self.children):
            deep = np.flatnonzero((node >= lo) & (node < hi))
            found = child[(node[deep] - lo) * np.int64(w) + d[at[deep] - (_DENSE + 1 + j)]]
            node[deep] = np.where(found >= 0, found, node[deep])
        cell = node * np.int64(w) + d[at]
        first = begin[:-1] - order - (order - 1) * np.arange(text.n)
        return s, at, node, cell, first

    def bits(self, text: Flat) -> np.ndarray:
        """Code length of each document under each label."""
        if not text.n:
            return np.zeros((0, self.table.shape[1]))
        *_, cell, first = self._placed(text)
        return np.stack([np.add.reduceat(self.table[cell, j].astype(np.float64), first) for j in range(self.table.shape[1])], 1)

    def holds(self, gram: np.ndarray) -> np.ndarray:
        """Whether the whole context of each gram is kept."""
        return _find(self.longest, gram >> BITS)[1]

    def whole(self, text: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code length by document, under the first label, of the symbols whose context of
        ``order`` bytes is kept; (document, gram) of all others."""
        if not text.n:
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, at, node, cell, first = self._placed(text)
        deep = node >= self.deepest
        bits = np.add.reduceat(np.where(deep, self.table[cell, 0].astype(np.float64), 0.0), first)
        doc = np.repeat(np.arange(text.n), np.diff(np.append(first, len(at))))[~deep]
        gram = np.zeros(len(doc), np.int64)
        for j in range(self.order + 1):
            gram |= s[at[~deep] - j].astype(np.int64) << (BITS * j)
        return bits, doc, gram


class Counts:
    """All contexts of one length, sorted, with the symbols that were seen after each."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.gram, self.n = merged([gram], [n])
        context = self.gram >> BITS
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])[: len(context)])
        self.rows, self.first = context[first], np.append(first, len(context))
        self.total = np.add.reduceat(self.n, first) if len(first) else self.n

    def after(self, contexts: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(contexts), width), np.float32)
        if len(self.rows):
            at, ok = _find(self.rows, contexts)
            size = np.where(ok, self.first[at + 1] - self.first[at], 0)
            row = np.repeat(np.arange(len(contexts)), size)
            entry = np.arange(len(row)) + (self.first[at] - np.cumsum(size) + size)[row]
            out[row, place[self.gram[entry] & _MASK]] = self.n[entry]
        return out


def tables(gram: np.ndarray, n: np.ndarray, orders: range) -> list[Counts]:
    return [Counts(gram & ((1 << (BITS * (o + 1))) - 1), n) for o in orders]


def code_lengths(counts: list[Counts], asked: np.ndarray) -> np.ndarray:
    """Bits of each asked gram under the contexts of ``counts`` (by length) that hold two at
    least; a lighter context counts as its suffix."""
    seen = counts[0].gram & _MASK
    place, width = np.full(SYMBOLS, len(seen), np.int64), len(seen) + 1
    place[seen] = np.arange(len(seen))
    out = np.zeros(len(asked))
    left = np.arange(len(asked))
    for o in range(len(counts) - 1, -1, -1):
        context = (asked[left] >> BITS) & ((1 << (BITS * o)) - 1)
        here = np.ones(len(left), bool)
        if o:
            at, here = _find(counts[o].rows, context)
            here[here] = counts[o].total[at[here]] >= 2
        own, left = left[here], left[~here]
        nodes, node = np.unique(context[here], return_inverse=True)
        order = np.argsort(node, kind="stable")
        own, node = own[order], node[order]
        for lo in range(0, len(nodes), 2048):
            part = nodes[lo : lo + 2048]
            bits = _code_bits((counts[x].after(part & ((1 << (BITS * x)) - 1), place, width) for x in range(o, -1, -1)), len(part), width)
            a, b = np.searchsorted(node, [lo, lo + 2048])
            out[own[a:b]] = bits[node[a:b] - lo, place[asked[own[a:b]] & _MASK]]
    return out


def _code_bits(counts, n: int, width: int) -> np.ndarray:
    """Code length of each symbol after ``n`` contexts, from the counts of each context and
    then of its suffixes, the longest first."""
    prob = np.zeros((n, width))
    out = np.zeros((n, width), bool)  # excluded symbols
    escape = np.ones((n, 1))
    for c in counts:
        open_ = np.where(out, 0.0, c)
        total, kinds = open_.sum(1, keepdims=True), (open_ > 0).sum(1, keepdims=True)
        weight = np.maximum(total + kinds, 1)
        prob += escape * open_ / weight
        escape = np.where(kinds > 0, escape * kinds / weight, escape)
        out |= c > 0
    left = SYMBOLS - out.sum(1, keepdims=True)
    prob += np.where(out, 0.0, escape / np.maximum(left, 1))
    return -np.log2(np.maximum(prob, 1e-30))


def _find(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in sorted rows, and whether they are there."""
    if not len(rows):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(rows, keys), len(rows) - 1)
    return at, rows[at] == keys
