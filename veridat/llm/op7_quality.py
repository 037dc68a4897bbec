"""Quality rules, lines first.

Punctuation, navigation and boilerplate rules judge every line; lines that fail are
removed, and a document that loses too much of its text is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, code_points, mix, over_texts, runs, span_hashes

WINDOW = 8

# Phrases of page furniture.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "subscribe to our newsletter", "click here to", "lorem ipsum")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def _prefix(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def _repeated(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal another one of their document; which equal an earlier one."""
    both = key ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(both, kind="stable")
    same = both[order[1:]] == both[order[:-1]]
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def judge(docs: DataFrame, max_loss: float = 0.5, keep_columns: bool = False) -> DataFrame:
    """The counts of the contract, ``kept`` and figures of the line rules for each row.

    With ``keep_columns`` the result has the columns of ``docs`` instead, for kept rows
    only, their ``text`` without the lines that fail, and ``n_chars`` to match where there
    is one. ``max_loss`` is the largest share of word characters that a kept document may
    lose. Null and empty texts have no words and fail; repeated rows are judged each; of
    equal lines the first one isn't a repetition; an empty table gives no rows."""
    fields = [f for f in docs.schema.fields if f.name not in ("text",)]

    def work(part: pa.RecordBatch, text):
        data, n = text.data, text.n
        words = Words(text, lower=False)
        h, doc = words.hashes(), words.doc_of()
        counts = words.counts
        points = code_points(data)
        chars = _prefix(points)
        word_points = _prefix(points & ~((data == 32) | ((data >= 9) & (data <= 13))))
        symbols = _prefix(_SYMBOL[data])
        per_doc = lambda pre: (pre[text.offs[1:]] - pre[text.offs[:-1]]).astype(np.int64)
        # words in 8-word windows that the text has twice
        at, gram = words.grams(h, WINDOW)
        twice, _ = _repeated(doc[at], gram)
        cover = np.zeros(len(h) + 1, np.int32)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
        inside = np.cumsum(cover[:-1]) > 0
        n_repeat = np.bincount(doc[inside], minlength=n).astype(np.int64)
        # lines
        begin, end = runs(data != 10, text.offs)
        w0, w1 = np.searchsorted(words.starts, begin), np.searchsorted(words.starts, end)
        has = w1 > w0
        begin, end, w0, w1 = begin[has], end[has], w0[has], w1[has]
        line_doc = np.searchsorted(text.offs, begin, "right") - 1
        _, later = _repeated(line_doc, span_hashes(data, begin, end))
        n_dup = np.bincount(line_doc[later], minlength=n).astype(np.int64)
        of = lambda pre: pre[end] - pre[begin]
        n_line, line_chars, line_symbols = w1 - w0, of(chars), of(symbols)
        pipes, cries = of(_prefix(data == 124)), of(_prefix(data == 33))
        upper, lower = of(_prefix(_UPPER[data])), of(_prefix(_LOWER[data]))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        echo = _prefix(again)
        punctuation = (10 * line_symbols >= line_chars) | ((cries >= 3) & (3 * cries >= n_line)) | ((upper >= 30) & (upper > 4 * lower) & (n_line >= 5))
        navigation = (pipes >= 1) & (4 * pipes >= n_line)
        boilerplate = later | ((n_line >= 6) & (2 * (echo[w1] - echo[w0]) >= n_line))
        lowered = words_lowered(data)
        for phrase in BOILERPLATE:
            spot = lowered.find(phrase)
            while spot >= 0:
                line = int(np.searchsorted(begin, spot, "right")) - 1
                if line >= 0 and spot + len(phrase) <= end[line] and n_line[line] <= 25:
                    boilerplate[line] = True
                spot = lowered.find(phrase, spot + 1)
        bad = punctuation | navigation | boilerplate
        lost = np.bincount(line_doc[bad], weights=of(word_points)[bad], minlength=n).astype(np.int64)
        word_chars = per_doc(word_points)
        failed = (counts < 20) | (100 * n_repeat > 30 * counts)
        kept = ~failed & (lost <= max_loss * word_chars)
        if keep_columns:
            return _cleaned(part, text, kept, begin[bad], end[bad], fields)
        columns = {
            "doc_id": part.column(0), "n_words": counts.astype(np.int64), "word_chars": word_chars, "n_symbols": per_doc(symbols), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
            "base_failed": failed, "kept": kept, "lost_chars": lost, "n_bad_lines": np.bincount(line_doc[bad], minlength=n).astype(np.int64),
        }
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))

    if keep_columns:
        # names of the input's own, so that none clashes with "text"
        return over_texts(docs, work, docs.schema)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long, n_bad_lines long"
    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)


class words_lowered:  # noqa: N801
    """Bytes with A-Z in lower case, searched for phrases."""

    def __init__(self, data: np.ndarray):
        self.raw = data.tobytes().lower()

    def find(self, phrase: str, start: int = 0) -> int:
        return self.raw.find(phrase.encode(), start)


def _cleaned(part, text, kept, begin, end, fields) -> pa.RecordBatch:
    data = text.data
    mark = np.zeros(len(data) + 2, np.int32)
    stop = end.copy()
    inner = (stop < len(data)) & ~np.isin(stop, text.offs)
    stop[inner] += 1  # the line's own newline goes with it
    np.add.at(mark, begin, 1)
    np.add.at(mark, stop, -1)
    stay = np.cumsum(mark)[: len(data)] == 0
    lens = text.per_doc(stay)
    points = text.per_doc(stay & code_points(data))
    rest = data[stay].tobytes()
    offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    out = []
    for i, name in enumerate(part.schema.names):
        column = part.column(i)
        if name == "text":
            column = pa.StringArray.from_buffers(text.n, pa.py_buffer(offs.tobytes()), pa.py_buffer(rest)).cast(column.type)
        elif name == "n_chars" and pa.types.is_integer(column.type):
            column = pa.array(points).cast(column.type)
        out.append(column)
    return pa.RecordBatch.from_arrays(out, part.schema.names).filter(pa.array(kept))


def op7_quality_rules(spark, sf_dir) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT doc_id, unnest(range(1, greatest(len(ws) - 6, 1))) AS i, ws FROM w
), k AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM g
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM k) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS number FROM w
), m AS (
  SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw, row_number() OVER (PARTITION BY doc_id, line ORDER BY number) > 1 AS again,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(line, '[^|]', '', 'g')) AS pipes, length(regexp_replace(line, '[^!]', '', 'g')) AS cries,
         length(regexp_replace(line, '[^A-Z]', '', 'g')) AS upper_case, length(regexp_replace(line, '[^a-z]', '', 'g')) AS lower_case FROM l
), judged AS (
  SELECT doc_id, length(array_to_string(lw, '')) AS size,
         10 * symbols >= length(line) OR (cries >= 3 AND 3 * cries >= len(lw)) OR (upper_case >= 30 AND upper_case > 4 * lower_case AND len(lw) >= 5)
         OR (pipes >= 1 AND 4 * pipes >= len(lw)) OR again
         OR (len(lw) >= 6 AND 2 * len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) >= len(lw))
         OR (len(lw) <= 25 AND regexp_matches(line, '(?i)PHRASES')) AS bad FROM m
), loss AS (
  SELECT doc_id, CAST(coalesce(sum(size) FILTER (bad), 0) AS BIGINT) AS lost_chars, CAST(count(*) FILTER (bad) AS BIGINT) AS n_bad_lines FROM judged GROUP BY doc_id
), base AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(lost_chars, 0) AS lost_chars, coalesce(n_bad_lines, 0) AS n_bad_lines
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN loss USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT base_failed AND 2 * lost_chars <= word_chars AS kept FROM base
""".replace("PHRASES", "|".join(BOILERPLATE))
