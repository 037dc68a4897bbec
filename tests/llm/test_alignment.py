"""Alignment of two tokenizers' tokens against a plain version."""

import collections
import hashlib

import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from veridat.llm import op13_alignment as op13

TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "  two  spaces\n\nand\tlines ", "naïve café déjà-vu — “quoted” … 𝒳 emoji 😀👍🏽", "", None, " ", "<|endoftext|> and </s> or <0x41> are text", "日本語のテキスト 한국어 العربية",
    "x" * 5000, "a b " * 2000, "don't I'll they've 12345 3.14", "ﬁ ligature and Ⅷ", "line sep nbsp　wide", "\x00\x01 control", "The quick brown fox jumps over the lazy dog.", "é combining", "▁ lower one", "word\u0085next\x1cfile",
]


def plain(rows):
    """Rows of the contract, token by token."""
    a_model = tokenizers.Tokenizer.from_file(f"{op13.FOLDER}/byte_bpe_50k.json")
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=f"{op13.FOLDER}/piece_bpe_32k.model")
    letters = op13.byte_letters()

    def spans(pieces):
        out, at = [], 0
        for i, p in pieces:
            out.append((i, at, at + len(p)))
            at += len(p)
        return out

    docs, counts = [], collections.Counter()
    for doc, text in rows:
        a = b = []
        if text:
            a = [(i, bytes(letters[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids]
            pieces = [(i, b_model.id_to_piece(i)) for i in b_model.encode(text)]
            b = [(i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()) for i, p in pieces]
            if any(b"".join(x for _, x in t) != (" " + text).encode() for t in (a, b)):
                a = b = []
        a, b = spans(a), spans(b)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in t if low <= s and e <= cut) for t in (a, b)))
            low = cut
        links = [(i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e] if len(a) < 2000 else None
        if links is None:  # long texts: only the tokens near each other
            links, first = [], 0
            for i, s, e in a:
                while b[first][2] <= s:
                    first += 1
                at = first
                while at < len(b) and b[at][1] < e:
                    links.append((i, b[at][0]))
                    at += 1
        counts.update(links)
        docs.append((doc, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(doc, na, nb, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), h) for doc, na, nb, g, links, h in docs]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [op13.MOST_PAIRS, 20, 0])
def test_alignment_equals_a_plain_one(spark, docs_of, most):
    rows = list(enumerate(TEXTS)) + [(None, "a null id"), (3, "a repeated id"), (3, "a repeated id")]
    docs = docs_of(rows).withColumn("row", F.lit("clash")).withColumn("n_a", F.lit(1)).repartition(3)
    found = op13.align(docs, most_pairs=most)
    assert found.columns == COLUMNS
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain(rows)))
    assert any(x[3] > 0 for x in plain(rows)) and any(x[3] == 0 and t for x, (_, t) in zip(plain(rows), rows, strict=True))


def test_no_documents(spark, docs_of):
    assert op13.align(docs_of([(1, "x")]).limit(0)).collect() == []
    assert [tuple(r) for r in op13.align(docs_of([(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_ranks_give_the_ids_of_the_tokenizer():
    pair = op13._pair(op13.load())
    assert pair.fast is not None
    texts = [t for t in TEXTS if t and not op13._PLAIN.search(t)] + ["".join(chr(i) for i in range(1, 0x250)), " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 x\xad", "1½²³ ªº Ǆǅ"] + [chr(i) * 3 + " " + chr(i) for i in range(1, 0x250)]
    slow = [e.ids for e in pair.first.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert pair.encode(texts)[0] == slow
