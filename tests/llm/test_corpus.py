"""The corpus operators against brute force, on small hostile inputs."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridat.llm import common, graph, op1_language, op2_license, op3_pii, op4_lm_score, op5_decontaminate, op6_jaccard, op7_quality, op8_secrets, op10_mixing
from veridat.llm.common import Flat, Words, bucket
from veridat.llm.ppm import Model, ngrams

HARD = [None, "", " \n\t ", "é", "a", "\x00\x01", "日本語 テキスト", "x " * 3000, "long" * 5000, "a b c d"]
SPACE = re.compile("[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def flat_of(texts):
    raw = [t.encode() for t in texts]
    return Flat(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def hard(docs_of, more=()):
    rows = list(enumerate([*HARD, *more]))
    return docs_of([*rows, rows[-1], (None, "no id here"), (3, "another text of three")])


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_words_and_grams_equal_plain_python():
    texts = ["Ab  b\tc", "", "c", "é é x", " "]
    words = Words(flat_of(texts))
    assert words.counts.tolist() == [3, 0, 1, 3, 0]
    h = words.hashes()
    assert h[3] == h[2] and h[4] == h[5] and len(set(h.tolist())) == 5  # Ab b c | c | é é x
    at, gram = words.grams(h, 2)
    assert at.tolist() == [0, 1, 4, 5] and len(set(gram.tolist())) == 4


# ---------------------------------------------------------------- 1 and 4: byte contexts


def _code_length(texts, text, order, kept):
    """Escape method C with exclusion, from counts in dictionaries."""
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        s = [256] * order + list(t.encode()) + [256]
        for i in range(order, len(s)):
            for o in range(order + 1):
                counts[tuple(s[i - o : i])][s[i]] += 1
    s = [256] * order + list(text.encode()) + [256]
    bits = 0.0
    for i in range(order, len(s)):
        excluded, p = set(), 1.0
        o = next(o for o in range(order, -1, -1) if all(j == 0 or kept(sum(counts[tuple(s[i - j : i])].values())) for j in range(o + 1)))
        for j in range(o, -1, -1):
            open_ = {x: c for x, c in counts[tuple(s[i - j : i])].items() if x not in excluded}
            if not open_:
                continue
            weight = sum(open_.values()) + len(open_)
            if s[i] in open_:
                p *= open_[s[i]] / weight
                break
            p *= len(open_) / weight
            excluded |= set(open_)
        else:
            p /= 257 - len(excluded)
        bits -= math.log2(p)
    return bits


@pytest.mark.parametrize("order", [1, 3, 5, 6])
def test_code_lengths_equal_a_plain_model(order):
    texts = ["abracadabra", "abra", "", "cad é abrac", "banana bandana"]
    total = sum(len(t.encode()) + 1 for t in texts)
    model = Model([ngrams(flat_of(texts), order)], order, most=20)
    asked = [*texts, "zzzz", "abrab", "日本"]
    got = model.bits(flat_of(asked))[:, 0]
    want = [_code_length(texts, t, order, lambda n: n >= 2 and n * 20 >= total) for t in asked]
    assert np.allclose(got, want, rtol=1e-4)


def test_model_is_a_probability():
    model = Model([ngrams(flat_of(["abracadabra", "abra", "cad é"]), 4)], 4)
    total = np.exp2(-model.table.reshape(model.nodes, model.width).astype(float))
    unseen = 257 - (model.width - 1)
    assert np.allclose(total[:, :-1].sum(1) + unseen * total[:, -1], 1, atol=1e-5)
    assert np.allclose(Model([], 3).bits(flat_of(["ab", ""]))[:, 0], [3 * np.log2(257), np.log2(257)], rtol=1e-5)


def test_language_is_learned_from_labelled_rows_only(spark, docs_of):
    rng = random.Random(1)
    english, german = "the and of that with this from".split(), "der und nicht für über sch eine".split()
    rows = [(i, prose(rng, english if i % 2 else german, 30)) for i in range(200)]
    docs = docs_of(rows, lang=["en" if i % 2 else "de" for i in range(200)])
    langs, model = op1_language.train(docs.where(bucket(F.col("doc_id"), 4) != 2))
    assert langs == ["de", "en"]
    found = op1_language.identify(docs, langs, model).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") and 0.5 < r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    odd = op1_language.identify(hard(docs_of), langs, model).collect()
    assert len(odd) == len(HARD) + 3
    assert {r.lang_pred for r in odd if r.doc_id in (0, 1, 2, 5)} == {"und"} and {r.lang_pred for r in odd if r.doc_id in (4, 6)} <= {"de", "en"}
    none = op1_language.identify(docs, *op1_language.train(docs.limit(0)))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert op1_language.identify(docs.limit(0), langs, model).count() == 0


def test_word_scores_equal_brute_force(spark, docs_of):
    rng = random.Random(2)
    docs = hard(docs_of, [prose(rng, "aa bb cc dd ee ff gg".split(), rng.randrange(1, 60)) for _ in range(40)]).withColumn("key", F.lit("clash"))
    held = bucket(F.col("doc_id"), 7) == 2
    found = op4_lm_score.score(docs, docs.where(~held)).collect()
    assert len(found) == docs.count()
    rows = [(r.doc_id, SPACE.findall((r.text or "").translate(LOWER)) + [None]) for r in docs.collect()]
    counts = collections.Counter(w for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 4)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == want
    assert all(r.score < 0 for r in found)
    empty = op4_lm_score.score(docs.limit(3), docs.limit(0)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in empty)


@pytest.mark.parametrize(("most", "held"), [(3, 20), (3, 2_000_000), (60_000, 1)])
def test_byte_scores_keep_all_contexts_seen_twice(docs_of, monkeypatch, most, held):
    monkeypatch.setattr(op4_lm_score, "HEAVY_GRAMS", held, raising=False)
    rng = random.Random(21)
    docs = docs_of(list(enumerate(["", "é", None, "zq", *[prose(rng, "abra cadabra banana rare é axe".split(), rng.randrange(1, 15)) for _ in range(25)]])))
    train = docs.where("doc_id % 3 > 0")
    texts = [r.text or "" for r in train.collect()]
    want = {r.doc_id: -_code_length(texts, r.text or "", op4_lm_score.ORDER, lambda n: n >= 2) * math.log10(2) for r in docs.collect()}
    found = {r.doc_id: r.score for r in op4_lm_score.score(docs, train, max_contexts=most).collect()}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-4 * -want[i] for i in want)


# ---------------------------------------------------------------- 2


def test_license_places_equal_brute_force(docs_of):
    rng = random.Random(3)
    words = "mit license apache cc by gnu general public x".split()
    docs = hard(docs_of, [prose(rng, words, rng.randrange(1, 80)) for _ in range(60)] + ["Licensed under CC BY-NC 4.0. The MIT-License!", "Licensed under the Apache License, Version 2.0"])
    found = op2_license.scan(docs).collect()
    assert len(found) == docs.count()
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def base(text):
        w = pattern.findall((text or "").translate(LOWER))
        return len(w), sorted((t.label, i) for t in op2_license.PHRASES for p in [t.text.split()] for i in range(len(w)) if w[i : i + len(p)] == p)

    assert sorted((r.n_words, sorted((s.label, s.start) for s in r.spans if s.phrase)) for r in found) == sorted(base(r.text) for r in docs.collect())
    labels = {s.label for r in found for s in r.spans}
    assert {"cc-by-nc-4.0", "apache-2.0"} <= labels
    assert op2_license.scan(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 3

_PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data_equals_brute_force(docs_of):
    rng = random.Random(4)
    parts = ["a@b.c", "x.y@m-1.co.uk", "@", ".", "-", " ", "+", "1", "12", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1", "001.002.003.255", "+1 (201) 555-0123", "é", "日", "a", "\n", "(", ")", "0", "5", "_x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    texts += ["Call (974) 555-3436 or 555-12-3456.", "1" * 20000, "a.b" * 3000 + "@x.y", "+1" * 4000, "1 2-" * 5000, "x@" + "a.b-" * 4000, "a@b.c@d.e_f@g.h"]
    docs = hard(docs_of, texts)
    found = op3_pii.detect(docs).collect()
    assert len(found) == docs.count()

    def base(text):
        return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(_PII) for m in re.finditer(p, text or "") if _valid(kind, m[0]))

    assert sorted([tuple((s.start, s.order, s.end) for s in r.spans if s.base) for r in found]) == sorted(tuple(base(r.text)) for r in docs.collect())
    assert op3_pii.detect(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 5


def test_benchmark_passages_equal_brute_force(spark, docs_of):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [prose(rng, vocabulary, n) for n in (3, 12, 20, 20, 35, 60)] + [None, "", "W1 w2"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = []
    for _ in range(80):
        w = prose(rng, vocabulary, rng.randrange(0, 80)).split()
        if rng.random() < 0.6:
            passage = (rng.choice([i for i in items if i])).split()
            for _ in range(rng.randrange(3)):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else " \n".join(w))
    docs = docs_of(list(enumerate(texts)) + [(900, None), (901, "")])
    found = {(r.doc_id, r.item_id): r.similarity for r in op5_decontaminate.find(docs, benchmark).collect()}

    def grams(w):
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {i: grams((t or "").lower().split()) for i, t in enumerate(items) if (t or "").split()}
    frequency = collections.Counter(g for s in sets.values() for g in s)
    weight = lambda g: 1 + math.log((len(sets) + 1) / (frequency[g] + 1))
    want = {}
    for i, t in enumerate(texts):
        w = t.lower().split()
        for j, s in sets.items():
            n = len(items[j].split())
            k = min(5, n)
            for at in range(max(1, len(w) - n + 1)):
                part = w[at : at + n]
                own = {tuple(part[x : x + k]) for x in range(len(part) - k + 1)}
                if common := sum(map(weight, own & s)):
                    similarity = common / (sum(map(weight, own | s)))
                    if similarity >= 0.8:
                        want[i, j] = max(want.get((i, j), 0), similarity)
    assert found.keys() == want.keys() and len(want) > 15
    assert all(abs(found[x] - want[x]) < 1e-5 for x in want)
    left = op5_decontaminate.clean(docs, benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {i for i, _ in want}
    assert op5_decontaminate.find(docs, benchmark.limit(0)).count() == 0 and op5_decontaminate.find(docs.limit(0), benchmark).count() == 0


def test_passages_in_another_order_are_found(spark, docs_of):
    rng = random.Random(23)
    item = [f"i{n}" for n in range(100)]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    around = lambda: [f"f{rng.randrange(10**6)}" for _ in range(80)]
    docs = docs_of([(1, " ".join(around() + item[50:] + item[:50] + around())), (2, " ".join(around() + item[50:] + around())), (3, " ".join(item[50:] + item[:50]))])
    found = {r.doc_id: r for r in op5_decontaminate.find(docs, benchmark).collect()}
    assert set(found) == {1, 3} and found[1].first_word == 80 and abs(found[1].similarity - 92 / (96 + 4 * (1 + math.log(2)))) < 1e-5
    assert {r.doc_id for r in op5_decontaminate.clean(docs, benchmark).collect()} == {2}
    shared = docs.withColumn("doc_id", F.lit(None).cast("long")).withColumn("row", F.lit("clash"))
    assert [r.text for r in op5_decontaminate.clean(shared, benchmark).collect()] == [docs.where("doc_id = 2").first().text]


def test_blocks_find_all_fingerprints_in_the_radius(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(op5_decontaminate.RADIUS + 1)):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(F.arrays_overlap(op5_decontaminate._blocks(F.col("a")), op5_decontaminate._blocks(F.col("b")))).count() == 300


# ---------------------------------------------------------------- 6


def _components(rows):
    sets = []
    for _, t in rows:
        w = SPACE.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), (d if not s else least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))], len({root(i) for i in range(len(rows))})


def test_components_equal_brute_force(docs_of):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(60)]
    common = prose(rng, vocabulary, 60)
    texts = []
    for _ in range(25):
        base = prose(rng, vocabulary, rng.choice([3, 5, 9, 30, 80, 200])).split()
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
            texts.append(" ".join(w))
    texts += [f"{common} {prose(rng, vocabulary, 12)}" for _ in range(30)]
    docs = hard(docs_of, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = op6_jaccard.link_classes(docs).collect()
    want, groups = _components(rows)
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    one = op6_jaccard.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == groups
    assert op6_jaccard.link_classes(docs.limit(0)).count() == 0


def test_sets_that_link_share_a_block():
    rng = np.random.default_rng(8)
    linked = 0
    for _ in range(1500):
        n = int(np.exp(rng.uniform(0.7, 6.2)))
        a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, len(a) - rng.integers(0, len(a) // 6 + 2))], rng.integers(1, 2**63, rng.integers(0, len(a) // 6 + 2), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        union = len(a) + len(b) - common
        if 100 * common >= 85 * union and common < union:
            hot = np.sort(rng.permutation(a)[: int(rng.choice([0, 0.3, 1]) * len(a))].view(np.int64))
            doc, key = op6_jaccard._block_keys(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]), 85, hot)
            assert set(key[doc == 0]) & set(key[doc == 1])
            linked += 1
    assert linked > 300


@pytest.mark.parametrize("few", [0, graph.FEW])
def test_components_of_paths_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


# ---------------------------------------------------------------- 7


def test_quality_counts_equal_brute_force(docs_of):
    rng = random.Random(9)
    texts = ["\n".join(prose(rng, "a b # $x y|z".split(), rng.randrange(0, 9)) for _ in range(rng.randrange(1, 12))) for _ in range(80)]
    docs = hard(docs_of, texts).withColumn("kept", F.lit("clash"))
    found = op7_quality.judge(docs).collect()

    def base(text):
        text = text or ""
        w = SPACE.findall(text)
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w)

    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == sorted(base(r.text) for r in docs.collect())
    assert not any(r.kept and r.base_failed for r in found)


def test_lines_that_fail_go(docs_of):
    good = "This is a clean line of words that a reader would like to keep here.\nAnother such line has quite a few words in it too, as lines do."
    junk = "Home | About | News | Contact | Login\nBUY!! NOW!! CHEAP!! OFFER!!\n%%% a%%% b%%% c%%%"
    docs = docs_of([(1, f"{good}\n{junk}"), (2, junk * 5), (3, good), (4, None), (5, f"Copyright. All rights reserved.\n\n{good}")])
    out = {r.doc_id: r for r in op7_quality.judge(docs, max_loss=0.6, keep_columns=True).collect()}
    assert set(out) == {1, 3, 5} and out[1].text == good + "\n" and out[3].text == good and out[5].text == f"\n{good}"
    assert out[1].n_chars == len(out[1].text)
    assert op7_quality.judge(docs.limit(0), keep_columns=True).count() == 0


# ---------------------------------------------------------------- 8


def _full_viterbi(field, feats):
    e = field.scores(feats)
    best, back = e[0].copy(), []
    for t in range(1, len(e)):
        step = best[:, None] + field.moves
        back.append(step.argmax(0))
        best = e[t] + step.max(0)
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_secrets_equal_brute_force(docs_of):
    rng = random.Random(10)
    parts = ["password", "Token", "api_key", "apikey", ' "', "'", "=", ":", " = ", "abcdef12", "AKIA", "ABCDEFGH12345", "0123456789abcdef" * 2, "deadbeef", " ", "\n", "é", "x", "secreſt"]
    docs = hard(docs_of, ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 20))) for _ in range(300)])
    field = op8_secrets.train(docs)
    found = op8_secrets.scan(docs, field).collect()
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)

    def base(text):
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        return tuple((op8_secrets.KINDS[k], s, e) for s, k, e in sorted(spans))

    assert sorted(tuple((s.kind, s.start, s.end) for s in r.spans if s.kind != "field") for r in found) == sorted(base(r.text) for r in docs.collect())
    clean = {r.doc_id: r for r in op8_secrets.scan(docs.where("doc_id > 20"), field, redact="[secret]").collect()}
    before = {r.doc_id: r.text for r in docs.where("doc_id > 20").collect()}
    assert clean.keys() == before.keys()
    assert all(("[secret]" in clean[i].text) if base(t) else ("[secret]" in clean[i].text or clean[i].text == t) for i, t in before.items())
    assert op8_secrets.scan(docs.limit(0), field).count() == 0


def test_decoding_is_exact():
    rng = np.random.default_rng(11)
    field = op8_secrets.Field()
    field.weights = rng.normal(0, 1.0, field.weights.shape)
    field.weights[:, op8_secrets.OUTSIDE] += 0.4
    field.moves = rng.normal(0, 1.0, (3, 3))
    texts = [" ".join(rng.choice(list("abc1=:")) * int(rng.integers(1, 9)) for _ in range(int(rng.integers(0, 60)))) for _ in range(50)]
    words, feats = op8_secrets.features(flat_of(texts))
    got = field.decode(words, feats)
    for d in range(len(texts)):
        a, b = words.docs[d], words.docs[d + 1]
        if b > a:
            assert got[a:b].tolist() == _full_viterbi(field, feats[a:b])


# ---------------------------------------------------------------- 10


def test_mixing_meets_targets_and_drops_toxic(spark, docs_of):
    rng = random.Random(12)
    clean, junk, bad = [f"w{i}" for i in range(300)], ["%%%", "|", "###"], ["vile", "awful", "nasty"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(40)]
        toxic, poor = i % 10 == 0, i % 7 == 0
        w += [rng.choice(bad) for _ in range(4)] if toxic else []
        w += [rng.choice(junk) for _ in range(30)] if poor else []
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(not poor), int(toxic)))
    labels += [(None, 1, 1), (1, None, 0), (3, 1, None)]
    docs = docs_of(rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in op10_mixing.mix(docs, table).collect()}
    toxic = {i for i in range(600) if i % 10 == 0}
    assert len(toxic & set(out)) <= 3 and len(set(range(600)) - toxic - set(out)) <= 3
    total = sum(40 + 4 * (i % 10 == 0) + 30 * (i % 7 == 0) for i in range(600))
    good = sum(r.rate * r.n_tokens * r.p_good for r in out.values()) / total
    assert abs(good - 0.9) < 0.03
    model = op10_mixing.train(docs, table.limit(0))
    assert op10_mixing.memberships(docs, model).count() == 600
    assert op10_mixing.fit_steps(op10_mixing.memberships(docs.limit(0), model)) == []
    assert op10_mixing.memberships(hard(docs_of), op10_mixing.train(docs, table)).count() == len(HARD) + 3


def test_steps_solve_least_squares(spark):
    rng = np.random.default_rng(13)
    p = rng.dirichlet([1, 1, 1], 200).round(6)
    rows = [(i, *map(float, x), int(rng.integers(1, 50))) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id long, p_good double, p_poor double, p_toxic double, n_tokens long")
    out = op10_mixing.rates(df, op10_mixing.fit_steps(df, {"good": 0.5, "poor": 0.3, "toxic": 0.2})).collect()
    total = sum(r.n_tokens for r in out)
    got = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in out) / total for d in op10_mixing.DOMAINS]
    assert np.allclose(got, [0.5, 0.3, 0.2], atol=1e-4) and min(r.rate for r in out) >= 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, docs_of, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    words = [f"w{i}" for i in range(500)]
    passage = prose(rng, words, 40)
    rows = [(i, prose(rng, words, 60)) for i in range(60)]
    rows += [(100, rows[5][1]), (101, rows[6][1] + " tail"), (102, f"{prose(rng, words, 30)} {passage} {prose(rng, words, 30)}"), (103, "a | b | c | d\n" * 10), (104, prose(rng, words, 40) + ' token = "0123456789abcdef0123456789abcdef" ' + prose(rng, words, 20)), (105, None)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(60)) | {104}
    assert "[secret]" in out[104].text and "0123456789abcdef" not in out[104].text
    assert all(r.rate > 0 for r in out.values())
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_pipeline_drops_near_copies_at_its_own_limits(spark, docs_of):
    import corpus_pipeline

    rng = random.Random(22)
    rows = []
    for g in range(12):
        base = [f"g{g}x{i}" for i in range(100)]
        rows.append((10 * g, " ".join(base)))
        for n in (1, 2, 3, 4):
            w = list(base)
            for at in rng.sample(range(6, 94, 6), n):
                w[at] = f"changed{g}n{n}a{at}"
            rows.append((10 * g + n, " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    component = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                component = [component[j] if c == component[i] else c for c in component]
    want = {min(rows[i][0] for i, c in enumerate(component) if c == x) for x in component}
    assert {10 * g for g in range(12)} < want and not {10 * g + 2 for g in range(12)} & want
    assert {r.doc_id for r in corpus_pipeline.deduplicate(spark, docs_of(rows), "").collect()} == want


@pytest.mark.parametrize("name", ["documents", "pages"])
def test_queries_are_registered(name):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_shares_of_any_number_of_rows():
    for total in (10**3, 10**9, 2 * 10**9, 10**10, 10**13):
        assert total * common.share_of(1500, total) == pytest.approx(min(total, 1500))
    assert common.share_of(5000, 0) == 1.0


def test_chances_are_even_and_fine(spark):
    found = spark.range(200_000).select(common.chance("id", F.lit("x")).alias("c"))
    low, high, n, few = found.agg(F.min("c"), F.max("c"), F.count_if(F.col("c") < 0.25), F.count_if(F.col("c") < 1e-4)).first()
    assert 0 <= low < 1e-4 and 1 - 1e-4 < high <= 1 and abs(n - 50_000) < 1000 and 3 <= few <= 60


def test_each_language_is_learned(spark, docs_of):
    docs = docs_of([(i, f"word{i} and text of a language") for i in range(400)], lang=["rare" if i == 9 else "often" for i in range(400)])
    assert op1_language.train(docs, 20)[0] == ["often", "rare"]


def test_short_hex_texts_do_not_slow_each_other():
    flat_of = lambda n: common.flat(pa.array(["abcdef012345"] * n + ["a" * 40, "b" * 31, "AKIA" + "Z" * 16, "AKIAZ"]))
    began = time.perf_counter()
    found = op8_secrets.base_spans(flat_of(20_000))
    assert time.perf_counter() - began < 2
    assert [(d - 20_000, kind, e - s) for d, kind, s, e in found] == [(2, 1, 20), (0, 2, 40)]


def test_paths_beyond_the_rounds_are_an_error(spark):
    links = spark.range(2000).selectExpr("id as a", "id + 1 as b")
    with pytest.raises(RuntimeError, match="aren't found"):
        graph.components(links, rounds=2)
    assert graph.components(links).select("component").distinct().count() == 1


def plain_shares(p, n, goal, steps):
    """Shares after a plain projected gradient over documents, and its metric."""
    metric = np.linalg.inv((p * n[:, None]).T @ p / n.sum() + 1e-6 * np.eye(3))
    rate = np.ones(len(n))
    for _ in range(steps):
        rate = np.maximum(0, rate - p @ (metric @ ((p * (n * rate)[:, None]).sum(0) / n.sum() - goal)))
    return (p * (n * rate)[:, None]).sum(0) / n.sum(), metric


@pytest.mark.parametrize(
    ("floor", "targets", "meets"),
    [(0.0, {"good": 0.5, "poor": 0.3, "toxic": 0.2}, True), (0.06, {"good": 0.9, "poor": 0.1, "toxic": 0.0}, False)],
)
def test_rates_solve_nonnegative_least_squares(spark, floor, targets, meets):
    """With targets that can be met, and with some that can't, as all documents have a little of all."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([2, 1, 1], 12)[rng.integers(0, 12, 300)]
    p = (floor + (1 - 3 * floor) * p).round(6)
    n = rng.integers(1, 90, 300)
    df = spark.createDataFrame([(i, *map(float, x), int(k)) for i, (x, k) in enumerate(zip(p, n, strict=True))], "doc_id long, p_good double, p_poor double, p_toxic double, n_tokens long")
    taken = op10_mixing.fit_steps(df, targets, close=1e-6)
    assert taken.converged
    rate = np.array([r.rate for r in op10_mixing.rates(df, taken).orderBy("doc_id").collect()])
    goal = np.array([targets[d] for d in op10_mixing.DOMAINS])
    shares = (p * (n * rate)[:, None]).sum(0) / n.sum()
    assert np.allclose(shares - goal, [taken.residual[d] for d in op10_mixing.DOMAINS], atol=1e-5)
    best, metric = plain_shares(p, n, goal, 60_000)
    cost = lambda s: (s - goal) @ metric @ (s - goal)
    assert cost(shares) < cost(best) + 1e-5
    assert (np.abs(shares - goal).max() < 1e-4) == meets
    short = op10_mixing.fit_steps(df, targets, most_steps=2, close=1e-9)
    assert len(short) == 2 and not short.converged and max(map(abs, short.residual.values())) > 0


def test_mixing_by_brute_force(spark, docs_of):
    """The whole operator: rates of a corpus whose posteriors are known, against plain steps."""
    rng = random.Random(5)
    words = {"good": [f"g{i}" for i in range(40)], "poor": ["%%%", "|", "###"], "toxic": ["vile", "awful"]}
    rows, labels = [], []
    for i in range(300):
        kind = ("good", "poor", "toxic")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]
        w = [rng.choice(words["good"]) for _ in range(30)] + [rng.choice(words[kind]) for _ in range(12)]
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    docs, table = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = op10_mixing.train(docs, table)
    members = op10_mixing.memberships(docs, model).orderBy("doc_id").collect()
    p, n = np.array([[r[f"p_{d}"] for d in op10_mixing.DOMAINS] for r in members]), np.array([r.n_tokens for r in members])
    assert (p.argmax(1) == [0 if i % 10 < 7 else 1 if i % 10 < 9 else 2 for i in range(300)]).all()
    kept = {r.doc_id: r.rate for r in op10_mixing.mix(docs, table).collect()}
    rate = np.array([kept.get(i, 0.0) for i in range(300)])
    goal = np.array([op10_mixing.TARGETS[d] for d in op10_mixing.DOMAINS])
    best, metric = plain_shares(p, n, goal, 20_000)
    shares = (p * (n * rate)[:, None]).sum(0) / n.sum()
    assert (shares - goal) @ metric @ (shares - goal) < (best - goal) @ metric @ (best - goal) + 1e-3
    assert not set(kept) & {i for i in range(300) if i % 10 == 9} and {i for i in range(300) if i % 10 < 9} <= set(kept)


def test_languages_by_brute_force(spark, docs_of, tmp_path):
    """The whole query: each text goes to the language whose plain model codes it in the fewest bits."""
    rng = random.Random(21)
    words = {"en": "the and of water house night under".split(), "de": "der und von wasser haus nacht unter".split(), "fr": "le et de eau maison nuit sous été".split()}
    rows, lang = [], []
    for i in range(60):
        own = ("en", "de", "fr")[i % 3]
        rows.append((i, prose(rng, words[own], 6)))
        lang.append(own if i % 7 else None)
    rows += [(60, None), (61, "123 456"), (62, ""), (63, "le 12 nuit"), (None, "water house"), (3, "der wasser")]
    lang += ["en", "de", "fr", None, None, "de"]
    docs_of(rows, lang=lang).withColumn("lang_pred", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 4 == 2
    taught = {x: [t for (i, t), y in zip(rows, lang, strict=True) if y == x and t is not None and not held(i)] for x in words}
    langs = sorted(taught)
    want = []
    for i, t in rows:
        bits = [_code_length(taught[x], t, 3, lambda n: n >= 2) for x in langs] if t else []
        letters = any(c.isalpha() for c in t or "")
        want.append((i, held(i), langs[int(np.argmin(bits))] if letters else "und", 1 / sum(2.0 ** min(min(bits) - b, 0) for b in bits) if letters else 0.0))
    found = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in op1_language.op1_language_id(spark, str(tmp_path)).collect()]
    key = lambda r: (repr(r[0]), r[2], r[3])
    for a, b in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-3
