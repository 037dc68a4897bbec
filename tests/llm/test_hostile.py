"""Every operator on nulls, odd texts, repeated rows, clashing columns and empty tables."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veridat.llm import op1_language, op2_license, op4_lm_score, op5_decontaminate, op6_jaccard, op7_quality, op8_secrets, op10_mixing
from veridat.llm.op2_license import NOTICES, PHRASES

from test_corpus import hard, prose

CLASHES = "rid row base head key kind spans kept label template gram pos window size start first value hot_ cold_ salt_ value_ p_good rate n_tokens good toxic s0 group".split()


@pytest.fixture
def odd(docs_of):
    """Hard rows, and columns of the names that plans use themselves."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return hard(docs_of, [long, "mit license " * 30, "\n" * 500]).select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def test_clashing_columns_do_not_matter(spark, odd):
    n = odd.count()
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    same = lambda a, b: sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))
    langs, model = op1_language.train(odd)
    for run in (
        lambda d: op1_language.identify(d, langs, model),
        lambda d: op2_license.scan(d).drop("rid"),
        lambda d: op6_jaccard.link_classes(d),
        lambda d: op7_quality.judge(d),
        lambda d: op4_lm_score.score(d, d),
    ):
        found = run(odd)
        assert found.count() == n and same(found, run(plain))


def test_filters_keep_the_columns_of_their_input(spark, odd):
    benchmark = spark.createDataFrame([(1, "no such passage anywhere in these texts at all"), (2, None)], "item_id long, text string").withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(0, 1, 0), (7, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert op5_decontaminate.clean(odd, benchmark).columns == odd.columns and op5_decontaminate.clean(odd, benchmark).count() == odd.count()
    assert op7_quality.judge(odd, keep_columns=True).columns == odd.columns
    assert op6_jaccard.one_of_each(odd).columns == odd.columns
    mixed = op10_mixing.mix(odd, labels)
    assert set(odd.columns) <= set(mixed.columns) and all(r.rate > 0 for r in mixed.collect())


def test_empty_tables(spark, docs_of):
    none = docs_of([(1, "x")]).limit(0)
    some = docs_of([(1, "a few words of text"), (2, None)])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    langs, model = op1_language.train(none)
    assert langs == [] and op1_language.identify(none, langs, model).count() == 0
    assert op2_license.scan(none).count() == 0
    assert op4_lm_score.score(none, none).count() == 0 and op4_lm_score.score(none, some).count() == 0
    (a, b) = op4_lm_score.score(some, none).orderBy("doc_id").collect()
    assert (a.n_known, a.train_tokens, a.n_tokens, b.n_tokens) == (0, 0, 6, 1)
    # without any count each symbol, and the end, takes the bits of one of 257
    assert math.isclose(b.score, -math.log10(257), rel_tol=1e-5) and math.isclose(a.score, -20 * math.log10(257), rel_tol=1e-5)
    assert op5_decontaminate.clean(none, benchmark).count() == 0 and op5_decontaminate.clean(some, benchmark).count() == 2
    assert op6_jaccard.one_of_each(none).count() == 0 and op7_quality.judge(none).count() == 0
    assert op8_secrets.scan(none, op8_secrets.train(none)).count() == 0
    assert op10_mixing.mix(none, labels).count() == 0 and op10_mixing.mix(some, labels).count() == 2


def test_pipeline_of_an_empty_table(spark, docs_of, tmp_path):
    import corpus_pipeline

    docs_of([(1, "x")]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# ---------------------------------------------------------------- 2: labels and scores of the method


def _license_spans(text, k=4, slack=2, least=0.6):
    """Diagonal voting in plain Python: (label, score) of each verified span."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
    out = []
    for t in PHRASES + NOTICES:
        own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.text)
        width = len(own) if t.phrase else min(k, len(own))
        grams = len(own) - width + 1
        votes = collections.defaultdict(list)
        for i in range(len(words) - width + 1):
            for j in range(grams):
                if words[i : i + width] == own[j : j + width]:
                    votes[i - j].append(i)
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][-1] <= (0 if t.phrase else slack):
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            at = [i for d in g for i in votes[d]]
            score = min(1.0, len(at) / grams)
            length = max(at) + width - min(at)
            if len(at) >= grams if t.phrase else score >= least and length <= 1.5 * len(own) + slack:
                out.append((t.label, round(score, 9)))
    return sorted(out)


def test_license_labels_equal_brute_force(docs_of):
    rng = random.Random(61)
    filler = "river garden paper license the software free of any gnu mit".split()
    texts = []
    for i in range(120):
        parts = [prose(rng, filler, rng.randrange(0, 12))]
        for _ in range(rng.randrange(3)):
            words = rng.choice(PHRASES + NOTICES).text.split()
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [rng.choice(filler)] * rng.randrange(2)
            parts += [" ".join(words), prose(rng, filler, rng.randrange(0, 12))]
        texts.append(" ".join(parts))
    found = {r.doc_id: sorted((s.label, round(s.score, 9)) for s in r.spans) for r in op2_license.scan(docs_of(list(enumerate(texts)))).collect()}
    want = {i: _license_spans(t) for i, t in enumerate(texts)}
    assert found == want and sum(len(set(x for x, _ in w)) for w in want.values()) > 100


# ---------------------------------------------------------------- 10: the classifier


def test_posteriors_rank_held_out_rows(spark, docs_of):
    rng = random.Random(62)
    plain, slurs, junk = [f"w{i}" for i in range(400)], [f"bad{i}" for i in range(12)], [f"junk{i}" for i in range(30)]
    rows, labels, truth = [], [], {}
    for i in range(900):
        toxic, poor = rng.random() < 0.15, rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(50)] + [rng.choice(slurs) for _ in range(4 * toxic)] + [rng.choice(junk) for _ in range(12 * poor)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        truth[i] = "toxic" if toxic else "poor" if poor else "good"
        if i % 3:
            labels.append((i, int(not poor), int(toxic)))
    docs = docs_of(rows)
    model = op10_mixing.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r.doc_id: max(op10_mixing.DOMAINS, key=lambda d: r[f"p_{d}"]) for r in op10_mixing.memberships(docs, model).collect()}
    held = [i for i in truth if i % 3 == 0]
    assert sum(found[i] == truth[i] for i in held) >= 0.97 * len(held)


@pytest.mark.parametrize(("common", "own"), [(170, 30), (100, 100)])
def test_recall_on_items_of_one_template(spark, common, own):
    """Benchmarks whose items share most of their words: of the passages with one to three words
    changed that are similar enough by exact weights, the index finds nearly all."""
    rng = random.Random(1)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    base = [f"t{i}" for i in range(common)]
    items = [base[: common // 2] + [f"i{j}x{i}" for i in range(own)] + base[common // 2 :] for j in range(80)]
    having = collections.Counter(s for w in items for s in grams(w))
    weight = lambda s: 1 + math.log((1 + len(items)) / (1 + having[s]))
    docs, want = [], set()
    for d in range(120):
        j = rng.randrange(len(items))
        w = list(items[j])
        for _ in range(rng.choice([1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"new{d}x{rng.random()}"
        docs.append((d, " ".join(w)))
        a, b = grams(w), grams(items[j])
        if sum(map(weight, a & b)) >= 0.8 * sum(map(weight, a | b)):
            want.add((d, j))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in op5_decontaminate.find(*frames).collect()}
    assert len(want) > 60 and len(want & found) >= 0.95 * len(want)
