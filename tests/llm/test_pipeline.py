"""The whole pipeline against a plain version of its stages."""

import collections
import math
import random
import re

import duckdb

from veridat.llm.op7_quality import OP7_SQL

from test_corpus import prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = ["".join(random.Random(i).choices("ba den or the wa ter li ver gar sto ne pa dow mar num".split(), k=1 + i % 4)) for i in range(1200)]


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def quality(rows):
    db = duckdb.connect()
    db.sql("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    kept = {i for i, ok in db.sql(f"select doc_id, kept from ({OP7_SQL})").fetchall() if ok}
    return [(i, t) for i, t in rows if i in kept]


def one_of_each(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        least[g] = min(d, least.get(g, d))
    return [(d, t) for (d, t), g in zip(rows, group, strict=True) if least[g] == d]


def clean(rows, items):
    known = [shingles(t) for t in items]
    seen = collections.Counter(g for s in known for g in s)
    weight = lambda s: sum(1 + math.log((len(known) + 1) / (seen[g] + 1)) for g in s)

    def holds(text):
        w = text.lower().split()
        for item, own in zip(items, known, strict=True):
            n = len(item.split())
            for at in range(max(1, len(w) - n + 1)):
                part = shingles(" ".join(w[at : at + n]))
                if part & own and weight(part & own) >= (0.8 - 1e-9) * weight(part | own):
                    return True
        return False

    return [(i, t) for i, t in rows if not holds(t)]


def redacted(rows):
    return [(i, ASSIGN.sub(lambda m: "[secret]" if len(m[2]) >= 8 else m[0], t)) for i, t in rows]


def test_pipeline_equals_its_stages_in_plain_python(spark, docs_of, tmp_path):
    import corpus_pipeline

    rng = random.Random(71)
    items = [prose(rng, WORDS, n) for n in (12, 25, 40)]
    texts = []
    for _ in range(40):
        base = prose(rng, WORDS, rng.randrange(15, 120)).split()
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    for _ in range(25):
        passage = rng.choice(items).split()
        for _ in range(rng.randrange(6)):
            passage[rng.randrange(len(passage))] = rng.choice(WORDS)
        texts.append(" ".join([prose(rng, WORDS, rng.randrange(1, 40)), *passage, prose(rng, WORDS, rng.randrange(1, 40))]))
    for _ in range(15):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(6, 41)))
        texts.append(f"{prose(rng, WORDS, 30)} token = \"{value}\" {prose(rng, WORDS, 15)}")
    texts += ["%%% | a | b\n" * 12, prose(rng, WORDS, 6) + " ", "same words here again and again. " * 20, ""]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, len(rows), 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    steps = [quality(rows)]
    steps.append(one_of_each(steps[-1]))
    steps.append(clean(steps[-1], items))
    assert len(rows) > len(steps[0]) > len(steps[1]) > len(steps[2]) > 30
    found = {r.doc_id: r.text for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == dict(redacted(steps[-1]))


def test_labels_that_differ_reach_the_last_stage(spark, docs_of, tmp_path):
    """Toxic texts go and poor ones count less, whatever the stages before have removed; clean
    texts stay, and rates solve the least squares of the posteriors that the stage gives."""
    import corpus_pipeline
    import numpy as np

    from veridat.llm import op10_mixing

    rng = random.Random(72)
    bad, dull = ["vile", "awful", "nasty", "rotten"], ["lorem", "blah", "filler"]
    rows, labels, kinds = [], [], {}
    for i in range(240):
        kind = "toxic" if i % 8 == 0 else "poor" if i % 8 == 1 else "good"
        w = prose(rng, WORDS, rng.randrange(40, 90)).split()
        for word in rng.choices(bad if kind == "toxic" else dull, k=8) if kind != "good" else []:
            w.insert(rng.randrange(len(w)), word)
        kinds[i] = kind
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    rows += [(1000 + i, t) for i, t in rows[:20]]  # copies: the first stays
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(rng, WORDS, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = one_of_each(quality(rows))
    assert {i for i, _ in before} == set(kinds)
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.text for i, r in found.items()} == {i: t for i, t in redacted(before) if kinds[i] != "toxic"}
    assert max(r.rate for i, r in found.items() if kinds[i] == "poor") < max(r.rate for i, r in found.items() if kinds[i] == "good")
    members = op10_mixing.memberships(docs_of(before), op10_mixing.train(docs_of(before), spark.read.parquet(str(tmp_path / "labels.parquet")))).orderBy("doc_id").collect()
    p, n = np.array([[r[f"p_{d}"] for d in op10_mixing.DOMAINS] for r in members]), np.array([r.n_tokens for r in members])
    rate = np.array([found[r.doc_id].rate if r.doc_id in found else 0.0 for r in members])
    goal = np.array([op10_mixing.TARGETS[d] for d in op10_mixing.DOMAINS])
    metric = np.linalg.inv((p * n[:, None]).T @ p / n.sum() + 1e-6 * np.eye(3))
    shares = lambda r: (p * (n * r)[:, None]).sum(0) / n.sum() - goal
    plain = np.ones(len(n))
    for _ in range(20_000):
        plain = np.maximum(0, plain - p @ (metric @ shares(plain)))
    cost = lambda r: shares(r) @ metric @ shares(r)
    assert cost(rate) < cost(plain) + 1e-3
