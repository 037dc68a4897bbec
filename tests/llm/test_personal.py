"""Personal data beyond the fixed patterns: votes, estimates, and planted held-out cases."""

import random

from pyspark.sql import functions as F

from veridat.llm import op3_pii

from test_corpus import hard, prose

WORDS = "the of and water light river garden over under between stone paper window market small open road".split()


def test_estimates_follow_the_votes():
    counts = [(0, 1, 1, 1, 1, 1, 50), (0, 1, -1, -1, -1, -1, 50), (4, 0, 1, 1, 1, 1, 20), (4, 0, -1, 0, -1, -1, 20), (4, 0, 1, -1, 1, 1, 2)]
    post = op3_pii.estimate(counts)
    formed = [(*c[:-1], 1, 2, 1, c[-1]) for c in counts]
    score = op3_pii.classifier(formed, post)
    for key in ((4, 0, 1, 1, 1, 1), (0, 1, 1, 1, 1, 1)):
        assert post[key] > 0.9 and score[(*key, 1, 2, 1)] > 0.75
    for key in ((4, 0, -1, 0, -1, -1), (4, 0, 1, -1, 1, 1)):
        assert post[key] < 0.3 and score[(*key, 1, 2, 1)] < 0.5


def test_many_spans_can_overrule_what_is_expected():
    # a context that speaks for spans which all else speaks against
    counts = [(4, 0, -1, 1, -1, -1, 20_000), (4, 0, 1, 0, 1, 1, 20_000)]
    chance = op3_pii.estimate([*counts, (4, 0, 0, 1, 1, 0, 1)])
    plain = op3_pii.estimate([(4, 0, 0, 1, 1, 0, 1)])
    assert chance[(4, 0, 0, 1, 1, 0)] < plain[(4, 0, 0, 1, 1, 0)]


def test_forms_change_the_classifier():
    votes = (4, 0, 1, 0, 1, 1)
    counts = [(*votes, 1, 2, 1, 40), (*votes, 3, 0, 3, 40), (4, 0, -1, 0, 1, -1, 3, 0, 3, 400)]
    score = op3_pii.classifier(counts, {votes: 0.9, (4, 0, -1, 0, 1, -1): 0.02})
    assert score[(*votes, 1, 2, 1)] > score[(*votes, 3, 0, 3)]


HELD_OUT = {
    "local_phone": ("call me at 555-234-{d}", "phone (415) 672-{d}", "my contact 646 291 {d}"),
    "ssn": ("social security 123-45-{d}", "her ssn 219-09-{d}"),
    "iban": ("bank account DE89370400440532{d}00", "iban GB29NWBK60161331{d}19"),
    "name": ("dear Mr. Albert Fields", "sincerely Frau Anke Vogt"),
    "person": ("my name is John Smith", "signed by Jane Doe", "contact Maria Müller", "hello Pierre Durand"),
    "street": ("lives at 12 Old Mill Road", "visit 450 Green Park Avenue"),
}
HARMLESS = ("order 555-234-{d}", "version 123-45-{d}", "Licensed under the Apache License", "GNU General Public License", "page 12 of 30", "The Old Man", "build 646 291 {d}", "invoice 219-09-{d}", "New York Times")


def test_held_out_cases_and_harmless_ones(docs_of):
    rng = random.Random(51)
    rows, planted = [], {}
    for i in range(180):
        kind = list(HELD_OUT)[i % len(HELD_OUT)]
        planted[i] = (kind, rng.choice(HELD_OUT[kind]).format(d=rng.randrange(1000, 9999)))
        rows.append((i, f"{prose(rng, WORDS, 15)} {planted[i][1]} {prose(rng, WORDS, 15)}"))
    for i in range(180, 360):
        rows.append((i, f"{prose(rng, WORDS, 15)} {HARMLESS[i % len(HARMLESS)].format(d=rng.randrange(1000, 9999))} {prose(rng, WORDS, 15)}"))
    found = {r.doc_id: r.spans for r in op3_pii.detect(docs_of(rows)).collect()}
    hits = sum(any(s.kind == kind for s in found[i]) for i, (kind, _) in planted.items())
    wrong = [rows[i][1][s.start : s.end] for i in range(180, 360) for s in found[i]]
    assert hits >= 0.95 * len(planted) and len(wrong) <= 9, (hits, wrong)


def test_context_decides(docs_of):
    one = {r.doc_id: [s.kind for s in r.spans] for r in op3_pii.detect(docs_of([(1, "order 555-123-4567 version 123-45-6789"), (2, "call 555-123-4567, ssn 123-45-6789")])).collect()}
    assert one == {1: [], 2: ["local_phone", "ssn"]}


def test_numbers_that_stand_together(docs_of):
    text = "pay 4465758382889437 4465758382889437 now"
    (row,) = op3_pii.detect(docs_of([(1, text)])).collect()
    assert [(s.kind, text[s.start : s.end]) for s in row.spans] == [("card_in_run", "4465758382889437")] * 2


def test_clashing_columns_and_empty_tables(docs_of):
    odd = hard(docs_of).withColumn("rid", F.lit("clash")).withColumn("kind", F.lit("clash")).withColumn("start", F.lit(1))
    assert op3_pii.detect(odd).count() == odd.count()
    assert op3_pii.detect(odd.limit(0)).count() == 0
