"""Mixing to target weights with soft domain membership.

A classifier learned from the labels table gives each document a posterior for each
domain; distributed projected-gradient least squares then finds nonnegative document
rates (expected numbers of copies) whose expected tokens in each domain match the target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, kept, over_texts, passing_folders, signed, written

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.9, "poor": 0.1, "toxic": 0.0}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>!")] = True


def _features(text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature) pairs, some repeated, and the words of each document.

    Features are word hashes and a few numbered classes of the text's figures."""
    words = Words(text)
    h, doc, n = signed(words.hashes()), words.doc_of(), words.counts
    ratio = text.per_doc(_SYMBOL[text.data]) / np.maximum(text.lens, 1)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    kinds = np.bincount(doc[order][new], minlength=text.n) / np.maximum(n, 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    echo = np.bincount(doc[again], minlength=text.n) / np.maximum(n, 1)
    upper = text.per_doc((text.data >= 65) & (text.data <= 90)) / np.maximum(text.lens, 1)
    figures = [np.digitize(ratio, [0.005, 0.02, 0.06, 0.15]), 8 + np.digitize(kinds, [0.1, 0.3, 0.5, 0.7]), 16 + np.digitize(upper, [0.05, 0.15, 0.4]), 24 + np.digitize(n, [20, 50, 200, 1000]), 32 + np.digitize(echo, [0.02, 0.1, 0.3])]
    every = np.arange(text.n)
    return np.concatenate([doc[order][new], *[every] * 5]), np.concatenate([h[order][new], *figures]).astype(np.int64), n


class Classifier:
    """Two naive Bayes scores over chosen features, toxic or not and good or poor, each
    with an offset and a slope that make it a probability."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, prior: np.ndarray):
        self.keys, self.weights, self.offset, self.slope = keys, weights, prior, np.ones(2)

    def evidence(self, text) -> tuple[np.ndarray, np.ndarray]:
        doc, feature, n = _features(text)
        score = np.zeros((text.n, 2))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, feature), len(self.keys) - 1)
            hit = self.keys[at] == feature
            for j in range(2):
                score[:, j] += np.bincount(doc[hit], weights=self.weights[at[hit], j], minlength=text.n)
        return score, n

    def calibrate(self, score: np.ndarray, truth: np.ndarray, valid: np.ndarray, votes: np.ndarray) -> None:
        """Logistic fit of offset and slope, by Newton steps with a slight prior."""
        for j in range(2):
            x, y, w = score[valid[:, j], j], truth[valid[:, j], j], votes[valid[:, j]]
            b = np.array([self.offset[j], 1.0])
            for _ in range(50):
                m = np.stack([np.ones_like(x), x], 1)
                p = 1 / (1 + np.exp(-np.clip(m @ b, -30, 30)))
                hess = (m * (w * p * (1 - p))[:, None]).T @ m + np.diag([1e-3, 1e-1])
                b = b + np.clip(np.linalg.solve(hess, m.T @ (w * (y - p)) - [0, 1e-1 * (b[1] - 1)]), -2, 2)
            self.offset[j], self.slope[j] = b[0], max(b[1], 0.05)

    def posteriors(self, text) -> tuple[np.ndarray, np.ndarray]:
        score, n = self.evidence(text)
        p = 1 / (1 + np.exp(-np.clip(self.offset + self.slope * score, -30, 30)))
        toxic, good = p[:, 0], p[:, 1]
        return np.stack([(1 - toxic) * good, (1 - toxic) * (1 - good), toxic], 1), n


_VOTES = 1_000_000  # of a row that has no near copies; whole numbers, so sums don't depend on an order


def _feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, and of each fold n, toxic and good): votes of the rows that have a feature;
    feature -1 has all rows."""

    def work(part: pa.RecordBatch, text):
        doc, feature, _ = _features(text)
        every = np.arange(text.n)
        doc, feature = np.concatenate([doc, every]), np.concatenate([feature, np.full(text.n, -1)])
        rest = [part.column(part.schema.get_field_index(x)).to_numpy(zero_copy_only=False)[doc] for x in ("good", "toxic", "fold", "votes")]
        return pa.RecordBatch.from_arrays([pa.array(feature), *[pa.array(x) for x in rest]], ["feature", "good", "toxic", "fold", "votes"])

    one = lambda c: F.sum(F.when(c, F.col("votes")).otherwise(0))
    of = lambda c, fold: one(c & (F.col("fold") == fold))
    found = over_texts(rows.select("text", "good", "toxic", "fold", "votes"), work, "feature long, good boolean, toxic boolean, fold int, votes long")
    kinds = {"n": F.lit(True), "toxic": F.col("toxic"), "good": F.col("good") & ~F.col("toxic")}
    return kept(found.groupBy("feature").agg(*[of(c, fold).alias(f"{name}{fold}") for fold in (0, 1) for name, c in kinds.items()]))


def _learned(counts: DataFrame, folds: tuple[int, ...], evidence: float) -> Classifier:
    """A classifier, not calibrated yet, of the rows of some folds: all features whose
    likelihood-ratio statistic is ``evidence`` at least."""
    c = F.col
    summed = counts.select("feature", *[sum((c(f"{x}{fold}") for fold in folds), F.lit(0)).alias(x) for x in ("n", "toxic", "good")])
    summed = summed.select("feature", *[(c(x) / _VOTES).alias(x) for x in ("n", "toxic", "good")])
    total = summed.where("feature = -1").first()
    if total is None:
        return Classifier(np.zeros(0, np.int64), np.zeros((0, 2)), np.zeros(2))
    n, tox, good = total.n, total.toxic, total.good
    clean = n - tox

    def weight(a: Column, na: float, b: Column, nb: float) -> Column:
        return F.log((a + 0.5) / (na + 1.0)) - F.log((b + 0.5) / (nb + 1.0))

    def ratio(a: Column, na: float, b: Column, nb: float) -> Column:
        part = lambda x, m: F.when(x > 0, x * F.log(x * (na + nb) / ((a + b) * F.lit(float(max(m, 1e-6)))))).otherwise(0.0)
        return 2 * (part(a, na) + part(b, nb))

    pairs = ((c("toxic"), tox, c("n") - c("toxic"), clean), (c("good"), good, c("n") - c("toxic") - c("good"), clean - good))
    scored = summed.where("feature <> -1").select("feature", *[F.when(ratio(*p) >= evidence, weight(*p)).otherwise(0.0).alias(f"w{j}") for j, p in enumerate(pairs)], F.greatest(*[ratio(*p) for p in pairs]).alias("evidence"))
    best = scored.where(c("evidence") >= evidence).toArrow()  # bounded, as the sample is
    keys = best["feature"].to_numpy()
    order = np.argsort(keys)
    weights = np.stack([best["w0"].to_numpy(), best["w1"].to_numpy()], 1)[order]
    prior = np.array([np.log((tox + 0.5) / (clean + 0.5)), np.log((good + 0.5) / (clean - good + 0.5))])
    return Classifier(keys[order], weights, prior)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, evidence: float = 25.0) -> Classifier:
    """Learns from ``sample_rows`` labelled rows at most, chosen by a hash of the id (all, if
    there are fewer), none of which is left out. Rows whose three-word shingles have the same
    least hash, as near copies do, are one group: they share one vote, so copies aren't evidence
    of their own, and lie in one of two folds.

    Offset and slope of the probabilities are fitted to scores of rows by what was learned from
    the other fold; the features and their weights come from all rows. Labels with a null are
    left out; repeated labels count each; ids without a document don't matter; texts that are
    null are empty ones. Without any label all posteriors are those of even chances."""
    with passing_folders(docs.sparkSession):
        return _trained(docs, labels, sample_rows, evidence)


def _trained(docs: DataFrame, labels: DataFrame, sample_rows: int, evidence: float) -> Classifier:
    spark = docs.sparkSession
    whole = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).alias("good"), (F.col("toxic") > 0).alias("toxic"))
    sample = kept(whole.orderBy(F.xxhash64("doc_id", F.lit("mixing")), "good", "toxic").limit(sample_rows))  # bounded by sample_rows
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id"), "labelled")
    grouped = over_texts(texts, _grouped, "text string, group long, good boolean, toxic boolean")
    votes = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(_VOTES) / F.count("*"))).alias("votes")
    sizes = kept(grouped.groupBy("group", "good", "toxic").agg(votes))
    # as few groups as labelled rows, unless documents repeat an id: texts stay where they are
    shared_by = F.broadcast(sizes) if sizes.count() <= 4 * sample_rows else sizes
    rows = grouped.join(shared_by, ["group", "good", "toxic"]).select("text", "good", "toxic", F.pmod(F.xxhash64("group"), F.lit(2)).cast("int").alias("fold"), "votes")
    counts = _feature_counts(rows)
    model = _learned(counts, (0, 1), evidence)
    halves = spark.sparkContext.broadcast([_learned(counts, (1,), evidence), _learned(counts, (0,), evidence)])

    def rated(part: pa.RecordBatch, text):
        fold = part.column(part.schema.get_field_index("fold")).to_numpy()
        score = np.stack([m.evidence(text)[0] for m in halves.value])[fold, np.arange(text.n)]
        return pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(4), pa.array(score[:, 0]), pa.array(score[:, 1])], ["good", "toxic", "votes", "s0", "s1"])

    # documents that repeat an id come all, so the bound holds here again
    seen = over_texts(rows, rated, "good boolean, toxic boolean, votes long, s0 double, s1 double").orderBy(F.xxhash64("s0", "s1"), "s0", "s1", "good", "toxic").limit(sample_rows).toArrow()
    good, toxic = (seen[x].to_numpy().astype(bool) for x in ("good", "toxic"))
    votes = seen["votes"].to_numpy() / _VOTES
    model.calibrate(np.stack([seen["s0"].to_numpy(), seen["s1"].to_numpy()], 1), np.stack([toxic, good], 1).astype(float), np.stack([np.ones_like(toxic), ~toxic], 1), votes)
    return model


def _grouped(part: pa.RecordBatch, text) -> pa.RecordBatch:
    words = Words(text)
    at, gram = words.grams(words.hashes(), 3)
    least = np.full(text.n, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, words.doc_of()[at], gram)
    ids = part.column(part.schema.get_field_index("doc_id")).to_numpy().astype(np.uint64)
    least = np.where(least == np.iinfo(np.uint64).max, ids, least)
    own = [part.column(part.schema.get_field_index(x)) for x in ("text", "good", "toxic")]
    return pa.RecordBatch.from_arrays([own[0], pa.array(signed(least)), *own[1:]], ["text", "group", "good", "toxic"])


def memberships(docs: DataFrame, model: Classifier, keep_columns: bool = False) -> DataFrame:
    """Posterior columns p_<domain> and n_tokens beside doc_id, or beside all columns.

    Empty and null texts have no tokens and the posteriors of a text without words. Repeated
    rows and null ids get a row each; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs if keep_columns else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = [f for f in source.schema.fields if keep_columns or f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out] + [f"p_{d} double" for d in DOMAINS] + ["n_tokens long"])

    def work(part: pa.RecordBatch, text):
        p, n = shared.value.posteriors(text)
        own = [(part.column(i), x) for i, x in enumerate(part.schema.names) if keep_columns or x != "text"]
        return pa.RecordBatch.from_arrays([x for x, _ in own] + [pa.array(np.round(p[:, j], 6)) for j in range(len(DOMAINS))] + [pa.array(n.astype(np.int64))], [x for _, x in own] + [f"p_{d}" for d in DOMAINS] + ["n_tokens"])

    return over_texts(source, work, schema)


class Steps(list):
    """Projected gradient steps; ``residual``: by how much the share of each domain in the
    expected tokens misses its target after them; ``converged``: whether they came to rest."""

    residual: dict[str, float] = dict.fromkeys(DOMAINS, 0.0)
    converged: bool = True


def fit_steps(members: DataFrame, targets: dict[str, float] = TARGETS, most_steps: int = 300, close: float = 1e-4) -> Steps:
    """The projected gradient steps from rates of one, with momentum that is given up where it
    leads back; rates() applies them.

    They lessen the squared differences between the expected tokens of each domain and its
    target share of all tokens, weighted by the inverse of the domains' token covariance,
    so one step length is right for all. They end when a step moves the rates by less than
    ``close`` (root mean square over tokens). Targets may lie beyond what nonnegative rates can
    meet, or be met by ever higher rates of ever fewer documents only: ``residual`` says by how
    much they are missed, and ``converged`` is false where rates still move after ``most_steps``.

    Equal posteriors have equal rates, so steps run over the distinct ones with their tokens
    and the rates so far, each one aggregate. Without any token there are none."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    n = F.col("n_tokens")
    size = range(len(DOMAINS))
    taken = Steps()
    distinct = members.groupBy(*[f"p_{d}" for d in DOMAINS]).agg(F.sum(n).alias("n_tokens"))
    classes = kept(distinct.withColumns({"rate": F.lit(1.0), "point": F.lit(1.0)}))
    first = classes.agg(F.sum(n).alias("n"), *[F.sum(n * p[i]).alias(f"s{i}") for i in size], *[F.sum(n * p[i] * p[j]).alias(f"g{i}{j}") for i in size for j in size]).first()
    if not first or not first["n"]:
        return taken
    total = float(first["n"])
    gram = np.array([[first[f"g{i}{j}"] for j in size] for i in size]) / total
    inverse = np.linalg.inv(gram + 1e-6 * np.eye(len(DOMAINS)))
    goal = np.array([targets[d] for d in DOMAINS])
    goal = goal / goal.sum()
    shares = at_point = np.array([first[f"s{j}"] for j in size]) / total
    taken.converged, age = False, 1.0
    rate, point = F.col("rate"), F.col("point")
    while len(taken) < most_steps and not taken.converged:
        step = inverse @ (at_point - goal)
        classes = classes.withColumn("before", rate).withColumn("rate", F.greatest(F.lit(0.0), point - _move(step)))
        change = rate - F.col("before")
        sums = classes.agg(*[F.sum(n * p[j] * rate).alias(f"s{j}") for j in size], F.sum(n * change * change).alias("moved"), F.sum(n * (point - rate) * change).alias("back")).first()
        new = np.array([sums[f"s{j}"] for j in size]) / total
        older, age = (age, 1.0) if sums["back"] > 0 else (age, (1 + np.sqrt(1 + 4 * age * age)) / 2)
        momentum = 0.0 if sums["back"] > 0 else (older - 1) / age
        shares, at_point = new, new + momentum * (new - shares)
        taken.append(np.append(step, momentum))
        taken.converged = bool(np.sqrt(sums["moved"] / total) < close)
        classes = classes.withColumn("point", rate + F.lit(float(momentum)) * change).drop("before")
        classes = kept(classes) if len(taken) % 10 == 0 else classes
    taken.residual = {d: float(x) for d, x in zip(DOMAINS, shares - goal, strict=True)}
    return taken


def rates(members: DataFrame, taken: list[np.ndarray]) -> DataFrame:
    """``members`` with a column ``rate``, the expected number of copies."""
    return members.withColumn("rate", F.round(_rate(taken), 6))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` with p_<domain>, n_tokens and ``rate``, without the rows whose rate is zero.

    Columns of ``docs`` with those names are replaced; repeated rows and null ids stay each;
    rows of equal posteriors have equal rates; an empty table gives an empty one, a table
    without tokens keeps all rows at rate one."""
    docs = docs.drop(*[f"p_{d}" for d in DOMAINS], "n_tokens", "rate")
    model = train(docs, labels)
    taken = fit_steps(kept(memberships(docs, model)), targets)
    return rates(memberships(docs, model, keep_columns=True), taken).where("rate > 0")


def _rate(taken: list[np.ndarray]) -> Column:
    if not taken:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in y]) for y in taken])
    pair = lambda rate, point: F.struct(rate.alias("rate"), point.alias("point"))
    # a step's new rate stands in ``point`` of an inner pair, so it is computed once
    moved = lambda at, y: F.struct(at["rate"].alias("before"), F.greatest(F.lit(0.0), at["point"] - _move(y)).alias("rate"), y[len(DOMAINS)].alias("momentum"))
    after = lambda m: pair(m["rate"], m["rate"] + m["momentum"] * (m["rate"] - m["before"]))
    return F.aggregate(steps, pair(F.lit(1.0), F.lit(1.0)), lambda at, y: F.transform(F.array(moved(at, y)), after)[0])["rate"]


def _move(y) -> Column:
    return sum((F.col(f"p_{d}") * (float(y[j]) if isinstance(y, np.ndarray) else y[j]) for j, d in enumerate(DOMAINS)), F.lit(0.0))


def op10_mix_domains(spark, sf_dir) -> DataFrame:
    """Beside posteriors and rates, what the fit came to: by how much each domain misses its
    target share, and whether the steps came to rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    members = kept(memberships(docs, model))
    taken = fit_steps(members)
    told = [F.lit(round(taken.residual[d], 6)).alias(f"residual_{d}") for d in DOMAINS]
    return rates(members, taken).select("doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", *told, F.lit(taken.converged).alias("converged"))
