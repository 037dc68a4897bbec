"""Personal data by weak supervision.

Built-in functions only. Fixed patterns and further ones propose spans; pattern, gazetteer,
context, boundary and variety labelers vote on each. Expectation-maximisation over the
counts of vote patterns estimates how often each labeler votes which way on personal data
and on other spans. Its posteriors train the classifier, which sees the form of a span
beside the votes and decides on the spans that the fixed patterns don't cover.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, row_key


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of 12 to 19 digits holds."""
    at = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(at(i))).otherwise(at(i)))
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame"
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Boulevard|Blvd|Drive"

# Frequent given names and family names.
GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra "
    "Mark Margaret Steven Ashley Paul Emily Andrew Donna Joshua Michelle Kevin Carol Brian Amanda George Melissa Edward Deborah Jane Anna Laura Peter Hans Klaus Jürgen Wolfgang Ursula Helga Monika Sabine "
    "Stefan Jean Pierre Michel André Marie Nathalie Isabelle Sylvie Catherine Françoise José Antonio Juan Manuel Francisco Carlos Carmen Josefa Isabel Ana Luis Miguel Pedro Lucía Sofía Maria Ahmed Mohammed Fatima Wei Priya Yuki Olga Ivan"
).split()
FAMILY = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson White Harris Sanchez Clark Ramirez Lewis "
    "Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts Doe Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker "
    "Schulz Hoffmann Bernard Dubois Durand Leroy Moreau Simon Laurent Lefebvre García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Ruiz Khan Singh Kumar Wang Li Zhang Chen Tanaka Ivanov"
).split()


@dataclass(frozen=True)
class Kind:
    """A proposal: where ``gate`` holds, what ``pattern`` matches and ``valid`` accepts.

    Possessive quantifiers keep long runs linear; lookbehinds skip starts that can only fail."""

    name: str
    base: bool
    gate: Callable[[Column], Column]
    pattern: str
    valid: Callable[[Column], Column]
    context: str  # words before a span that speak for it
    gazetteer: str  # forms that public lists know
    strict: bool = True  # other forms speak against a span
    checked: bool = False  # ``valid`` is a check that few other spans pass


KINDS = (
    Kind("email", True, lambda t: t.contains("@"), r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), "mail|contact|write|address", r"\.(?:com|org|net|edu|gov|de|fr|es|uk|io)$"),
    Kind("ip", True, lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), r"\bip\b|host|server|address|from", r"^(?!0|127\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)"),
    Kind("card", True, lambda t: t.rlike("[0-9][ -]?[0-9]"), r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++", lambda m: _luhn(_digits(m)), "card|visa|credit|payment|pay", "^(?:4|5[1-5]|2[2-7]|34|37|35|6011|65)"),
    Kind("phone", True, lambda t: t.contains("+"), r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), "tel|phone|call|fax|mobile|contact", r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"),
    Kind("local_phone", False, lambda t: t.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"), r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-]*[0-9])", lambda m: F.lit(True), "tel|phone|call|fax|mobile|contact", r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]"),
    Kind("ssn", False, lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", lambda m: F.lit(True), "ssn|social|security|tax", "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"),
    Kind("iban", False, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda m: F.lit(True), "iban|account|konto|bank", "^(?:DE|FR|ES|GB|IT|NL|BE|CH|AT|PL)[0-9]{2}"),
    Kind("name", False, lambda t: t.rlike(rf"\b(?:{_TITLES})\.? \p{{Lu}}"), rf"\b(?:{_TITLES})\.?\x20\p{{Lu}}[\p{{L}}'-]+(?:\x20\p{{Lu}}[\p{{L}}'-]+)?", lambda m: F.lit(True), "dear|sincerely|by|from|with", rf"^(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}+ \p{{Lu}}\p{{Ll}}+$"),
    Kind("street", False, lambda t: t.rlike(rf"[0-9] .{{0,60}}\b(?:{_STREETS})\b"), rf"\b[0-9]{{1,5}}\x20(?:\p{{Lu}}\p{{Ll}}+\x20){{1,3}}(?:{_STREETS})\b", lambda m: F.lit(True), "at|address|live|lives|visit", rf"(?:{_STREETS})$"),
    # what two numbers that stand together hide from the fixed pattern
    Kind("card_in_run", False, lambda t: t.rlike("[0-9]{4}[ -]?[0-9]{4}"), r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9])", lambda m: _luhn(_digits(m)), "card|visa|credit|payment|pay", "^(?:4|5[1-5]|2[2-7]|34|37|35|6011|65)", False, True),
    Kind("person", False, lambda t: t.rlike(r"\p{Lu}\p{Ll}++ \p{Lu}"), rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}}\p{{Ll}}++\x20\p{{Lu}})(?:{'|'.join(GIVEN)})\x20(?:\p{{Lu}}\.\x20)?\p{{Lu}}[\p{{L}}'-]+", lambda m: F.lit(True), r"dear|sincerely|regards|\bby\b|from|name|contact|author|signed|\bam\b|called|\bis\b|met|hi\b|hello", rf"\x20(?:{'|'.join(FAMILY)})$", False),
)
LABELERS = ("pattern", "gazetteer", "context", "boundary", "variety")
FORMS = ("size", "share", "lead")
_AGAINST = "version|isbn|order|invoice|model|page|serial|build|ticket"

# How each labeler is expected to vote (for, nothing, against): on personal data, on other spans.
EXPECTED = {
    "pattern": ((0.6, 0.399, 0.001), (0.3, 0.699, 0.001)), "gazetteer": ((0.75, 0.1, 0.15), (0.35, 0.15, 0.5)), "context": ((0.4, 0.595, 0.005), (0.05, 0.55, 0.4)), "boundary": ((0.94, 0.01, 0.05), (0.6, 0.01, 0.39)), "variety": ((0.6, 0.38, 0.02), (0.35, 0.4, 0.25)),
}
TRUST = 200.0  # the expectations count as so many spans
_ORDER = {k.name: i for i, k in enumerate(KINDS)}


def _around(kind: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["g"]).alias("gap"), F.right(x["g"], F.lit(24)).alias("before"), F.left(x["g"], F.lit(1)).alias("head"), x["m"].alias("m"))


def proposals(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, kind, start, end, base, votes...) of the proposed spans of each row, in
    code points, and a row with a null kind for each row of ``docs``.

    The text between matches gives their places: a match begins after all gaps and matches
    before it. Only the lengths are shuffled, with a few characters around a match."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for i, k in enumerate(KINDS):
        pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)).alias("m"), F.split(text, k.pattern, -1).alias("g"))
        found.append(F.when(k.gate(text), F.transform(pieces, _around(i))).otherwise(F.array().cast("array<struct<kind:int,gap:int,before:string,head:string,m:string>>")))
    rows = docs.select(row_key().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.concat(*found).alias("found"))
    rows = rows.select("rid", "doc_id", F.posexplode_outer("found").alias("pos", "x")).select("rid", "doc_id", "pos", "x.*")
    own = Window.partitionBy("rid", "kind").orderBy("pos")
    size = F.coalesce(F.length("m"), F.lit(0))
    placed = rows.repartition(F.col("rid")).select("*", F.lead("head").over(own).alias("after"), (F.sum(F.col("gap") + size).over(own) - size).alias("start"))
    m = F.col("m")
    per_kind = lambda f: _case(f, F.lit(None))
    good = placed.withColumn("ok", F.when(m.isNull(), F.lit(False)).otherwise(F.coalesce(per_kind(lambda k: k.valid(m)), F.lit(False))))
    near = F.lower("before")
    digits = _digits(m)
    votes = {
        "pattern": per_kind(lambda k: F.lit(int(k.base or k.checked))),
        "gazetteer": per_kind(lambda k: F.when(m.rlike(k.gazetteer), 1).otherwise(-1 if k.strict else 0)),
        "context": F.when(per_kind(lambda k: near.rlike(k.context)), 1).when(near.rlike(_AGAINST), -1).otherwise(0),
        "boundary": F.when(F.col("before").rlike(r"[\p{L}\p{N}]$") | F.coalesce(F.col("after"), F.lit("")).rlike(r"^[\p{L}\p{N}]"), -1).otherwise(1),
        "variety": F.when(F.length(digits) < 6, 0).when(F.size(F.array_distinct(F.split(digits, ""))) >= 4, 1).otherwise(-1),
    }
    part = F.length(digits) / F.length(m)
    forms = {
        "size": F.when(F.length(m) < 8, 0).when(F.length(m) < 12, 1).when(F.length(m) < 20, 2).otherwise(3),
        "share": F.when(part < 0.1, 0).when(part < 0.5, 1).when(part < 0.8, 2).otherwise(3),
        "lead": F.when(F.col("before").rlike(r"[\n\r]$") | (F.col("before") == ""), 0).when(F.col("before").rlike(r"\s$"), 1).when(F.col("before").rlike(r"[:=(\[\"']$"), 2).otherwise(3),
    }
    spans = good.select(
        "rid", "doc_id", F.when(F.col("ok"), F.col("kind")).alias("kind"), F.when(F.col("ok"), F.col("start")).cast("long").alias("start"), F.when(F.col("ok"), F.col("start") + F.length("m")).cast("long").alias("end"),
        per_kind(lambda k: F.lit(k.base)).alias("base"), *[F.when(F.col("ok"), v).cast("int").alias(name) for name, v in (votes | forms).items()],
    )
    # one of the rows without a span stays for each document
    first = F.row_number().over(Window.partitionBy("rid").orderBy(F.col("kind").isNotNull(), "start"))
    return spans.withColumn("first", first).where(F.col("kind").isNotNull() | (F.col("first") == 1)).drop("first")


def _case(f: Callable[[Kind], Column], default: Column) -> Column:
    out = default
    for i, k in reversed(list(enumerate(KINDS))):
        out = F.when(F.col("kind") == i, f(k)).otherwise(out)
    return out


def _sigmoid(x: float) -> float:
    return 1 / (1 + exp(-max(-30.0, min(30.0, x))))


def estimate(counts: list[tuple], rounds: int = 60) -> dict[tuple, float]:
    """Posterior of each vote pattern (kind, votes...) from the counts (kind, votes..., n).

    Each labeler votes for, against or not at all with chances of its own on personal data and
    on other spans; each kind has a prior of its own. The chances begin at EXPECTED and are
    held to it by the weight of TRUST spans, so rare patterns follow it and many spans
    can overrule it."""
    chance = [[list(e) for e in EXPECTED[name]] for name in LABELERS]
    prior = {c[0]: 0.5 for c in counts}
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for *key, _n in counts:
            odds = log(prior[key[0]] / (1 - prior[key[0]])) + sum(log(chance[j][0][1 - v] / chance[j][1][1 - v]) for j, v in enumerate(key[1:]))
            post[tuple(key)] = _sigmoid(odds)
        for j, name in enumerate(LABELERS):
            sums = [[TRUST * x for x in e] for e in EXPECTED[name]]
            for *key, n in counts:
                p = post[tuple(key)]
                sums[0][1 - key[1 + j]] += n * p
                sums[1][1 - key[1 + j]] += n * (1 - p)
            chance[j] = [[x / sum(row) for x in row] for row in sums]
        for kind in prior:
            mine = [(post[tuple(c[:-1])], c[-1]) for c in counts if c[0] == kind]
            prior[kind] = (sum(p * n for p, n in mine) + 20) / (sum(n for _, n in mine) + 40)
    return post


def classifier(counts: list[tuple], post: dict[tuple, float], rounds: int = 200, rate: float = 2.0, decay: float = 1e-3) -> dict[tuple, float]:
    """The span classifier's probability for each pattern of kind, votes and forms, from the
    counts (kind, votes..., forms..., n): logistic regression on all of them, trained on the
    posteriors of the votes, patterns weighted by the logarithm of their counts."""
    votes = 1 + len(LABELERS)
    names = lambda key: [("kind", key[0]), *[(j, v) for j, v in enumerate(key[1:])], *[("kind", key[0], j, v) for j, v in enumerate(key[1:votes])]]
    numbers: dict = {}
    rows = [([numbers.setdefault(f, len(numbers)) for f in names(c[:-1])], post[tuple(c[:votes])], log(1 + c[-1])) for c in counts]
    whole = sum(w for *_, w in rows) or 1.0
    weights = [0.0] * len(numbers)
    for _ in range(rounds):
        step = [0.0] * len(numbers)
        for feats, p, w in rows:
            off = w * (p - _sigmoid(sum(weights[f] for f in feats))) / whole
            for f in feats:
                step[f] += off
        weights = [w + rate * (g - decay * w / 4) for w, g in zip(weights, step, strict=True)]
    return {tuple(c[:-1]): _sigmoid(sum(weights[f] for f in feats)) for c, (feats, *_) in zip(counts, rows, strict=True)}


def detect(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_id, spans) for each row, ``spans`` an array of (start, order, end, kind, base,
    score) by start and kind.

    Spans of the fixed patterns stay whatever their score; others need a probability of
    ``least`` and must not overlap a span before them or one of a fixed pattern; of spans that
    begin together the one of the earlier kind comes first. Null and empty texts have none;
    repeated rows get a row each; an empty table gives an empty one; other columns of ``docs``
    don't matter."""
    rows = kept(proposals(docs))
    # patterns of votes and forms: their number is bounded by the kinds, whatever the corpus
    counts = [tuple(r) for r in rows.where("kind is not null").groupBy("kind", *LABELERS, *FORMS).agg(F.count("*").alias("n")).orderBy("kind", *LABELERS, *FORMS).collect()]
    by: dict[tuple, int] = {}
    for c in counts:
        key = c[: 1 + len(LABELERS)]
        by[key] = by.get(key, 0) + c[-1]
    score = classifier(counts, estimate([(*k, n) for k, n in by.items()])) if counts else {}
    table = docs.sparkSession.createDataFrame([(*k, float(p)) for k, p in score.items()], ", ".join(["kind int", *[f"{x} int" for x in (*LABELERS, *FORMS)], "score double"]))
    rated = rows.join(F.broadcast(table), ["kind", *LABELERS, *FORMS], "left")
    w = Window.partitionBy("rid").orderBy("start", "kind")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    stays = F.col("base") | ((F.col("score") >= least) & free)
    chosen = rated.repartition(F.col("rid")).withColumn("stays", stays)
    item = F.struct("start", F.col("kind").alias("order"), "end", F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind") + 1).alias("kind"), "base", "score")
    return chosen.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("stays") & F.col("kind").isNotNull(), item))).alias("spans")).drop("rid")


def op3_pii(spark, sf_dir) -> DataFrame:
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in ("email", "ip", "card", "phone")], F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
