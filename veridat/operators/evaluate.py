"""Evaluation of many rules in one pass, with every failing row kept.

One job scans the table, counts what fails and writes the failing rows: predicates and small
reference tables share the scan, and the counts are observed on the way to the writer. Joins
with many keys are further branches of the same job. A rule that can't be planned, or whose
data stops the shared job, becomes an ERROR of its own and leaves the others alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import registry
from .rules import Plan, col, numeric_shares, plan_rule, unsure_columns

SAMPLES = 10
RESULT_SCHEMA = "rule_id long, dataset_name string, status string, failed_count long, details string"
MOST_KEYS = 2_000_000  # reference keys sent to all executors up to here; joined by shuffle beyond


@dataclass
class Rule:
    rule_id: int
    definition: dict | str  # {"executable_rule": ...}
    column: str | None = None


@dataclass
class Evaluation:
    results: DataFrame  # RESULT_SCHEMA, a row for each rule
    failures: DataFrame  # rule_id, source_row_identifier: a row for each failing row
    plans: dict[int, Plan] = field(default_factory=dict)


def row_identifier(df: DataFrame, primary_key: str | None = None) -> Column:
    """What names a row in failure records: its key as text, else the identifier that was
    set at load, else what the whole row hashes to."""
    fallback = F.col("_dq_row_identifier").cast("string") if "_dq_row_identifier" in df.columns else F.concat(F.lit("row:"), F.xxhash64(*[col(c) for c in df.columns]).cast("string"))
    return F.coalesce(col(primary_key).cast("string"), fallback) if primary_key in df.columns else fallback


def _prepared(rule: Rule) -> dict:
    ok, reason, cleaned = registry.validate_executable_rule(registry.executable_of(rule.definition))
    if not ok:
        raise ValueError(reason)
    return cleaned


def _error(problem: Exception) -> dict:
    return {"failed_count": 0, "error_type": type(problem).__name__, "message": str(problem).split("\n")[0][:500]}


def _is_small(plan: Plan) -> bool:
    """Whether the keys of a reference rule are few enough to send; counted once."""
    if plan.small is None:
        plan.small = plan.keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    return plan.small


def _matches(plan: Plan, columns: list[Column], prefix: str, null_safe: bool) -> Column:
    same = [a.eqNullSafe(F.col(f"{prefix}{i}")) if null_safe else a == F.col(f"{prefix}{i}") for i, a in enumerate(columns)]
    return reduce(lambda x, y: x & y, same)


def _marked(df: DataFrame, plans: dict[int, Plan]) -> tuple[DataFrame, dict[int, Column]]:
    """``df`` with what its small reference tables say, and the predicates of all rules that
    one scan can judge."""
    fails = {}
    for i, p in plans.items():
        if p.fails is not None:
            fails[i] = p.fails
        elif p.keys is not None and not p.match_is_failure and _is_small(p):
            own = p.keys.select(*[F.col(f"k{n}").alias(f"__k{i}_{n}") for n in range(len(p.on))], F.lit(True).alias(f"__known{i}"))
            df = df.join(F.broadcast(own), _matches(p, p.on, f"__k{i}_", False), "left")
            fails[i] = F.coalesce(p.applies, F.lit(False)) & F.col(f"__known{i}").isNull()
    return df, fails


def _joined(df: DataFrame, plan: Plan) -> DataFrame:
    """Failing rows of a rule that joins with many keys. Nulls of duplicate keys equal each
    other. Of a reference with many keys, the distinct keys of the rows are looked up, not the
    rows; the rows are kept where their key was not found, by a broadcast of those keys where
    they are few."""
    if plan.match_is_failure:
        rows = df if plan.source is None else plan.source
        keys = F.broadcast(plan.keys) if plan.source is not None and _is_small(plan) else plan.keys
        return rows.where(plan.applies).join(keys.alias("k"), _matches(plan, plan.on, "k.k", True), "left_semi")
    judged = df.where(plan.applies)
    names = [f"k{i}" for i in range(len(plan.on))]
    asked = judged.select(*[c.alias(n) for c, n in zip(plan.on, names, strict=True)]).distinct()
    unknown = asked.alias("a").join(plan.keys.alias("k"), reduce(lambda x, y: x & y, [F.col(f"a.{n}") == F.col(f"k.{n}") for n in names]), "left_anti")
    few = unknown.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    return judged.join((F.broadcast(unknown) if few else unknown).alias("u"), _matches(plan, plan.on, "u.k", True), "left_semi")


def plan_rules(df: DataFrame, rules: list[Rule], tables: dict) -> tuple[dict[int, Plan], dict[int, dict]]:
    """Plans by rule id, and the details of those that can't be planned."""
    plans, broken, ready = {}, {}, {}
    for rule in rules:
        try:
            ready[rule.rule_id] = (rule, _prepared(rule))
        except Exception as problem:  # noqa: BLE001  a rule's error is its result
            broken[rule.rule_id] = _error(problem)
    unsure = {c for _, r in ready.values() if r["type"] == "column_comparison" for c in unsure_columns(df, r["parameters"])}
    shares = numeric_shares(df, sorted(unsure))
    for i, (rule, cleaned) in ready.items():
        try:
            plans[i] = plan_rule(df, cleaned, rule.column, tables, shares)
            if plans[i].fails is not None:
                df.select(plans[i].fails)  # errors of analysis show here
        except Exception as problem:  # noqa: BLE001
            broken[i] = _error(problem)
    return plans, broken


class Counted:
    """What a job observes on its way: figures by rule once it has ended."""

    def __init__(self) -> None:
        self._seen: list[tuple[Observation, dict[str, tuple[int, str]]]] = []
        self._minimum: dict[int, int] = {}

    def watch(self, df: DataFrame, wanted: dict[tuple[int, str], Column], minimum: dict[int, int]) -> DataFrame:
        names = {f"c{n}": key for n, key in enumerate(wanted)}
        seen = Observation()
        self._seen.append((seen, names))
        self._minimum |= minimum
        return df.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in zip(names, wanted.values(), strict=True)])

    def figures(self) -> dict[int, dict]:
        out: dict[int, dict] = {}
        for n, (seen, names) in enumerate(self._seen):
            found = seen.get
            for name, (i, figure) in names.items():
                out.setdefault(i, {})[figure] = found.get(name, 0)
            if n == 0:
                rows = found.get("rows", 0)
                out |= {i: {"failed_count": int(rows < least), "actual_count": rows, "minimum_rows": least} for i, least in self._minimum.items()}
        return out


def failing_rows(df: DataFrame, plans: dict[int, Plan], primary_key: str | None = None, counted: Counted | None = None) -> DataFrame:
    """(rule_id, source_row_identifier) of every failing row; ``counted`` watches it on the way."""
    name = row_identifier(df, primary_key).alias("source_row_identifier")
    frames = []
    source, fails = _marked(df, plans)
    minimum = {i: p.minimum for i, p in plans.items() if p.minimum is not None}
    if fails or (minimum and counted is not None):
        # each predicate is a column first, so it is computed once
        extras = {(i, n): c for i in fails for n, c in plans[i].extras.items()}
        rows = source.select(name, *[c.alias(f"__f{i}") for i, c in fails.items()], *[c.alias(f"__f{i}_{n}") for (i, n), c in extras.items()])
        if counted is not None:
            wanted = {(i, "failed_count"): F.count_if(f"__f{i}") for i in fails} | {(i, n): F.count_if(f"__f{i}_{n}") for i, n in extras}
            rows = counted.watch(rows, wanted, minimum)
        ids = F.array_compact(F.array(*[F.when(F.col(f"__f{i}"), F.lit(i).cast("long")) for i in fails])) if fails else F.array().cast("array<bigint>")
        frames.append(rows.select(F.explode(ids).alias("rule_id"), "source_row_identifier"))
    for i, p in plans.items():
        if p.keys is not None and i not in fails:
            rows = _joined(df, p).select(F.lit(i).cast("long").alias("rule_id"), name)
            frames.append(counted.watch(rows, {(i, "failed_count"): F.count("*")}, {}) if counted is not None else rows)
    if not frames:
        return df.sparkSession.createDataFrame([], "rule_id long, source_row_identifier string")
    return reduce(DataFrame.unionByName, frames)


def _faulty(run: Callable[[list[int]], None], ids: list[int]) -> dict[int, Exception]:
    """Which of ``ids``, whose shared job fails, fail alone, found by halves: where the first
    half runs, the second isn't tried as a whole."""
    if len(ids) == 1:
        try:
            run(ids)
        except Exception as problem:  # noqa: BLE001  a rule's error is its result
            return {ids[0]: problem}
        return {}
    left, right = ids[: len(ids) // 2], ids[len(ids) // 2 :]
    try:
        run(left)
    except Exception:  # noqa: BLE001
        found = _faulty(run, left)
        try:
            run(right)
        except Exception:  # noqa: BLE001
            found |= _faulty(run, right)
        return found
    return _faulty(run, right)


def _into_nothing(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def _figures(df: DataFrame, plans: dict[int, Plan], primary_key: str | None, keep: Callable[[DataFrame], object]) -> tuple[dict[int, dict], dict[int, dict]]:
    """Figures by rule from one job, and the details of the rules that stopped it. The job runs
    again without those; one that still fails isn't the rules' fault."""

    def run(ids: list[int], keep: Callable[[DataFrame], object] = _into_nothing) -> dict[int, dict]:
        counted = Counted()
        chosen = {i: plans[i] for i in ids}
        keep(failing_rows(df, chosen, primary_key, counted))
        return {i: {"failed_count": 0} for i in ids} | counted.figures()

    ids = list(plans)
    try:
        return run(ids, keep), {}
    except Exception as problem:
        bad = _faulty(run, ids) if ids else {}
        if not bad:
            raise problem
        return run([i for i in ids if i not in bad], keep), {i: _error(p) for i, p in bad.items()}


def _samples(df: DataFrame, plans: dict[int, Plan], figures: dict[int, dict], primary_key: str | None) -> dict[int, list[dict]]:
    """Up to SAMPLES failing rows of each rule, by one more scan for all: a row is drawn with a
    chance that the rule's count sets, so some dozens of each rule are aggregated."""
    source, fails = _marked(df, plans)
    chance = F.col("__chance")
    found: dict[int, list[dict]] = {}
    due = {i: figures[i]["failed_count"] for i, p in plans.items() if p.minimum is None and figures[i]["failed_count"]}
    factor = 4 * SAMPLES
    while due:
        share = {i: min(1.0, factor / n) for i, n in due.items()}

        def drawn(i: int) -> Column:
            shown = [c for c in dict.fromkeys([primary_key, *plans[i].columns]) if c in df.columns]
            row = F.to_json(F.struct(*[col(c) for c in shown]), {"ignoreNullFields": "false"}) if shown else F.lit("{}")
            return F.struct(F.lit(i).cast("long").alias("rule_id"), row.alias("row"))

        frames = []
        if some := [i for i in due if i in fails]:
            rows = F.array_compact(F.array(*[F.when(fails[i] & (chance < share[i]), drawn(i)) for i in some]))
            frames.append(source.withColumn("__chance", F.rand(7)).select(F.explode(rows).alias("x")).select("x.*"))
        frames += [_joined(df, plans[i]).withColumn("__chance", F.rand(7)).where(chance < share[i]).select(drawn(i).alias("x")).select("x.*") for i in due if i not in fails]
        for r in reduce(DataFrame.unionByName, frames).groupBy("rule_id").agg(F.slice(F.collect_list("row"), 1, SAMPLES).alias("rows")).collect():
            found[r.rule_id] = [json.loads(x) for x in r.rows]
        due = {i: n for i, n in due.items() if share[i] < 1 and len(found.get(i, [])) < SAMPLES}
        factor *= 8
    return found


def evaluate(df: DataFrame, rules: list[Rule], primary_key: str | None = None, tables: dict | None = None, dataset: str = "", samples: bool = True, keep: Callable[[DataFrame], DataFrame] | None = None) -> Evaluation:
    """Results and failing rows of ``rules`` on ``df``; ``tables`` are reference tables,
    name to (frame, key columns). Samples of up to ten failing rows go into the details.

    ``keep`` writes the failing rows (rule_id, source_row_identifier), in the job that counts
    them, and gives what was written; it is called again if a rule stops the job. Without it the
    failures are a plan of their own."""
    plans, broken = plan_rules(df, rules, tables or {})
    written: list[DataFrame] = []
    figures, stopped = _figures(df, plans, primary_key, (lambda rows: written.append(keep(rows))) if keep else _into_nothing)
    broken |= stopped
    plans = {i: p for i, p in plans.items() if i not in broken}
    shown = _samples(df, plans, figures, primary_key) if samples else {}
    rows = []
    for rule in rules:
        i = rule.rule_id
        if i in broken:
            rows.append((i, dataset, "ERROR", 0, json.dumps(broken[i])))
            continue
        details = figures[i] | ({"sample_failures": shown[i]} if i in shown else {})
        rows.append((i, dataset, "FAIL" if details["failed_count"] else "PASS", details["failed_count"], json.dumps(details, default=str)))
    spark: SparkSession = df.sparkSession
    return Evaluation(spark.createDataFrame(rows, RESULT_SCHEMA), written[-1] if written else failing_rows(df, plans, primary_key), plans)


def rule_counts(df: DataFrame, rules: list[Rule], tables: dict | None = None) -> DataFrame:
    """(rule_id, failed_count) as a plan without actions but those that planning needs: one
    aggregate over all predicates, unpivoted, beside one for each join with many keys."""
    plans, broken = plan_rules(df, rules, tables or {})
    if broken:
        raise ValueError(str(broken))
    source, fails = _marked(df, plans)
    plain = {i: p for i, p in plans.items() if i in fails or p.minimum is not None}
    frames = []
    if plain:
        count = lambda i, p: F.count_if(fails[i]) if i in fails else F.when(F.count("*") < p.minimum, 1).otherwise(0).cast("long")
        one = source.agg(*[count(i, p).alias(f"f{i}") for i, p in plain.items()])
        frames.append(one.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("rule_id"), F.col(f"f{i}").alias("failed_count")) for i in plain])).alias("r")).select("r.*"))
    frames += [_joined(df, p).agg(F.count("*").alias("failed_count")).select(F.lit(i).cast("long").alias("rule_id"), "failed_count") for i, p in plans.items() if i not in plain]
    return reduce(DataFrame.unionByName, frames)


def evaluate_rule(rule: dict | str, df: DataFrame, primary_key: str | None = None, column: str | None = None, tables: dict | None = None) -> tuple[str, dict]:
    """(status, details) of one rule."""
    row = evaluate(df, [Rule(0, rule, column)], primary_key, tables).results.first()
    return row.status, json.loads(row.details)
