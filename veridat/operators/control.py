"""Control tables: rules and remediations with their status logs, results and runs.

Statuses are append-only logs; what holds is the last entry. One writer at a time.
"""

from __future__ import annotations

import dataclasses
import datetime
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import DataQualityError, canonical
from . import registry
from .evaluate import Evaluation, Rule, evaluate
from ..sources.awaited import Awaited
from ..sources.load import LoadSummary, load

RULES = "rule_id long, dataset_name string, column_name string, rule_type string, rule_scope string, target_columns array<string>, rule_definition string, generated_by string, stewardship_run_id long"
LOG = "entry long, subject_id long, from_status string, to_status string, actor string, note string, at timestamp"
RESULTS = "result_id long, rule_id long, dataset_name string, status string, failed_count long, details string, checked_at timestamp, stewardship_run_id long"
RUNS = "entry long, run_id long, kind string, dataset_name string, phase string, status string, actor string, message string, at timestamp"
RULE_TARGETS = ("proposed", "rejected", "retired")
REMEDIATION_STATUSES = ("proposed", "approved", "rejected", "skipped")
APPLIED = "applied"  # set where a version is made, by no decision
PHASES = ("load", "profile", "rules", "evaluate", "remediate")


def next_id(df: DataFrame, key: str) -> int:
    return (df.agg(F.max(key)).first()[0] or 0) + 1


def now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC)


def current_status(log: DataFrame) -> DataFrame:
    """(subject_id, status, actor, at): the last entry of each subject; of entries of one time
    the one with the largest number."""
    last = log.groupBy("subject_id").agg(F.max(F.struct("at", "entry", "to_status", "actor")).alias("x"))
    return last.select("subject_id", F.col("x.to_status").alias("status"), "x.actor", "x.at")


def _entry(log: DataFrame, subject: int, after: str, actor: str, note: str | None, at=None) -> DataFrame:
    if not (actor or "").strip():
        raise DataQualityError("A change of status needs an actor.")
    before = current_status(log).where(F.col("subject_id") == subject).first()
    return log.sparkSession.createDataFrame([(next_id(log, "entry"), subject, before.status if before else None, after, actor.strip(), note, at or now())], LOG)


def approve_rule(rules: DataFrame, log: DataFrame, rule_id: int, by: str, note: str | None = None, at=None) -> tuple[dict, DataFrame]:
    """The definition as it is approved, with its canonical type, and the log's new entry."""
    row = rules.where(F.col("rule_id") == rule_id).first()
    if row is None:
        raise DataQualityError(f"Rule {rule_id} does not exist.")
    ok, reason, definition = registry.validate_rule_for_approval(row.rule_definition, row.rule_scope)
    if not ok:
        raise DataQualityError(f"Rule {rule_id} cannot be approved: {reason}")
    return definition, _entry(log, rule_id, "approved", by, note, at)


def change_rule_status(log: DataFrame, rule_id: int, status: str, by: str, note: str | None = None, at=None) -> DataFrame:
    if status not in RULE_TARGETS:
        raise DataQualityError(f"Unsupported rule status: {status}")
    return _entry(log, rule_id, status, by, note, at)


def change_remediation_status(log: DataFrame, remediation_id: int, status: str, by: str, note: str | None = None, at=None) -> DataFrame:
    if status not in REMEDIATION_STATUSES:
        raise DataQualityError(f"Unsupported remediation status: {status}")
    return _entry(log, remediation_id, status, by, note, at)


def approved_only(log: DataFrame) -> DataFrame:
    """(subject_id, approved_by, approved_at) of what is approved now."""
    return current_status(log).where("status = 'approved'").select("subject_id", F.col("actor").alias("approved_by"), F.col("at").alias("approved_at"))


def table_or_empty(store, name: str, schema: str) -> DataFrame:
    return store.read(name) if store.exists(name) else store.spark.createDataFrame([], schema)


MOST_PARTS = 48  # of a log: one of more is made one part


def log_rows(store, table: str, rows: DataFrame) -> None:
    """Appends to a log, whose parts are put together once there are many."""
    store.append(table, rows)
    if len(store.parts(table)) > MOST_PARTS:
        store.compact(table)


# ---------------------------------------------------------------- runs


def record_phase(store, run_id: int, kind: str, dataset: str, phase: str, status: str, actor: str = "system", message: str | None = None) -> None:
    """Appends how a phase of a run stands: running, completed, skipped or failed."""
    number = next_id(table_or_empty(store, "control_run", RUNS), "entry")
    log_rows(store, "control_run", store.spark.createDataFrame([(number, run_id, kind, dataset, phase, status, actor, message, now())], RUNS))


def start_run(store, kind: str, dataset: str, actor: str = "system") -> int:
    """The id of a new run, of kind load, stewardship or remediation."""
    number = next_id(table_or_empty(store, "control_run", RUNS), "run_id")
    record_phase(store, number, kind, dataset, "run", "running", actor)
    return number


def run_states(runs: DataFrame) -> DataFrame:
    """(run_id, phase, kind, dataset_name, status, actor, message, started_at, at): the last entry
    of each phase of each run; the run as a whole is the phase ``run``."""
    last = runs.groupBy("run_id", "phase").agg(F.min("at").alias("started_at"), F.max_by(F.struct("kind", "dataset_name", "status", "actor", "message", "at"), F.struct("at", "entry")).alias("x"))
    return last.select("run_id", "phase", "x.kind", "x.dataset_name", "x.status", "x.actor", "x.message", "started_at", "x.at")


# ---------------------------------------------------------------- rules of a store


def save_rules(store, dataset: str, found: list[tuple[str, str | None, dict]], generated_by: str = "system", run_id: int | None = None) -> list[int]:
    """Stores the proposals (scope, column, definition) that the dataset doesn't have yet, as
    proposed; gives their ids. A dataset has some hundred rules at most."""
    rules = table_or_empty(store, "dq_rule", RULES)
    known = {(r.rule_scope, r.column_name, canonical(registry.executable_of(r.rule_definition))) for r in rules.where(F.col("dataset_name") == dataset).collect()}
    first, rows = next_id(rules, "rule_id"), []
    for scope, column, definition in found:
        own = (scope, column, canonical(registry.executable_of(definition)))
        if own not in known:
            known.add(own)
            targets = definition.get("target_columns") or ([column] if column else [])
            rows.append(rule_row(first + len(rows), dataset, definition, scope, column, targets, generated_by, run_id))
    if rows:
        store.append("dq_rule", store.spark.createDataFrame(rows, RULES))
        log = table_or_empty(store, "dq_rule_log", LOG)
        number, at = next_id(log, "entry"), now()
        log_rows(store, "dq_rule_log", store.spark.createDataFrame([(number + i, r[0], None, "proposed", generated_by, None, at) for i, r in enumerate(rows)], LOG))
    return [r[0] for r in rows]


def decide_rule(store, rule_id: int, status: str, by: str, note: str | None = None) -> None:
    """Approves a stored rule, as its registry has it, or gives it another status."""
    log = table_or_empty(store, "dq_rule_log", LOG)
    if status != "approved":
        log_rows(store, "dq_rule_log", change_rule_status(log, rule_id, status, by, note))
        return
    rules = store.read("dq_rule")
    definition, entry = approve_rule(rules, log, rule_id, by, note)
    changed = rules.where(F.col("rule_id") == rule_id).withColumns({"rule_definition": F.lit(json.dumps(definition)), "rule_type": F.lit(definition["executable_rule"]["type"])})
    merge_rows(store, "dq_rule", changed, "rule_id")
    log_rows(store, "dq_rule_log", entry)


def approved_rules(store, dataset: str) -> list[Rule]:
    """The rules of a dataset that are approved now."""
    if not store.exists("dq_rule"):
        return []
    approved = approved_only(table_or_empty(store, "dq_rule_log", LOG)).select(F.col("subject_id").alias("rule_id"))
    own = store.read("dq_rule").where(F.col("dataset_name") == dataset).join(approved, "rule_id").orderBy("rule_id")
    return [Rule(r.rule_id, r.rule_definition, r.column_name) for r in own.collect()]


# ---------------------------------------------------------------- remediations of a store

REMEDIATIONS = "remediation_id long, failed_record_id long, result_id long, rule_id long, dataset_name string, source_row_identifier string, issue_type string, original_values map<string,string>, suggested_values map<string,string>, confidence_score double, generation_method string, stewardship_run_id long"


def _numbered(df: DataFrame, first: int) -> Column:
    """Rising numbers from ``first``, with gaps between partitions; fixed once they are written."""
    return F.monotonically_increasing_id() + F.lit(first)


def save_remediations(store, dataset: str, made: DataFrame, run_id: int | None = None) -> None:
    first = next_id(table_or_empty(store, "dq_remediation", REMEDIATIONS), "remediation_id")
    rows = made.withColumns({"remediation_id": _numbered(made, first), "dataset_name": F.lit(dataset), "stewardship_run_id": F.lit(run_id).cast("long")})
    store.append("dq_remediation", rows.select(*[f.split()[0] for f in REMEDIATIONS.replace("map<string,string>", "map").split(", ")]))


def remediations(store) -> DataFrame:
    """All suggestions with their status; one without an entry is proposed."""
    status = current_status(table_or_empty(store, "dq_remediation_log", LOG)).select(F.col("subject_id").alias("remediation_id"), "status")
    return table_or_empty(store, "dq_remediation", REMEDIATIONS).join(status, "remediation_id", "left").withColumn("status", F.coalesce("status", F.lit("proposed")))


def decide_remediations(store, which: Column, status: str, by: str, note: str | None = None) -> None:
    """One decision on all suggestions for which ``which`` holds and which aren't applied."""
    if status not in REMEDIATION_STATUSES:
        raise DataQualityError(f"Unsupported remediation status: {status}")
    if not (by or "").strip():
        raise DataQualityError("A change of status needs an actor.")
    _log_remediations(store, remediations(store).where(which & (F.col("status") != APPLIED)).select("remediation_id", "status"), status, by.strip(), note)


def _log_remediations(store, subjects: DataFrame, status: str, by: str, note: str | None) -> None:
    """Appends an entry for each of ``subjects`` (remediation_id, status)."""
    first = next_id(table_or_empty(store, "dq_remediation_log", LOG), "entry")
    entries = subjects.select(_numbered(subjects, first).alias("entry"), F.col("remediation_id").alias("subject_id"), F.col("status").alias("from_status"), F.lit(status).alias("to_status"), F.lit(by).alias("actor"), F.lit(note).cast("string").alias("note"), F.lit(now()).alias("at"))
    log_rows(store, "dq_remediation_log", entries)


def mark_applied(store, applied: DataFrame, by: str, note: str | None = None) -> None:
    """Gives the remediations (remediation_id) that a version has applied that status."""
    _log_remediations(store, applied.select("remediation_id").distinct().withColumn("status", F.lit("approved")), APPLIED, by, note)


# ---------------------------------------------------------------- results


FAILED = "failed_record_id long, result_id long, rule_id long, dataset_name string, source_row_identifier string"


def _first_failed(store) -> int:
    return next_id(store.read("dq_failed_record"), "failed_record_id") if store.exists("dq_failed_record") else 1


def _failed_records(failures: DataFrame, results: dict[int, int], dataset: str, first: int) -> DataFrame:
    """FAILED rows of failing rows; ``results``: result ids by rule. The ids of the records rise
    from ``first`` with gaps and are fixed once the rows are written."""
    ids = failures.sparkSession.createDataFrame(list(results.items()), "rule_id long, result_id long")  # one row a rule
    named = failures.join(F.broadcast(ids), "rule_id")
    return named.select(_numbered(named, first).alias("failed_record_id"), "result_id", "rule_id", F.lit(dataset).alias("dataset_name"), "source_row_identifier")


def _result_rows(evaluation: Evaluation, ids: dict[int, int], run_id: int | None, at) -> DataFrame:
    rows = [(ids[r.rule_id], *r, at or now(), run_id) for r in evaluation.results.collect()]  # one row a rule
    return evaluation.results.sparkSession.createDataFrame(sorted(rows, key=lambda r: r[0]), RESULTS)


def results_of(evaluation: Evaluation, first_id: int, run_id: int | None = None, at=None, first_failed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Result rows and failed records with ids, of failures that are written or that a plan
    without shuffles gives (others: evaluate_recorded)."""
    found = sorted((r.rule_id, r.dataset_name) for r in evaluation.results.select("rule_id", "dataset_name").collect())
    ids = {rule: first_id + n for n, (rule, _) in enumerate(found)}
    return _result_rows(evaluation, ids, run_id, at), _failed_records(evaluation.failures, ids, found[0][1] if found else "", first_failed)


def evaluate_recorded(store, df: DataFrame, rules: list[Rule], primary_key: str | None = None, tables: dict | None = None, dataset: str = "", run_id: int | None = None, samples: bool = True, at=None) -> Evaluation:
    """An evaluation whose failing rows go to dq_failed_record in the job that counts them, and
    whose results follow in dq_result. The failures wait for the results, so both are seen at
    once, and what a broken run left never is."""
    awaited = Awaited("dq_result", store.next_version("dq_result"), uuid.uuid4().hex)
    first = next_id(store.read("dq_result"), "result_id") if store.exists("dq_result") else 1
    ids = {rule: first + n for n, rule in enumerate(sorted(r.rule_id for r in rules))}
    before = _first_failed(store)

    def keep(rows: DataFrame) -> DataFrame:
        # a later call is the one whose rows are to be seen
        awaiting.append(dataclasses.replace(awaited, token=uuid.uuid4().hex))
        return store.read_part(store.append("dq_failed_record", _failed_records(rows, ids, dataset, before), after=awaiting[-1])).select("rule_id", "source_row_identifier")

    awaiting = [awaited]
    found = evaluate(df, rules, primary_key, tables, dataset, samples, keep)
    store.append("dq_result", _result_rows(found, ids, run_id, at), token=awaiting[-1].token)
    return found


def rule_row(rule_id: int, dataset: str, definition: dict, scope: str, column: str | None, targets: list[str], generated_by: str, run_id: int | None = None) -> tuple:
    kind = {"llm": "llm_generated", "system": "system_generated"}.get(generated_by, definition["executable_rule"]["type"])
    return (rule_id, dataset, column, kind, scope, targets, json.dumps(definition), generated_by, run_id)


DATASETS = "dataset_name string, source_type string, source_file string, table_name string, primary_key string, load_mode string, active boolean, parser string"
PROFILES = "dataset_name string, column_name string, row_count long, null_count long, null_percent double, distinct_count long, inferred_type string, sample_values array<string>, min_value string, max_value string"
LOAD_RUNS = "load_run_id long, dataset_name string, mode string, status string, rows_read long, rows_inserted long, rows_updated long, duration_seconds double, finished_at timestamp, details string"


def merge_rows(store, table: str, rows: DataFrame, key: str) -> None:
    """Rows of a small control table, by key: those that are there are replaced."""
    if store.exists(table):
        rows = store.read(table).join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)
    store.write(table, rows)


def register_dataset(store, dataset) -> None:
    row = (dataset.name, dataset.source_type, dataset.source_file, dataset.table or dataset.name, dataset.primary_key, dataset.load_mode, dataset.active, json.dumps([[c.name, c.start, c.length, c.sequence] for c in dataset.parser]))
    merge_rows(store, "control_dataset", store.spark.createDataFrame([row], DATASETS), "dataset_name")


def save_profiles(store, profiles: list[dict]) -> None:
    """The profiles of a table in place of those it had."""
    names = [c.split()[0] for c in PROFILES.split(", ")]
    merge_rows(store, "control_profile", store.spark.createDataFrame([tuple(p.get(n) for n in names) for p in profiles], PROFILES), "dataset_name")


def record_load(store, summary, status: str = "completed", details: str | None = None) -> None:
    row = (summary.load_run_id, summary.dataset_name, summary.mode, status, summary.rows_read, summary.rows_inserted, summary.rows_updated, float(summary.duration_seconds), now(), details)
    log_rows(store, "control_load_run", store.spark.createDataFrame([row], LOAD_RUNS))


def load_recorded(store, dataset, file: str | None = None, mode: str | None = None):
    """Loads a file and records the run, also one that fails."""
    number = next_id(table_or_empty(store, "control_load_run", LOAD_RUNS), "load_run_id")
    began = now()
    try:
        summary = load(store, dataset, number, file, mode)
    except Exception as problem:
        seconds = (now() - began).total_seconds()
        record_load(store, LoadSummary(dataset.name, number, mode or dataset.load_mode or "", 0, 0, 0, seconds, ""), "failed", str(problem).split("\n")[0][:500])
        raise
    record_load(store, summary)
    return summary
