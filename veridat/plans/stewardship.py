"""The whole pipeline over one registered table: load, profile, propose, evaluate, suggest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import control, mine, propose, remediate
from ..operators import profile as profiles
from ..operators.evaluate import Evaluation
from ..operators.registry import COLUMN, DATASET, ROW, executable_of
from ..sources.load import Dataset, Store, reference_tables


@dataclass
class Run:
    """What one run has made, and how each phase went."""

    run_id: int
    dataset: str
    phases: list[tuple[str, str]] = field(default_factory=list)
    profiles: list[dict] = field(default_factory=list)
    new_rules: list[int] = field(default_factory=list)
    evaluation: Evaluation | None = None
    suggestions: DataFrame | None = None


def proposals(df: DataFrame, dataset: Dataset, found: list[dict], column_proposer: Callable, pair_proposer: Callable) -> list[tuple]:
    """(scope, column, definition) of all proposals of a table."""
    rules = [(COLUMN, c, d) for c, d, status in propose.propose_columns(found, column_proposer) if status == "proposed"]
    rules += [(DATASET, None, {"executable_rule": r}) for r in propose.propose_dataset(dataset.primary_key)]
    rules += [(scope, columns[0] if scope == COLUMN else None, {"executable_rule": r}) for scope, columns, r in propose.propose_references(df.columns)]
    order = [dataset.primary_key] if dataset.primary_key else [found[0]["column_name"]] if found else []
    sample = mine.bounded_sample(df, [p["column_name"] for p in found], order) if order else df
    pairs, _ = mine.mine(sample, found, proposer=pair_proposer)
    return rules + [(ROW, None, d) for d in pairs]


def propose_rules(store: Store, dataset: Dataset, found: list[dict], column_proposer: Callable = propose.default_column_rule, pair_proposer: Callable = mine.default_response, run_id: int | None = None) -> list[int]:
    """Stores what is proposed for a table that was profiled; gives the ids of new rules."""
    df = store.read(dataset.table or dataset.name)
    return control.save_rules(store, dataset.name, proposals(df, dataset, found, column_proposer, pair_proposer), run_id=run_id)


def judge(store: Store, dataset: Dataset, run_id: int | None = None) -> Evaluation:
    """Evaluates the approved rules of a table and records results and failures."""
    df = store.read(dataset.table or dataset.name)
    return control.evaluate_recorded(store, df, control.approved_rules(store, dataset.name), dataset.primary_key, reference_tables(store), dataset.name, run_id)


def suggest(store: Store, dataset: Dataset, run_id: int | None = None) -> DataFrame:
    """Stores suggestions for recorded failures that have none; gives the counts."""
    known = control.table_or_empty(store, "dq_remediation", control.REMEDIATIONS).select("failed_record_id")
    cleaned = [(r.rule_id, r.column, executable_of(r.definition)) for r in control.approved_rules(store, dataset.name)]
    failed, results = (store.read(t).where(F.col("dataset_name") == dataset.name) for t in ("dq_failed_record", "dq_result"))
    made, counts = remediate.generate(store.read(dataset.table or dataset.name), failed, results, cleaned, known, dataset.primary_key)
    figures = store.spark.createDataFrame([tuple(counts.first())], counts.schema)  # before what is saved becomes known
    control.save_remediations(store, dataset.name, made, run_id)
    return figures


def apply(store: Store, dataset: Dataset, actor: str) -> dict:
    """A new version from the approved remediations of a table, which then count as applied;
    the run is recorded, also one that fails."""
    run_id = control.start_run(store, "remediation", dataset.name, actor)
    try:
        approved = control.remediations(store).where((F.col("status") == "approved") & (F.col("dataset_name") == dataset.name))
        made = remediate.apply_version(store, dataset.table or dataset.name, approved, dataset.primary_key)
        control.mark_applied(store, made["applied"], actor, f"run {run_id}, version {made['version']}")
    except Exception as problem:
        control.record_phase(store, run_id, "remediation", dataset.name, "run", "failed", actor, str(problem)[:500])
        raise
    control.record_phase(store, run_id, "remediation", dataset.name, "run", "completed", actor, f"version {made['version']}, {made['changes']} changes")
    return made | {"run_id": run_id}


def run(store: Store, dataset: Dataset, column_proposer: Callable = propose.default_column_rule, pair_proposer: Callable = mine.default_response, file: str | None = None, actor: str = "system") -> Run:
    """All phases in order, each recorded; the first that fails ends the run. A phase without
    anything to do is skipped. Proposals wait for their approval: what is evaluated are the
    rules that are approved by then."""
    out = Run(control.start_run(store, "stewardship", dataset.name, actor), dataset.name)

    def load_phase():
        control.load_recorded(store, dataset, file)

    def profile_phase():
        out.profiles = profiles.profile(store.read(dataset.table or dataset.name), dataset=dataset.name)
        control.save_profiles(store, out.profiles)

    def rules_phase():
        out.new_rules = propose_rules(store, dataset, out.profiles, column_proposer, pair_proposer, out.run_id)

    def evaluate_phase():
        out.evaluation = judge(store, dataset, out.run_id)

    def remediate_phase():
        out.suggestions = suggest(store, dataset, out.run_id)

    idle = {"load": lambda: file is None, "evaluate": lambda: not control.approved_rules(store, dataset.name), "remediate": lambda: out.evaluation is None or not dataset.primary_key}
    steps = (load_phase, profile_phase, rules_phase, evaluate_phase, remediate_phase)
    for name, step in zip(control.PHASES, steps, strict=True):
        record = lambda status, message=None, name=name: control.record_phase(store, out.run_id, "stewardship", dataset.name, name, status, actor, message)
        if idle.get(name, lambda: False)():
            record("skipped")
            out.phases.append((name, "skipped"))
            continue
        record("running")
        try:
            step()
        except Exception as problem:
            out.phases.append((name, "failed"))
            record("failed", str(problem)[:500])
            control.record_phase(store, out.run_id, "stewardship", dataset.name, "run", "failed", actor, f"phase {name}")
            raise
        record("completed")
        out.phases.append((name, "completed"))
    control.record_phase(store, out.run_id, "stewardship", dataset.name, "run", "completed", actor)
    return out
