"""Commands over a store of tables: python -m veridat STORE COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import control
from .operators.evaluate import Rule
from .operators.profile import profile
from .plans import stewardship
from .sources import files, load

OPTIONS = {
    "register": ("--file", "--key", "--mode", "--parser"), "load": ("--file", "--mode"), "profile": (), "propose": (), "rules": (), "approve": ("--rule", "--by", "--note"), "status": ("--rule", "--to", "--by", "--note"),
    "evaluate": ("--rules",), "remediate": (), "remediations": (), "decide": ("--remediation", "--to", "--by", "--note"), "apply": ("--by",), "pipeline": ("--file", "--by"), "runs": (), "load-reference": ("--file", "--source-version"), "compact": (),
}


def _dataset(store: load.Store, name: str) -> load.Dataset:
    rows = control.table_or_empty(store, "control_dataset", control.DATASETS)
    row = rows.where(F.col("dataset_name") == load.identifier(name)).first()
    if row is None:
        raise SystemExit(f"Dataset '{name}' is not registered.")
    parser = tuple(files.FixedColumn(*c) for c in json.loads(row.parser or "[]"))
    return load.Dataset(row.dataset_name, row.source_type, row.source_file, row.table_name, row.primary_key, row.load_mode, parser, row.active)


def _shown(df) -> None:
    for line in df.toJSON().toLocalIterator():
        print(line)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="veridat")
    parser.add_argument("store", help="folder of the tables")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in OPTIONS.items():
        command = commands.add_parser(name)
        command.add_argument("dataset")
        for option in options:
            command.add_argument(option)
        if name == "load-reference":
            command.add_argument("--replace", action="store_true")
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    store = load.Store(spark, asked.store)
    if asked.command == "register":
        columns = ()
        if asked.parser:
            with open(asked.parser, encoding="utf-8") as source:
                columns = tuple(files.fixed_columns(source.read()))
        control.register_dataset(store, load.Dataset(asked.dataset, "fixed_width" if columns else "csv", asked.file, None, asked.key, asked.mode, columns))
        return
    if asked.command == "load-reference":
        reference = next((r for r in load.REFERENCES if r.name == asked.dataset), None)
        if reference is None:
            raise SystemExit(f"Reference dataset '{asked.dataset}' is not registered.")
        print(load.load_reference(store, reference, asked.file, asked.replace, asked.source_version))
        return
    if asked.command == "compact":
        print(store.compact(asked.dataset))
        return
    data = _dataset(store, asked.dataset)
    own = F.col("dataset_name") == data.name
    if asked.command == "load":
        print(json.dumps(control.load_recorded(store, data, asked.file, asked.mode).__dict__, default=str))
    elif asked.command == "profile":
        found = profile(store.read(data.table), dataset=data.name)
        control.save_profiles(store, found)
        print(json.dumps(found, default=str))
    elif asked.command == "propose":
        print(json.dumps(stewardship.propose_rules(store, data, profile(store.read(data.table), dataset=data.name))))
    elif asked.command == "rules":
        status = control.current_status(control.table_or_empty(store, "dq_rule_log", control.LOG)).select(F.col("subject_id").alias("rule_id"), "status")
        _shown(control.table_or_empty(store, "dq_rule", control.RULES).where(own).join(status, "rule_id", "left").orderBy("rule_id"))
    elif asked.command == "approve":
        control.decide_rule(store, int(asked.rule), "approved", asked.by, asked.note)
    elif asked.command == "status":
        control.decide_rule(store, int(asked.rule), asked.to, asked.by, asked.note)
    elif asked.command == "evaluate":
        if asked.rules:  # rules of a file, approved or not
            with open(asked.rules, encoding="utf-8") as source:
                rules = [Rule(i + 1, r["definition"], r.get("column")) for i, r in enumerate(json.load(source))]
            found = control.evaluate_recorded(store, store.read(data.table), rules, data.primary_key, load.reference_tables(store), data.name)
        else:
            found = stewardship.judge(store, data)
        _shown(found.results)
    elif asked.command == "remediate":
        _shown(stewardship.suggest(store, data))
    elif asked.command == "remediations":
        _shown(control.remediations(store).where(own).orderBy("remediation_id"))
    elif asked.command == "decide":
        which = own if asked.remediation in (None, "all") else own & (F.col("remediation_id") == int(asked.remediation))
        control.decide_remediations(store, which, asked.to, asked.by, asked.note)
    elif asked.command == "apply":
        made = stewardship.apply(store, data, asked.by or "system")
        print(json.dumps({k: v for k, v in made.items() if k != "applied"}))
    elif asked.command == "runs":
        _shown(control.run_states(control.table_or_empty(store, "control_run", control.RUNS)).where(own).orderBy("run_id", "started_at"))
    else:
        run = stewardship.run(store, data, file=asked.file, actor=asked.by or "system")
        print(json.dumps({"run_id": run.run_id, "phases": run.phases, "new_rules": run.new_rules}))


if __name__ == "__main__":
    main()
