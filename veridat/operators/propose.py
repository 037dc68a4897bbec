"""Rule proposals: of columns by a proposer, of tables and references by rule."""

from __future__ import annotations

import json
from collections.abc import Callable

from ..functions.names import canonical, find_column, words
from ..sources.load import REFERENCES
from . import registry

# Words in the names of columns whose values aren't a closed list.
FREE_TEXT = frozenset("name address city street description".split())
MOST_VALUES = 25


def column_prompt(profile: dict) -> str:
    """What a proposer gets to see of a column: its profile as one object, and how to answer."""
    named = {"column_name", "dataset_name"}
    facts = {k: v for k, v in sorted(profile.items()) if k not in named and v is not None}
    answer = {"executable_rule": {"type": "one of the above, or none", "parameters": {}}, "confidence_score": "from 0 to 1", "evidence": "what in the profile says so"}
    return "\n".join(
        (
            f"Which data quality rule, if any, does the column {profile['column_name']!r} of {profile.get('dataset_name') or 'a table'!r} call for?",
            f"Known of its values: {json.dumps(facts, default=str, ensure_ascii=False)}",
            f"Rules:\n{registry.rule_catalog(registry.COLUMN)}",
            f"Reply with a JSON object of this form: {json.dumps(answer)}. Name no rule that these facts don't bear out; a list of allowed values only suits a small set that is known whole.",
        )
    )


def guarded(profile: dict, definition: dict) -> dict:
    """Lists of allowed values for free-text columns with many values become no rule."""
    rule = definition.get("executable_rule") or {}
    if rule.get("type") == "allowed_values" and set(words(profile["column_name"])) & FREE_TEXT and int(profile.get("distinct_count") or 0) > MOST_VALUES:
        return {**definition, "guardrail_applied": True, "executable_rule": {"type": "not_executable", "parameters": {}}}
    return definition


def default_column_rule(profile: dict) -> dict:
    """A rule that the profile alone supports, for use without a proposer."""
    none = {"confidence_score": 1.0, "evidence": "", "executable_rule": {"type": "none"}}
    if profile["inferred_type"] == "percentage":
        return {**none, "executable_rule": {"type": "regex", "parameters": {"pattern": r"\d+(\.\d+)?%"}}}
    if profile["inferred_type"] == "currency":
        return {**none, "executable_rule": {"type": "regex", "parameters": {"pattern": r"\$[\d,]+(\.\d+)?"}}}
    return none


def propose_columns(profiles: list[dict], proposer: Callable[[dict], dict] = default_column_rule) -> list[tuple[str, dict, str]]:
    """(column, definition, status) of each proposal that the registry accepts."""
    out = []
    for p in profiles:
        answer = proposer(p)
        rule = (answer or {}).get("executable_rule") or {}
        if rule.get("type") in (None, "none"):
            continue
        ok, _, cleaned = registry.validate_executable_rule(rule, registry.COLUMN)
        if ok:
            definition = guarded(p, {**answer, "executable_rule": cleaned})
            out.append((p["column_name"], definition, "guardrail_rejected" if definition.get("guardrail_applied") else "proposed"))
    return out


def propose_dataset(primary_key: str | None = None) -> list[dict]:
    rules = [{"type": "minimum_row_count", "parameters": {"minimum_rows": 1}}]
    if primary_key:
        rules.append({"type": "primary_key_unique", "parameters": {"column": primary_key}})
    return rules


# Under which names columns hold the keys of reference tables, and what a rule calls them.
KEY_NAMES = {"state_code": ("state_code", "state"), "zip_code": ("zip_code", "zip", "postal_code"), "place_name": ("city", "place_name"), "naics_code": ("naics_code", "naics")}
KEY_PARAMETERS = {"place_name": "city_column", "state_code": "state_column", "zip_code": "zip_column"}


def propose_references(columns: list[str], references: tuple = REFERENCES) -> list[tuple[str, list[str], dict]]:
    """(scope, columns, rule) for the reference tables whose keys have a column here.

    A table is asked for its leading key alone, if no table before it has the same one, and for
    all its keys together, where each has a column and a parameter of the combined rule."""
    alone, together, led = [], [], set()
    for table in references:
        held = {k: c for k in table.key_columns if (c := find_column(columns, *KEY_NAMES.get(k, ())))}
        lead = table.key_columns[0]
        if lead in held and lead not in led:
            led.add(lead)
            alone.append((registry.COLUMN, [held[lead]], {"type": "reference_value", "parameters": {"reference_dataset": table.name, "reference_column": lead}}))
        if len(held) == len(table.key_columns) > 1 and set(held) == set(KEY_PARAMETERS):
            own = {parameter: held[k] for k, parameter in KEY_PARAMETERS.items()}
            together.append((registry.ROW, list(own.values()), {"type": "city_state_zip_reference", "parameters": own | {"reference_dataset": table.name}}))
    return alone + together


def new_rules(rules: list[dict], known: list[dict]) -> list[dict]:
    """Those of ``rules`` that none of ``known`` equals."""
    seen = {canonical(r) for r in known}
    return [r for r in rules if canonical(r) not in seen and not seen.add(canonical(r))]
