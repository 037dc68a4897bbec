"""Corrections for location fields, and their application as new table versions."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.names import DataQualityError, find_column, identifier
from ..functions.text import populated, strip
from ..sources.awaited import Awaited
from .rules import col

# State codes.
STATES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|IA|ID|IL|IN|KS|KY|LA|MA|MD|ME|MI|MN|MO|MS|MT|NC|ND|NE|NH|NJ|NM|NV|NY|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VA|VT|WA|WI|WV|WY"
# What is moved, as far as it can be without loss.
CITY_STATE = rf"\A(.+?)[,\s]+({STATES})\s*\z"
CITY_ZIP = r"\A(.+?)\s+(\d{5}(?:-\d{4})?)\s*\z"
STATE_ZIP = rf"\A({STATES})[,\s-]+(\d{{5}}(?:-\d{{4}})?)\s*\z"
CONFIDENCE = 0.95
REMEDIABLE = ("city_contains_state_or_zip", "state_field_contains_zip")
_SUGGESTION = "struct<issue_type: string, original_values: map<string,string>, suggested_values: map<string,string>, confidence_score: double, generation_method: string>"


def _split(source: str, target: str, pattern: str, issue: str, trim_comma: bool) -> Column:
    """The suggestion to move what ``pattern`` finds from ``source`` to a blank ``target``."""
    s = strip(col(source))
    first = F.regexp_extract(s, pattern, 1)
    first = F.regexp_replace(strip(first), r",+\z", "") if trim_comma else first
    value = F.struct(
        F.lit(issue).alias("issue_type"),
        F.create_map(F.lit(source), col(source).cast("string"), F.lit(target), col(target).cast("string")).alias("original_values"),
        F.create_map(F.lit(source), first, F.lit(target), F.regexp_extract(s, pattern, 2)).alias("suggested_values"),
        F.lit(CONFIDENCE).alias("confidence_score"),
        F.lit("deterministic").alias("generation_method"),
    )
    return F.when(F.coalesce(s.rlike(pattern), F.lit(False)) & ~populated(col(target)), value)


def location_suggestion(columns: Iterable[str], rule_type: str, column: str | None = None, parameters: dict | None = None) -> Column:
    """A lossless correction of a failing row, or null where none is safe. A field that has
    a value is never overwritten."""
    p, columns = parameters or {}, list(columns)
    zip_ = find_column(columns, "zip", "zip_code", "postal_code")
    none = F.lit(None).cast(_SUGGESTION)
    if rule_type == "city_contains_state_or_zip":
        city = find_column(columns, p.get("city_column"), column, "city")
        state = find_column(columns, "state", "state_code")
        ways = [_split(city, t, pattern, issue, True) for t, pattern, issue in ((state, CITY_STATE, "city_contains_state"), (zip_, CITY_ZIP, "city_contains_zip")) if city and t]
        return F.coalesce(*ways, none)
    if rule_type == "state_field_contains_zip":
        state = find_column(columns, p.get("state_column"), column, "state", "state_code")
        return F.coalesce(_split(state, zip_, STATE_ZIP, "state_contains_zip", False), none) if state and zip_ else none
    return none


def generate(df: DataFrame, failed: DataFrame, results: DataFrame, rules: list, known: DataFrame, primary_key: str) -> tuple[DataFrame, DataFrame]:
    """Suggestions for failures that have none, and counts (failures, inserted, skipped).

    failed: (failed_record_id, result_id, rule_id, source_row_identifier); results:
    (result_id, status); rules: (rule_id, column, cleaned rule); known: (failed_record_id)."""
    if not primary_key:
        raise DataQualityError("Remediation needs a registered primary key.")
    due = failed.join(results.where("status = 'FAIL'").select("result_id"), "result_id").join(known.select("failed_record_id"), "failed_record_id", "left_anti")
    key = col(primary_key).cast("string")
    # of rows that repeat a key, the one that was loaded first stands for all (then: the least)
    order = [c for c in ("_load_run_id", "_dq_row_identifier") if c in df.columns]
    least = F.min(F.struct(*[col(c) for c in dict.fromkeys([*order, *df.columns])])).alias("row")
    rows = df.groupBy(key.alias("__key")).agg(least).select("__key", *[F.col("row")[c].alias(c) for c in df.columns])
    joined = due.join(rows, F.col("source_row_identifier") == F.col("__key"), "left")
    suggestion = F.lit(None).cast(_SUGGESTION)
    for rule_id, column, rule in rules:
        if rule["type"] in REMEDIABLE:
            suggestion = F.when(F.col("rule_id") == rule_id, location_suggestion(df.columns, rule["type"], column, rule["parameters"])).otherwise(suggestion)
    made = joined.select("failed_record_id", "result_id", "rule_id", "source_row_identifier", suggestion.alias("s"))
    counts = made.agg(F.count("*").alias("failures"), F.count("s").alias("inserted"), F.count_if(F.col("s").isNull()).alias("skipped"))
    return made.where("s is not null").select("failed_record_id", "result_id", "rule_id", "source_row_identifier", "s.*").withColumn("status", F.lit("proposed")), counts


def version_name(table: str, version: int) -> str:
    return f"{identifier(table, 'table name')[:42]}__v{version}"


def current_name(table: str) -> str:
    return f"{identifier(table, 'table name')[:50]}__current"


def field_changes(base: DataFrame, approved: DataFrame, primary_key: str) -> DataFrame:
    """(remediation_id, rule_id, row, column_name, old_value, new_value) of every change that
    ``approved`` (remediation_id, rule_id, source_row_identifier, suggested_values) makes, in
    order of ids: each sees what earlier ones left. Steps that change nothing, the key and
    columns that the table lacks are left out."""
    fields = [c for c in base.columns if c != primary_key]
    steps = approved.select("remediation_id", "rule_id", F.col("source_row_identifier").alias("row"), F.explode("suggested_values").alias("column_name", "new_value")).where(F.col("column_name").isin(fields))
    touched = base.join(steps.select(F.col("row").alias("__row")).distinct(), col(primary_key).cast("string") == F.col("__row"), "left_semi")
    cells = touched.select(col(primary_key).cast("string").alias("row"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in fields]), F.array(*[col(c).cast("string") for c in fields]))).alias("column_name", "base_value"))
    w = Window.partitionBy("row", "column_name").orderBy("remediation_id")
    before = F.when(F.row_number().over(w) == 1, F.col("base_value")).otherwise(F.lag("new_value").over(w))
    chained = steps.join(cells, ["row", "column_name"]).withColumn("old_value", before)
    return chained.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select("remediation_id", "rule_id", "row", "column_name", "old_value", "new_value")


def apply_changes(base: DataFrame, changes: DataFrame, primary_key: str) -> DataFrame:
    """``base`` with the last change of each field, in one join on the key."""
    last = changes.groupBy("row", "column_name").agg(F.max_by(F.struct("new_value"), "remediation_id").alias("v"))
    per_row = last.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "v"))).alias("changed"))
    joined = base.join(per_row, col(primary_key).cast("string") == F.col("row"), "left")
    new = lambda c, kind: F.when(F.map_contains_key("changed", F.lit(c)), F.col("changed")[c]["new_value"].cast(kind)).otherwise(col(c)).alias(c)
    return joined.select(*[new(f.name, f.dataType) if f.name != primary_key else col(f.name) for f in base.schema.fields])


def _named_by(base: DataFrame, primary_key: str) -> None:
    bad = base.groupBy(col(primary_key).cast("string").alias("k")).agg(F.count("*").alias("n")).where("k is null or n > 1")
    if not bad.isEmpty():
        raise DataQualityError("Row lineage needs a key that is unique and never null.")


def row_lineage(base: DataFrame, primary_key: str, version: int) -> DataFrame:
    """(dataset_version_id, curated_row_identifier, raw_source_row_identifier), one a row; a
    null or repeated key is an error, as no row could be named by it."""
    _named_by(base, primary_key)
    key = col(primary_key).cast("string")
    raw = col("_raw_source_row_identifier") if "_raw_source_row_identifier" in base.columns else key
    return base.select(F.lit(version).cast("long").alias("dataset_version_id"), key.alias("curated_row_identifier"), raw.alias("raw_source_row_identifier"))


def curated(base: DataFrame, primary_key: str, version: int) -> DataFrame:
    """``base`` with its version and the identifier of the raw row."""
    raw = col("_raw_source_row_identifier") if "_raw_source_row_identifier" in base.columns else col(primary_key).cast("string")
    rest = [c for c in base.columns if c not in ("_dataset_version_id", "_raw_source_row_identifier")]
    return base.select(*[col(c) for c in rest], F.lit(version).cast("long").alias("_dataset_version_id"), raw.alias("_raw_source_row_identifier"))


def lineage_of(store, table: str, primary_key: str, version: int | None = None) -> DataFrame:
    """(dataset_version_id, curated_row_identifier, raw_source_row_identifier, changed_in) of every
    row of a version: the lineage of rows that versions changed is recorded, that of the others
    is what the version's rows say. ``changed_in`` is the last version up to this one that
    changed the row, 0 if none has."""
    name = current_name(table)
    number = version or store.version(name)
    rows = store.read(name, number).select(F.lit(number).cast("long").alias("dataset_version_id"), col(primary_key).cast("string").alias("curated_row_identifier"), F.col("_raw_source_row_identifier").alias("raw_source_row_identifier"))
    recorded = store.read(f"{table}__lineage").where(F.col("dataset_version_id") <= number).groupBy("curated_row_identifier").agg(F.max("dataset_version_id").alias("changed_in"))
    return rows.join(recorded, "curated_row_identifier", "left").select(*rows.columns, F.coalesce("changed_in", F.lit(0)).cast("long").alias("changed_in"))


def apply_version(store, table: str, approved: DataFrame, primary_key: str) -> dict:
    """A new immutable version of a curated table from approved remediations.

    Its base is the latest version, else the raw table: rows that were loaded since don't
    reach it. ``applied`` are the remediations (remediation_id) that changed something; one
    without any change stays approved. Lineage is recorded for the rows that the version
    changes (lineage_of has it for all).

    History and lineage wait for the version, so publishing that makes all three visible at
    once; what a run leaves that breaks off before is never seen, and a repeat takes its place."""
    name, token = current_name(table), uuid.uuid4().hex
    number = store.next_version(name)
    made = store.version(name)
    base = store.read(name, made) if made else store.read(table)
    if not made:
        _named_by(base, primary_key)  # corrections leave keys as they are, so later versions needn't be looked at
    awaited = Awaited(name, number, token)
    changes = store.read_part(store.append(f"{table}__history", field_changes(base, approved, primary_key).withColumn("dataset_version_id", F.lit(number).cast("long")), after=awaited))
    raw = col("_raw_source_row_identifier") if made else col(primary_key).cast("string")
    touched = base.join(changes.select("row").distinct(), col(primary_key).cast("string") == F.col("row"), "left_semi")
    store.append(f"{table}__lineage", touched.select(F.lit(number).cast("long").alias("dataset_version_id"), col(primary_key).cast("string").alias("curated_row_identifier"), raw.alias("raw_source_row_identifier")), after=awaited)
    counted = Observation()
    path = store.write(name, curated(apply_changes(base, changes, primary_key), primary_key, number).observe(counted, F.count("*").alias("n")), token)
    return {"version": number, "name": version_name(table, number), "path": path, "applied": changes.select("remediation_id").distinct(), "changes": changes.count(), "rows": counted.get["n"]}
