"""Rules as Spark plans.

A rule becomes a Column that is true for failing rows, or a frame to join with: reference
keys for an anti-join, duplicate keys for a semi-join. Predicates are never null.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import DataQualityError
from ..functions.patterns import java_pattern
from ..functions.text import date, dated, full_match, number, populated, strip, supported_format, whole_number
from .duplicates import possible

_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
NUMERIC_SHARE = 0.95
WHOLE = "decimal(38,0)"


@dataclass
class Plan:
    """How a rule is evaluated. One of: ``fails`` (a predicate), ``keys`` (a join on
    ``on``, failing where ``found`` says whether a match is good or bad), ``minimum``."""

    columns: list[str]
    fails: Column | None = None
    keys: DataFrame | None = None
    on: list[Column] = field(default_factory=list)  # of the source rows, in the order of the keys
    match_is_failure: bool = False
    applies: Column | None = None  # of a join: rows that are judged at all
    minimum: int | None = None
    source: DataFrame | None = None  # of duplicate keys: the rows that may repeat one
    small: bool | None = None  # whether the keys are few enough to send to all executors
    extras: dict[str, Column] = field(default_factory=dict)  # further counts


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _need(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise DataQualityError(f"Column '{c}' does not exist in dataset.")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _listed(df: DataFrame, name: str, values: list) -> Column:
    """Whether the untrimmed value is in the list; other types than the column's never are."""
    kind = df.schema[name].dataType
    fits = {
        T.StringType: lambda v: isinstance(v, str),
        T.BooleanType: lambda v: isinstance(v, bool),
        T.DoubleType: lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
        T.FloatType: lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    }.get(type(kind), lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) if isinstance(kind, T.NumericType) else isinstance(v, str))
    values = [v for v in values if fits(v)]
    return col(name).isin(*values) if values else F.lit(False)


def _filled(df: DataFrame, name: str) -> Column:
    """As populated(); only text can be blank without being null."""
    return populated(col(name)) if isinstance(df.schema[name].dataType, T.StringType) else col(name).isNotNull()


def _number(df: DataFrame, name: str) -> tuple[Column, Column]:
    """The value as a double, and exactly where it is a whole number (else null)."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.NumericType):
        return number(col(name)), whole_number(col(name))
    whole = isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0
    return col(name).cast("double"), (col(name) if whole else F.lit(None)).cast(WHOLE)


def _beyond(value: tuple[Column, Column], bound: float, compare: Callable) -> Column:
    """Whether a value lies beyond a bound; whole numbers are compared exactly."""
    plain = compare(value[0], F.lit(float(bound)))
    if isinstance(bound, float) or abs(bound) >= 10**38:
        return plain
    return F.when(value[1].isNotNull(), compare(value[1], F.lit(Decimal(bound)).cast(WHOLE))).otherwise(plain)


def _range(df: DataFrame, name: str, p: dict) -> Column:
    n = _number(df, name)
    return _false(_filled(df, name) & (n[0].isNull() | _beyond(n, p["min"], operator.lt) | _beyond(n, p["max"], operator.gt)))


def allowed_values(df, name, p) -> Plan:
    return Plan([name], _false(col(name).isNotNull() & ~_listed(df, name, p["values"])))


def not_null(df, name, p) -> Plan:
    return Plan([name], ~_filled(df, name))


def max_length(df, name, p) -> Plan:
    return Plan([name], _filled(df, name) & (F.char_length(strip(col(name))) > p["max_length"]))


def min_length(df, name, p) -> Plan:
    return Plan([name], _filled(df, name) & (F.char_length(strip(col(name))) < p["min_length"]))


def regex(df, name, p) -> Plan:
    return Plan([name], _filled(df, name) & ~full_match(strip(col(name)), java_pattern(p["pattern"])))


def numeric_range(df, name, p) -> Plan:
    return Plan([name], _range(df, name, p))


def date_format(df, name, p) -> Plan:
    if not supported_format(p["format"]):
        raise DataQualityError(f"Unsupported date format: {p['format']!r}")
    return Plan([name], populated(col(name)) & dated(col(name), p["format"]).isNull())


def city_contains_state_or_zip(df, name, p) -> Plan:
    name = p.get("city_column") or name
    _need(df, name)
    s = F.coalesce(strip(col(name)), F.lit(""))
    return Plan([name], s.rlike(r"\b\d{5}(?:-\d{4})?\b") | s.rlike(r"(?:,\s*|\s+)[A-Z]{2}\s*\z"))


def state_field_contains_zip(df, name, p) -> Plan:
    name = p.get("state_column") or name
    _need(df, name)
    return Plan([name], F.coalesce(strip(col(name)), F.lit("")).rlike(r"\d{5}(?:-\d{4})?"))


def compares_dates(p: dict) -> bool:
    return all("date" in p[side].lower() for side in ("left_column", "right_column"))


def column_comparison(df, name, p, shares: dict | None = None) -> Plan:
    left, right, ignore = p["left_column"], p["right_column"], p.get("null_behavior", "ignore") == "ignore"
    _need(df, left, right)
    a, b, compare = col(left), col(right), _COMPARE[p["operator"]]
    kinds = [df.schema[c].dataType for c in (left, right)]
    if compares_dates(p):
        a, b = date(a), date(b)
        holds = compare(a, b)
    elif all(isinstance(k, T.NumericType) for k in kinds):
        holds = compare(a, b)
    elif _numeric(df, left, shares) and _numeric(df, right, shares):
        (a, exact_a), (b, exact_b) = _number(df, left), _number(df, right)
        holds = F.when(exact_a.isNotNull() & exact_b.isNotNull(), compare(exact_a, exact_b)).otherwise(compare(a, b))
    else:
        if kinds[0] != kinds[1]:
            a, b = a.cast("string"), b.cast("string")
        holds = compare(a, b)
    # null where either is null, so that each side is computed once
    return Plan([left, right], F.coalesce(~holds, F.lit(not ignore)), extras={"comparable_count": a.isNotNull() & b.isNotNull()})


def _numeric(df: DataFrame, name: str, shares: dict | None) -> bool:
    if isinstance(df.schema[name].dataType, T.NumericType):
        return True
    if shares is None or name not in shares:
        shares = numeric_shares(df, [name])
    return shares[name] >= NUMERIC_SHARE


def unsure_columns(df: DataFrame, p: dict) -> list[str]:
    """Columns of a comparison of which only the data tell whether they hold numbers: text,
    where neither the names say dates nor both types say numbers."""
    sides = [p["left_column"], p["right_column"]]
    if compares_dates(p) or not set(sides) <= set(df.columns):
        return []
    return [c for c in sides if not isinstance(df.schema[c].dataType, T.NumericType)]


def numeric_shares(df: DataFrame, names: list[str]) -> dict[str, float]:
    """The share of each column's non-null values that are numbers, in one aggregate."""
    if not names:
        return {}
    row = df.agg(*[x for i, n in enumerate(names) for x in (F.count(number(col(n))).alias(f"n{i}"), F.count(col(n)).alias(f"t{i}"))]).first()
    return {n: row[f"n{i}"] / max(row[f"t{i}"], 1) for i, n in enumerate(names)}


def conditional_required(df, name, p) -> Plan:
    cond, required = p["condition_column"], p["required_column"]
    _need(df, cond, required)
    holds = _false(strip(col(cond)) == F.lit(str(p["condition_value"])))
    return Plan([cond, required], holds & ~_filled(df, required), extras={"condition_match_count": holds})


def at_least_one_present(df, name, p) -> Plan:
    _need(df, *p["columns"])
    return Plan(list(p["columns"]), ~reduce(operator.or_, [_filled(df, c) for c in p["columns"]]))


def columns_equal(df, name, p) -> Plan:
    columns = p["columns"]
    _need(df, *columns)
    first, *others = [strip(col(c)) for c in columns]
    same = reduce(operator.and_, [o == first for o in others])
    fails = ~same  # null where an operand is null and no pair is unequal
    if p.get("ignore_nulls", True):
        fails = reduce(operator.and_, [col(c).isNotNull() for c in columns]) & fails
    return Plan(list(columns), _false(fails))


def reference(df, name, p, tables: dict) -> Plan:
    """Populated keys that the reference table lacks. ``tables``: name to (frame, key columns)."""
    mapping = p["column_mapping"]
    if p["reference_dataset"] not in tables:
        raise DataQualityError(f"Reference dataset '{p['reference_dataset']}' is not registered.")
    table, keys = tables[p["reference_dataset"]]
    if missing := [c for c in mapping.values() if c not in keys]:
        raise DataQualityError(f"Columns {missing} are not keys of reference dataset '{p['reference_dataset']}'.")
    _need(df, *mapping)
    fold = (lambda c: c) if p.get("case_sensitive", False) else F.lower
    wanted = table.select(*[fold(col(c).cast("string")).alias(f"k{i}") for i, c in enumerate(mapping.values())]).distinct()
    judged = reduce(operator.and_, [_filled(df, c) for c in mapping])
    plan = Plan(list(mapping), keys=wanted, on=[fold(strip(col(c))) for c in mapping], applies=judged)
    if not p.get("ignore_nulls", True):
        plan.applies = F.lit(True)  # a missing part then is a combination that no reference has
    return plan


def reference_value(df, name, p, tables) -> Plan:
    return reference(df, name, {"reference_dataset": p["reference_dataset"], "column_mapping": {name: p["reference_column"]}, "case_sensitive": p.get("case_sensitive", False)}, tables)


def city_state_zip_reference(df, name, p, tables) -> Plan:
    mapping = {p["city_column"]: "place_name", p["state_column"]: "state_code", p["zip_column"]: "zip_code"}
    return reference(df, name, {"reference_dataset": p.get("reference_dataset", "us_zip_codes"), "column_mapping": mapping, "case_sensitive": p.get("case_sensitive", False), "ignore_nulls": p.get("ignore_nulls", True)}, tables)


def minimum_row_count(df, name, p) -> Plan:
    return Plan([], minimum=p["minimum_rows"])


LEAST_ROWS = 5_000_000  # a table of fewer is grouped as it is
MOST_SHARED = 2_000_000  # shared places of keys that are sent to all executors


def unique(df, columns: list[str]) -> Plan:
    """Every member of a duplicate group fails; nulls equal each other; no trimming. In a large table
    keys are counted among the rows only that may repeat one, unless those are very many."""
    _need(df, *columns)
    source = possible(df, [col(c) for c in columns], LEAST_ROWS, MOST_SHARED)
    keys = (df if source is None else source).groupBy(*[col(c).alias(f"k{i}") for i, c in enumerate(columns)]).agg(F.count("*").alias("times")).where("times > 1").drop("times")
    return Plan(list(columns), keys=keys, on=[col(c) for c in columns], match_is_failure=True, applies=F.lit(True), source=source)


PLANS: dict[str, Callable] = {
    "allowed_values": allowed_values, "not_null": not_null, "max_length": max_length, "min_length": min_length, "regex": regex, "numeric_range": numeric_range, "percentage_range": numeric_range, "date_format": date_format,
    "city_contains_state_or_zip": city_contains_state_or_zip, "state_field_contains_zip": state_field_contains_zip, "column_comparison": column_comparison, "conditional_required": conditional_required,
    "at_least_one_present": at_least_one_present, "columns_equal": columns_equal, "minimum_row_count": minimum_row_count,
    "primary_key_unique": lambda df, name, p: unique(df, [p["column"]]), "column_combination_unique": lambda df, name, p: unique(df, p["columns"]),
}
REFERENCE_PLANS = {"reference_value": reference_value, "reference_combination": reference, "city_state_zip_reference": city_state_zip_reference}


def plan_rule(df: DataFrame, rule: dict, column: str | None, tables: dict, shares: dict | None = None) -> Plan:
    """The plan of a validated rule. COLUMN rules judge ``column``."""
    kind, p = rule["type"], rule["parameters"]
    if column is not None and not (p.get("city_column") or p.get("state_column")) and kind not in ("column_comparison",):
        _need(df, column)
    if kind in REFERENCE_PLANS:
        return REFERENCE_PLANS[kind](df, column, p, tables)
    if kind == "column_comparison":
        return column_comparison(df, column, p, shares)
    return PLANS[kind](df, column, p)
