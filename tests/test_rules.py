"""All rules over a table of parcels, each against a plain check of the same rows."""

import collections
import json
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from veridat.operators import registry
from pyspark.sql import functions as F

from veridat.operators import duplicates, rules
from veridat.operators import evaluate as evaluation
from veridat.operators.control import evaluate_recorded
from veridat.operators.evaluate import Rule, evaluate, evaluate_rule, rule_counts
from veridat.sources.load import Store

# parcel, depot, grade, note, weight, share, sent, due, town, county, post, phone, mail, name, alias
PARCELS = [
    ("p1", "north", "gold", "fragile", "12.5", 0.4, "2025-03-01", "2025-03-04", "Salem", "OR", "97301", "1", "a@x", "Ada", "Ada"),
    ("p2", "north", "gold", " ", "7", 0.9, "2025-03-02", "2025-03-01", "Salem OR", "OR", "97301", None, None, "Bo", "Bob"),
    ("p3", "south", "silver", None, "-3", 1.2, "03/05/2025", "2025-03-09", "Bend 97701", "OR 97701", "", "2", None, "Cy", None),
    ("p4", "south", "bronze", "x" * 30, "heavy", -0.1, "2025-02-30", None, "Bend", "or", "97701", "", " ", "Di", "Di"),
    ("p5", "west", "gold", "ok", "1e3", 0.0, "", "2025-03-07", "Reno", "NV", "89501", "3", "b@x", " Ed ", "Ed"),
    ("p5", "west", None, "ok", None, None, None, None, None, None, None, None, None, None, None),
]
FIELDS = "parcel depot grade note weight share sent_date due_date town county post phone mail name alias".split()


@pytest.fixture(scope="module")
def parcels(spark):
    return spark.createDataFrame(PARCELS, ", ".join(f"{f} {'double' if f == 'share' else 'string'}" for f in FIELDS)).cache()


@pytest.fixture(scope="module")
def tables(spark):
    post = spark.createDataFrame([("97301", "SALEM", "OR"), ("97701", "Bend", "OR"), ("89501", "Reno", "NV")], "zip_code string, place_name string, state_code string")
    return {"us_zip_codes": (post, ("zip_code", "place_name", "state_code")), "grades": (spark.createDataFrame([("Gold",), ("SILVER",)], "grade string"), ("grade",))}


def rows():
    return [dict(zip(FIELDS, p, strict=True)) for p in PARCELS]


def has(value):
    return value is not None and str(value).strip() != ""


def post_known(r):
    known = {("salem", "or", "97301"), ("bend", "or", "97701"), ("reno", "nv", "89501")}
    parts = [r["town"], r["county"], r["post"]]
    return not all(map(has, parts)) or tuple(x.strip().lower() for x in parts) in known


# rule, parameters, column, and what a good row has
CHECKS = [
    ("column_combination_unique", {"columns": ["parcel", "depot"]}, None, lambda r: r["parcel"] != "p5"),
    ("primary_key_unique", {"column": "parcel"}, None, lambda r: r["parcel"] != "p5"),
    ("numeric_range", {"min": 0, "max": 500}, "weight", lambda r: not has(r["weight"]) or r["weight"] in ("12.5", "7")),
    ("percentage_range", {"min": 0, "max": 1}, "share", lambda r: r["share"] is None or 0 <= r["share"] <= 1),
    ("column_comparison", {"left_column": "sent_date", "operator": "<=", "right_column": "due_date"}, None, lambda r: r["parcel"] != "p2"),
    ("columns_equal", {"columns": ["name", "alias"]}, None, lambda r: r["parcel"] != "p2"),
    ("conditional_required", {"condition_column": "grade", "condition_operator": "==", "condition_value": "gold", "required_column": "mail"}, None, lambda r: r["grade"] != "gold" or has(r["mail"])),
    ("at_least_one_present", {"columns": ["phone", "mail"]}, None, lambda r: has(r["phone"]) or has(r["mail"])),
    ("date_format", {"format": "YYYY-MM-DD"}, "sent_date", lambda r: not has(r["sent_date"]) or r["parcel"] in ("p1", "p2")),
    ("allowed_values", {"values": ["gold", "silver"]}, "grade", lambda r: r["grade"] in (None, "gold", "silver")),
    ("reference_value", {"reference_dataset": "grades", "reference_column": "grade"}, "grade", lambda r: r["grade"] in (None, "gold", "silver")),
    ("not_null", {}, "note", lambda r: has(r["note"])),
    ("max_length", {"max_length": 7}, "note", lambda r: not has(r["note"]) or len(r["note"]) <= 7),
    ("min_length", {"min_length": 3}, "note", lambda r: not has(r["note"]) or len(r["note"]) >= 3),
    ("regex", {"pattern": "[A-Z][a-z]"}, "name", lambda r: not has(r["name"]) or bool(re.fullmatch("[A-Z][a-z]", r["name"].strip()))),
    ("state_field_contains_zip", {}, "county", lambda r: r["parcel"] != "p3"),
    ("city_contains_state_or_zip", {}, "town", lambda r: r["parcel"] not in ("p2", "p3")),
    ("city_state_zip_reference", {"city_column": "town", "state_column": "county", "zip_column": "post"}, None, post_known),
    ("reference_combination", {"reference_dataset": "us_zip_codes", "column_mapping": {"county": "state_code", "post": "zip_code"}}, None, lambda r: True),
]


def definition(kind, parameters):
    return {"executable_rule": {"type": kind, "parameters": parameters}}


def asked():
    return [Rule(10 + i, definition(kind, given), column) for i, (kind, given, column, _) in enumerate(CHECKS)]


def wanted():
    return {10 + i: sorted(r["parcel"] for r in rows() if not good(r)) for i, (*_, good) in enumerate(CHECKS)}


def test_every_rule_finds_the_rows_that_the_plain_check_finds(parcels, tables):
    found = evaluate(parcels, asked(), "parcel", tables, "parcels")
    by: dict = {i: [] for i in wanted()}
    for r in found.failures.collect():
        by[r.rule_id].append(r.source_row_identifier)
    assert {CHECKS[i - 10][0]: sorted(v) for i, v in by.items()} == {CHECKS[i - 10][0]: v for i, v in wanted().items()}
    for r in found.results.collect():
        n = len(wanted()[r.rule_id])
        assert (r.failed_count, r.status, r.dataset_name) == (n, "FAIL" if n else "PASS", "parcels")


def test_counts_without_actions(parcels, tables):
    few = Rule(1, definition("minimum_row_count", {"minimum_rows": 7}))
    enough = Rule(2, definition("minimum_row_count", {"minimum_rows": 6}))
    got = {r.rule_id: r.failed_count for r in rule_counts(parcels, [*asked(), few, enough], tables).collect()}
    assert got == {**{i: len(v) for i, v in wanted().items()}, 1: 1, 2: 0}


def test_details_have_further_counts(parcels):
    (compared,) = [r for r in asked() if r.rule_id == 14]
    (required,) = [r for r in asked() if r.rule_id == 16]
    details = {r.rule_id: json.loads(r.details) for r in evaluate(parcels, [compared, required], "parcel").results.collect()}
    assert details[14]["comparable_count"] == 3 and details[16]["condition_match_count"] == 3


def test_predicates_share_one_scan(spark, tmp_path, parcels):
    parcels.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plain = [r for r in asked() if r.definition["executable_rule"]["type"] in ("numeric_range", "not_null", "regex", "max_length")]
    plan = rule_counts(df, plain)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "BatchEvalPython" not in plan and "phone" not in plan


def test_whole_numbers_are_compared_exactly(spark):
    big = 2**53
    rows_ = [(str(big + 1), str(big), big + 1, big)] * 30
    df = spark.createDataFrame(rows_, "a string, b string, c long, d long")
    for left, right in (("a", "b"), ("c", "d"), ("a", "d"), ("c", "b")):
        for operator, failed in (("==", 30), (">", 0), ("<=", 30), ("!=", 0)):
            assert evaluate_rule(definition("column_comparison", {"left_column": left, "operator": operator, "right_column": right}), df)[1]["failed_count"] == failed
    for column in ("a", "c"):
        assert evaluate_rule(definition("numeric_range", {"min": 0, "max": big}), df, column=column)[1]["failed_count"] == 30
        assert evaluate_rule(definition("numeric_range", {"min": 0, "max": big + 1}), df, column=column)[1]["failed_count"] == 0
    mixed = spark.createDataFrame([("1.5", "1"), ("2", "2.0"), ("1e2", "99")], "a string, b string")
    assert evaluate_rule(definition("column_comparison", {"left_column": "a", "operator": ">=", "right_column": "b"}), mixed)[1]["failed_count"] == 0
    assert evaluate_rule(definition("numeric_range", {"min": 1.5, "max": 10**20}), mixed, column="b")[1]["failed_count"] == 1


@pytest.mark.parametrize(
    ("pattern", "good", "bad"),
    [
        (r"(?P<year>9.*)", "9x", "8x"), (r"(?P<a_b>x+)-(?P=a_b)", "xx-xx", "xx-x"), (r"\w+", "éß", "a b"), (r"\d+", "٣4", "x"), (r"a\Z", "a", "b"), (r"[[a]+", "[a", "b"), (r"[a&&b]+", "&b", "c"),
        (r"(?i)straße", "STRAßE", "x"), (r"(?#note)ab", "ab", "note"), (r"[^\W\d]+", "abc", "a1"), (r"a.b", "a\rb", "ab"), (r"(?a:\w)+", "ab", "é"), (r"[]a]+", "]a", "["), (r"x{,3}", "xx", "xxxx"), (r"\N{DIGIT ONE}\u0041", "1A", "1B"),
    ],
)
def test_patterns_mean_what_they_mean_in_python(spark, pattern, good, bad):
    assert re.fullmatch(pattern, good) and not re.fullmatch(pattern, bad)
    df = spark.createDataFrame([(good,), (bad,)], "v string")
    assert evaluate_rule(definition("regex", {"pattern": pattern}), df, column="v") [1]["failed_count"] == 1


def test_patterns_that_spark_cannot_have_are_errors(spark):
    df = spark.createDataFrame([("a",)], "v string")
    for pattern in (r"(a)?(?(1)b|c)", "("):
        assert evaluate_rule(definition("regex", {"pattern": pattern}), df, column="v")[0] == "ERROR"


def test_a_rule_that_cannot_run_leaves_the_others_alone(parcels):
    odd = [Rule(1, "[1", "note"), Rule(2, definition("no_such_rule", {})), Rule(3, definition("not_null", {}), "nowhere"), Rule(4, definition("not_null", {}), "note"), Rule(5, definition("reference_value", {"reference_dataset": "none", "reference_column": "x"}), "note")]
    found = {r.rule_id: (r.status, r.failed_count) for r in evaluate(parcels, odd, "parcel").results.collect()}
    assert found == {1: ("ERROR", 0), 2: ("ERROR", 0), 3: ("ERROR", 0), 4: ("FAIL", 2), 5: ("ERROR", 0)}


def test_samples_are_few_and_failures_are_all(spark):
    df = spark.range(37).selectExpr("cast(id as string) as k", "cast(null as string) as v")
    found = evaluate(df, [Rule(8, definition("not_null", {}), "v")], "k")
    assert len(json.loads(found.results.first().details)["sample_failures"]) == 10
    assert {r.source_row_identifier for r in found.failures.collect()} == {str(i) for i in range(37)}
    assert evaluate_rule(definition("not_null", {}), df.limit(0), "k", "v") == ("PASS", {"failed_count": 0})


def test_listed_values_keep_their_types(spark):
    df = spark.createDataFrame([("7", 7, True), ("seven", 8, False)], "t string, n int, b boolean")
    for column, values, failed in (("t", [7, "seven"], 1), ("n", ["7", 8], 1), ("n", [7.0, 8], 0), ("b", [1, True], 1), ("t", [], 2)):
        assert evaluate_rule(definition("allowed_values", {"values": values}), df, column=column)[1]["failed_count"] == failed


def test_missing_sides_of_a_comparison(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (None, None), (9, 5)], "low int, high int")
    rule = {"left_column": "low", "operator": "<", "right_column": "high"}
    assert evaluate_rule(definition("column_comparison", rule), df)[1] | {"sample_failures": 0} == {"failed_count": 1, "comparable_count": 2, "sample_failures": 0}
    assert evaluate_rule(definition("column_comparison", rule | {"null_behavior": "fail"}), df)[1]["failed_count"] == 3


def test_few_numbers_leave_text_to_be_compared_as_text(spark):
    df = spark.createDataFrame([("10", "9"), ("100", "20"), ("x", "y")], "a string, b string")
    assert evaluate_rule(definition("column_comparison", {"left_column": "a", "operator": "<", "right_column": "b"}), df)[1]["failed_count"] == 0


def test_unknown_parts_of_an_equality(spark):
    df = spark.createDataFrame([("k", None, "j"), ("k", None, "k"), ("", "", "j"), ("k", "k", "k ")], "x string, y string, z string")
    for ignore, failed in ((True, 1), (False, 2)):
        assert evaluate_rule(definition("columns_equal", {"columns": ["x", "y", "z"], "ignore_nulls": ignore}), df)[1]["failed_count"] == failed


def test_keys_that_are_null_repeat_each_other(spark):
    df = spark.createDataFrame([(None,), ("one",), (None,), (None,)], "k string")
    assert evaluate_rule(definition("primary_key_unique", {"column": "k"}), df)[1]["failed_count"] == 3


FAULTS = [
    ({"type": "columns_equal", "parameters": {"columns": ["only"]}}, None, ["two or more"]),
    ({"type": "columns_equal", "parameters": {"columns": ["one", " "]}}, None, ["two or more"]),
    ({"type": "column_comparison", "parameters": {"operator": "like", "left_column": 1, "extra": 0}}, None, ["not allowed", "'left_column'", "'right_column'", "no 'extra'"]),
    ({"type": "column_comparison", "parameters": {"operator": "<", "left_column": "a", "right_column": "b", "null_behavior": "skip"}}, None, ["ignore, fail"]),
    ({"type": "percentage_range", "parameters": {"min": 5, "max": 4.5}}, None, ["Range min"]),
    ({"type": "minimum_row_count", "parameters": {"minimum_rows": True}}, None, ["whole number"]),
    ({"type": "min_length", "parameters": {"min_length": -1}}, None, ["zero at least"]),
    ({"type": "min_length"}, None, ["missing required parameter"]),
    ({"type": "reference_combination", "parameters": {"reference_dataset": "t", "column_mapping": {}}}, None, ["a map"]),
    ({"type": "not_null"}, "DATASET", ["COLUMN", "DATASET"]),
    ({"type": "not_null", "parameters": [1]}, None, ["an object"]),
    ({"type": "unheard_of"}, None, ["Unsupported rule type"]),
    ({}, None, ["Unsupported rule type"]),
    (["not_null"], None, ["an object"]),
]


@pytest.mark.parametrize(("rule", "scope", "parts"), FAULTS)
def test_faults_of_a_rule_are_named(rule, scope, parts):
    ok, reason, cleaned = registry.validate_executable_rule(rule, scope)
    assert not ok and cleaned is None and all(p in reason for p in parts), reason


def test_older_shapes_of_rules():
    old = {"type": "date_format", "format_string": "%d.%m.%y"}
    assert registry.validate_executable_rule(old) == (True, None, {"type": "date_format", "parameters": {"format": "%d.%m.%y"}})
    assert registry.validate_executable_rule({"type": "pattern", "parameters": {"pattern": "z"}})[2]["type"] == "regex"
    assert registry.validate_rule_for_approval(json.dumps({"by": "me", **definition("not_null", None)}), "COLUMN")[2] == {"by": "me", **definition("not_null", {})}
    assert not registry.validate_rule_for_approval("3", "COLUMN")[0] and not registry.validate_rule_for_approval("{", "COLUMN")[0]


def test_what_proposers_are_told():
    assert len(registry.get_rule_types()) == 20 == sum(len(registry.get_rule_types(s)) for s in ("COLUMN", "ROW", "DATASET"))
    told = registry.rule_catalog("ROW")
    assert "columns_equal" in told and "city_state_zip_reference" not in told and "ignore/fail" in told


def jobs_of(spark, work):
    """How many jobs ``work`` starts, and what it gives."""
    tracker = spark.sparkContext.statusTracker()
    group = "counted"
    spark.sparkContext.setJobGroup(group, "")
    before = len(tracker.getJobIdsForGroup(group))
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group)) - before, out


def test_failing_rules_share_their_jobs(spark, tmp_path):
    """As many jobs for forty failing rules as for four, and the written failures are the counted ones."""
    df = spark.range(500).selectExpr("cast(id as string) as k", *[f"case when id % {n} = 0 then null else 'v' end as c{n}" for n in range(2, 42)])
    rules = [Rule(n, definition("not_null", {}), f"c{n}") for n in range(2, 42)]
    store = Store(spark, str(tmp_path))
    few, _ = jobs_of(spark, lambda: evaluate_recorded(store, df, rules[:4], "k", dataset="d"))
    store = Store(spark, str(tmp_path / "more"))
    many, found = jobs_of(spark, lambda: evaluate_recorded(store, df, rules, "k", dataset="d"))
    assert many == few
    want = {n: -(-500 // n) for n in range(2, 42)}
    assert {r.rule_id: r.failed_count for r in found.results.collect()} == want
    assert {r.rule_id: r["count"] for r in store.read("dq_failed_record").groupBy("rule_id").count().collect()} == want
    assert store.read("dq_failed_record").select("failed_record_id").distinct().count() == sum(want.values())
    for r in store.read("dq_result").collect():
        shown = json.loads(r.details)["sample_failures"]
        assert len(shown) == 10 and all(int(x["k"]) % r.rule_id == 0 and x[f"c{r.rule_id}"] is None for x in shown)


def test_a_rule_whose_data_stop_the_job_is_found_by_halves(spark):
    df = spark.createDataFrame([("1", "x"), ("2", None)], "k string, v string")
    rules = [Rule(n, definition("not_null", {}), "v") for n in range(200)]
    real = evaluation.plan_rule

    def planned(df, rule, column, *rest):
        plan = real(df, rule, column, *rest)
        if column == "v" and rule["parameters"].get("bad"):
            plan.fails = F.raise_error(F.lit("the data are bad")).cast("boolean")
        return plan

    with pytest.MonkeyPatch.context() as m:
        m.setattr(evaluation, "_prepared", lambda r: {"type": "not_null", "parameters": {"bad": r.rule_id in (77,)}})
        m.setattr(evaluation, "plan_rule", planned)
        number, found = jobs_of(spark, lambda: evaluate(df, rules, "k", samples=False).results.collect())
    got = {r.rule_id: (r.status, r.failed_count) for r in found}
    assert got == {n: ("ERROR", 0) if n == 77 else ("FAIL", 1) for n in range(200)}
    assert number <= 2 * 8 + 4
    assert "the data are bad" in next(r.details for r in found if r.rule_id == 77)


@pytest.mark.parametrize("most", [1, 2_000_000])
def test_references_with_many_keys(spark, monkeypatch, most):
    """Beyond the bound, distinct keys are looked up, and rows stay where they are."""
    monkeypatch.setattr(evaluation, "MOST_KEYS", most)
    df = spark.range(400).selectExpr("cast(id as string) as k", "case when id % 50 = 0 then null else cast(id % 7 as string) end as v")
    tables = {"t": (spark.createDataFrame([(str(i),) for i in (0, 1, 2, 4, 5, 6)], "x string"), ("x",))}
    found = evaluate(df, [Rule(1, definition("reference_value", {"reference_dataset": "t", "reference_column": "x"}), "v"), Rule(2, definition("minimum_row_count", {"minimum_rows": 401}))], "k", tables)
    want = {str(i) for i in range(400) if i % 7 == 3 and i % 50}
    assert {r.source_row_identifier for r in found.failures.collect()} == want
    assert {r.rule_id: r.failed_count for r in found.results.collect()} == {1: len(want), 2: 1}
    plan = found.failures._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [v" not in plan


def test_no_rows_and_no_rules(spark, parcels):
    tables = {"t": (spark.createDataFrame([("a",)], "x string"), ("x",))}
    rules = [Rule(1, definition("not_null", {}), "note"), Rule(2, definition("primary_key_unique", {"column": "parcel"})), Rule(3, definition("reference_value", {"reference_dataset": "t", "reference_column": "x"}), "note"), Rule(4, definition("minimum_row_count", {"minimum_rows": 1}))]
    assert {r.rule_id: r.failed_count for r in evaluate(parcels.limit(0), rules, "parcel", tables).results.collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert evaluate(parcels, [], "parcel").results.count() == 0
    assert {r.rule_id: r.status for r in evaluate(parcels, rules[3:], "parcel").results.collect()} == {4: "PASS"}


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_repeated_keys_are_found_among_few_rows(spark, monkeypatch, most):
    """Rows with a key of their own aren't shuffled, however many tasks have them."""
    monkeypatch.setattr(rules, "LEAST_ROWS", 0)
    monkeypatch.setattr(rules, "MOST_SHARED", most)
    monkeypatch.setattr(duplicates, "RANGE_ROWS", 100)
    df = spark.range(5000).repartition(7).selectExpr("id", "case when id % 100 = 7 then null when id % 50 = 3 then 'twice' || (id div 100) else 'k' || id end as a", "case when id % 100 = 7 then 1 else id % 2 end as b")
    rows = df.collect()
    times = collections.Counter((r.a, r.b) for r in rows)
    want = {str(r.id) for r in rows if times[r.a, r.b] > 1}
    found = evaluate(df, [Rule(1, definition("column_combination_unique", {"columns": ["a", "b"]}))], "id", samples=False)
    assert {r.source_row_identifier for r in found.failures.collect()} == want and found.results.first().failed_count == len(want) > 100
    if most > 3:
        near = duplicates.possible(df, [F.col("a"), F.col("b")], 0, most).count()
        assert len(want) <= near < len(want) + 5000 / 16


def test_marks_of_places():
    for places in ([], [0], [5, 6, 300, 70_000, 2**33, 2**33 + 1]):
        assert duplicates._unpacked(duplicates._packed(np.array(places, np.uint64))).tolist() == places


def test_keys_of_no_rows(spark):
    df = spark.createDataFrame([], "k string")
    assert duplicates.possible(df, [F.col("k")], 0, 10).count() == 0
    assert evaluate_rule(definition("primary_key_unique", {"column": "k"}), df)[0] == "PASS"


def test_a_task_holds_few_marks(spark):
    """What a task keeps in Python doesn't follow its rows: three million take less than 48 MB."""

    class Seen:
        def __getattr__(self, name):
            return lambda *args: self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    seen = Seen()
    duplicates.shared_places(seen, [F.lit(1)], 28)
    rng = np.random.default_rng(1)
    batches = (pa.RecordBatch.from_arrays([pa.array(rng.integers(0, 1 << 28, 100_000))], ["place"]) for _ in range(30))
    tracemalloc.start()
    try:
        rows = sum(batch.num_rows for batch in seen.run(batches))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows and peak < 48e6
