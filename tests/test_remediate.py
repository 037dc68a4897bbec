import random

import pytest
from pyspark.sql import functions as F

from veridat.functions.names import DataQualityError
from veridat.operators import control, remediate, report
from veridat.operators.evaluate import Rule, evaluate
from veridat.operators.control import evaluate_recorded, results_of
from veridat.sources.load import Store

CITY = {"type": "city_contains_state_or_zip", "parameters": {}}


def suggestion(spark, row, kind, column=None):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    s = df.select(remediate.location_suggestion(df.columns, kind, column).alias("s")).first().s
    return s and dict(s.suggested_values)


@pytest.mark.parametrize(
    ("row", "kind", "want"),
    [
        ({"city": "Miami, FL", "state": " "}, "city_contains_state_or_zip", {"city": "Miami", "state": "FL"}),
        ({"city": "Miami, FL", "state": "GA"}, "city_contains_state_or_zip", None),
        ({"city": "Miami, PR", "state": None}, "city_contains_state_or_zip", None),
        ({"city": "Albany 12207-1234", "state": "NY", "zip": ""}, "city_contains_state_or_zip", {"city": "Albany", "zip": "12207-1234"}),
        ({"state": "FL 33101", "zip": None}, "state_field_contains_zip", {"state": "FL", "zip": "33101"}),
        ({"state": "FL 33101", "zip": "1"}, "state_field_contains_zip", None),
        ({"state": "FL 33101", "zip": None}, "allowed_values", None),
        ({"town": "x"}, "city_contains_state_or_zip", None),
    ],
)
def test_suggestions(spark, row, kind, want):
    assert suggestion(spark, row, kind) == want


def test_generation_is_done_once(spark):
    df = spark.createDataFrame([("1", "Miami, FL", ""), ("2", "Albany 12207", "NY"), ("3", "Boston", "MA")], "id string, city string, state string")
    results, failed = results_of(evaluate(df, [Rule(1, {"executable_rule": CITY}, "city")], "id"), 10)
    known = spark.createDataFrame([], "failed_record_id long")
    made, counts = remediate.generate(df, failed, results, [(1, "city", CITY)], known, "id")
    assert tuple(counts.first()) == (2, 1, 1)
    assert made.first().suggested_values == {"city": "Miami", "state": "FL"}
    again, counts = remediate.generate(df, failed, results, [(1, "city", CITY)], failed, "id")
    assert again.count() == 0 and counts.first().failures == 0
    with pytest.raises(DataQualityError):
        remediate.generate(df, failed, results, [], known, None)


def test_changes_equal_a_sequential_model(spark):
    rng = random.Random(7)
    base = [(str(i), rng.choice("ab"), rng.choice(["x", None])) for i in range(8)]
    steps = [(n, 1, str(rng.randrange(9)), {c: rng.choice(["a", "b", None]) for c in rng.sample(["p", "q", "id", "nope"], 2)}) for n in range(40)]
    state, changes = {r[0]: {"p": r[1], "q": r[2]} for r in base}, []
    for n, rule, row, values in steps:
        for c, v in values.items():
            if row in state and c in ("p", "q") and state[row][c] != v:
                changes.append((n, rule, row, c, state[row][c], v))
                state[row][c] = v
    df = spark.createDataFrame(base, "id string, p string, q string")
    approved = spark.createDataFrame(steps, "remediation_id long, rule_id long, source_row_identifier string, suggested_values map<string,string>")
    found = remediate.field_changes(df, approved, "id")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, changes))
    assert {r.id: {"p": r.p, "q": r.q} for r in remediate.apply_changes(df, found, "id").collect()} == state


def test_versions_are_immutable(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("customers", spark.createDataFrame([("1", "Miami, FL", ""), ("2", "Boston", "MA")], "id string, city string, state string"))
    schema = "remediation_id long, rule_id long, source_row_identifier string, suggested_values map<string,string>"
    one = remediate.apply_version(store, "customers", spark.createDataFrame([(1, 1, "1", {"city": "Miami", "state": "FL"}), (2, 1, "2", {"city": "Boston"})], schema), "id")
    assert (one["version"], one["name"], [r[0] for r in one["applied"].collect()], one["changes"], one["rows"]) == (1, "customers__v1", [1], 2, 2)
    two = remediate.apply_version(store, "customers", spark.createDataFrame([(3, 1, "1", {"city": "Tampa"})], schema), "id")
    now = {r.id: r for r in store.read("customers__current").collect()}
    assert two["version"] == 2 and now["1"].city == "Tampa" and now["1"]._dataset_version_id == 2 and now["1"]._raw_source_row_identifier == "1"
    assert {r.id: r.city for r in store.read("customers__current", 1).collect()}["1"] == "Miami"
    assert {r.id: r.city for r in store.read("customers").collect()}["1"] == "Miami, FL"
    assert store.read("customers__history").count() == 3 and store.read("customers__lineage").count() == 2  # of rows that changed
    assert [sorted(map(tuple, remediate.lineage_of(store, "customers", "id", v).collect())) for v in (1, 2)] == [[(1, "1", "1", 1), (1, "2", "2", 0)], [(2, "1", "1", 2), (2, "2", "2", 0)]]
    store.write("twice", spark.createDataFrame([("1", "a"), ("1", "b")], "id string, v string"))
    with pytest.raises(DataQualityError):
        remediate.apply_version(store, "twice", spark.createDataFrame([], schema), "id")


def test_all_applied_remediations_are_listed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.range(10_050)
    store.write("many", rows.select(F.col("id").cast("string").alias("id"), F.lit("a").alias("v")))
    approved = rows.select(F.col("id").alias("remediation_id"), F.lit(1).cast("long").alias("rule_id"), F.col("id").cast("string").alias("source_row_identifier"), F.create_map(F.lit("v"), F.lit("b")).alias("suggested_values"))
    done = remediate.apply_version(store, "many", approved, "id")
    assert sorted(r[0] for r in done["applied"].collect()) == list(range(10_050)) and done["changes"] == 10_050


def test_health_states(spark):
    import datetime

    at = datetime.datetime(2026, 1, 1)
    rows = [(i, i, "ok", "PASS" if i < 19 else "FAIL", 0, at) for i in range(20)] + [(30 + i, 30 + i, "mid", "PASS" if i < 17 else "FAIL", 0, at) for i in range(20)]
    rows += [(60, 60, "err", "ERROR", 0, at), (61, 61, "bad", "FAIL", 1, at), (62, 61, "bad", "PASS", 0, at - datetime.timedelta(1))]
    results = spark.createDataFrame(rows, "result_id long, rule_id long, dataset_name string, status string, failed_count long, checked_at timestamp")
    sets = spark.createDataFrame([(n, n != "gone") for n in ("ok", "mid", "err", "bad", "new", "gone")], "dataset_name string, loaded boolean")
    assert {r.dataset_name: r.health for r in report.health(report.latest_results(results), sets).collect()} == {"ok": "Healthy", "mid": "Needs Attention", "err": "Evaluation Error", "bad": "At Risk", "new": "Not Yet Assessed", "gone": "Not Loaded"}


def test_last_loaded(spark):
    df = spark.sql("select timestamp'2026-01-10 15:00:00' t union all select timestamp'2026-01-09 04:30:00' union all select timestamp'2026-01-09 15:00:00' union all select null")
    now = F.lit("2026-01-10 18:00:00").cast("timestamp")
    assert [r[0] for r in df.select(report.last_loaded(F.col("t"), now)).collect()] == ["Today 10:00 AM", "Jan 8, 2026 11:30 PM", "Yesterday 10:00 AM", "Never"]


@pytest.mark.parametrize("breaks", ["customers__history", "customers__lineage", "customers__current"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_version_that_breaks_off_is_repeated(spark, tmp_path, monkeypatch, breaks, when):
    """Each of the three writes breaks, before or after its rows are there."""
    store = Store(spark, str(tmp_path))
    store.write("customers", spark.createDataFrame([("1", "Miami, FL", ""), ("2", "Boston", "MA")], "id string, city string, state string"))
    schema = "remediation_id long, rule_id long, source_row_identifier string, suggested_values map<string,string>"
    remediate.apply_version(store, "customers", spark.createDataFrame([(9, 1, "2", {"state": "NY"})], schema), "id")
    approved = spark.createDataFrame([(1, 1, "1", {"city": "Miami", "state": "FL"})], schema)
    real, due = Store._publish, [True]

    def publish(self, table, number, manifest):
        if table == breaks and due:
            if when == "before":
                due.clear()
                raise OSError("the driver is gone")
            if table != "customers__current":  # once that is published the version is whole
                real(self, table, number, manifest)
            due.clear()
            raise OSError("the driver is gone")
        real(self, table, number, manifest)

    monkeypatch.setattr(Store, "_publish", publish)
    with pytest.raises(OSError, match="gone"):
        remediate.apply_version(store, "customers", approved, "id")
    assert store.version("customers__current") == 1 and store.read("customers__history").count() == 1 and store.read("customers__lineage").count() == 1
    done = remediate.apply_version(store, "customers", approved, "id")
    assert (done["version"], done["changes"], done["rows"]) == (2, 2, 2)
    history = sorted((r.dataset_version_id, r.remediation_id, r.column_name, r.old_value, r.new_value) for r in store.read("customers__history").collect())
    assert history == [(1, 9, "state", "MA", "NY"), (2, 1, "city", "Miami, FL", "Miami"), (2, 1, "state", "", "FL")]
    assert sorted(map(tuple, store.read("customers__lineage").collect())) == [(1, "2", "2"), (2, "1", "1")]


def test_results_and_failures_are_seen_together(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    df = spark.range(20).selectExpr("cast(id as string) as k", "case when id < 4 then null else 'v' end as v")
    rules = [Rule(1, {"executable_rule": {"type": "not_null"}}, "v")]
    evaluate_recorded(store, df, rules, "k")
    real, due = Store._publish, [True]
    monkeypatch.setattr(Store, "_publish", lambda self, table, *rest: due.pop() and (_ for _ in ()).throw(OSError("gone")) if table == "dq_result" and due else real(self, table, *rest))
    with pytest.raises(OSError, match="gone"):
        evaluate_recorded(store, df, rules, "k")
    assert store.read("dq_failed_record").count() == 4
    evaluate_recorded(store, df, rules, "k")
    assert store.read("dq_failed_record").count() == 8 and {r.result_id: r["count"] for r in store.read("dq_failed_record").groupBy("result_id").count().collect()} == {1: 4, 2: 4}


def test_logs_of_many_parts_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(control, "MOST_PARTS", 3)
    store = Store(spark, str(tmp_path))
    for n in range(6):
        control.log_rows(store, "log", spark.range(n, n + 1))
    assert len(store.parts("log")) <= 3 and sorted(r.id for r in store.read("log").collect()) == list(range(6))
