import pathlib

import pytest
from pyspark.sql import functions as F

from veridat.functions.names import DataQualityError
from veridat.operators import mine, profile, propose
from veridat.operators import control
from veridat.plans import stewardship
from veridat.sources import files, load

CSV = 'customer_id,city,state,zip,status\nC001,Boston,MA,02108,OPEN\nC002,"Miami, FL",,33101,OPEN\nC003,Albany 12207,NY,,CLOSED\nC004,"He said ""NA""",NA,00501,OPEN\n'


@pytest.fixture
def store(spark, tmp_path):
    return load.Store(spark, str(tmp_path / "store"))


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_is_text_and_empty_is_not_null(spark, csv):
    rows = {r.customer_id: r for r in files.read_csv(spark, csv).collect()}
    assert rows["C001"].zip == "02108" and rows["C002"].city == "Miami, FL" and rows["C002"].state == "" and rows["C003"].zip == ""
    assert rows["C004"].city == 'He said "NA"' and rows["C004"].state == "NA"


def test_fixed_width(spark, tmp_path):
    path = tmp_path / "f.txt"
    path.write_bytes("0001André     MA\r\n\r\n0002Bo\x00b\n".encode("latin-1"))
    columns = files.fixed_columns("column_name,start_position,field_length,sequence_number\nname,5,10,2\ncustomer_id,1,4,1\nstate,15,2,3\n")
    assert [tuple(r) for r in files.read_fixed_width(spark, str(path), columns).collect()] == [("0001", "André", "MA"), ("0002", "Bob", "")]
    (tmp_path / "empty.txt").write_text("\n \n")
    with pytest.raises(DataQualityError):
        files.read_fixed_width(spark, str(tmp_path / "empty.txt"), columns)
    for bad in ("a,b", "column_name,start_position,field_length,sequence_number\nx,0,1,1", "column_name,start_position,field_length,sequence_number\nx,1,1,1\nx,2,1,2"):
        with pytest.raises(DataQualityError):
            files.fixed_columns(bad)
    with pytest.raises(DataQualityError):
        files.read_source(spark, "json", "x")


def test_load_modes(spark, store, csv, tmp_path):
    data = load.Dataset("customers", source_file=csv, primary_key="customer_id")
    first = load.load(store, data, 1)
    assert (first.rows_inserted, first.rows_updated, store.version("customers")) == (4, 0, 1)
    more = tmp_path / "more.csv"
    more.write_text("customer_id,city,state,zip,status\nC001,Salem,OR,97301,OPEN\nC009,Boston,MA,02108,OPEN\n")
    second = load.load(store, data, 2, str(more))
    assert (second.mode, second.rows_inserted, second.rows_updated) == ("upsert", 1, 1)
    rows = {r.customer_id: r for r in store.read("customers").collect()}
    assert len(rows) == 5 and rows["C001"].city == "Salem" and rows["C001"]._load_run_id == 2 and rows["C002"]._load_run_id == 1
    assert store.read("customers", 1).count() == 4  # earlier versions stay
    load.load(store, data, 3, str(more), "append")
    assert store.read("customers").count() == 7
    load.load(store, data, 4, str(more), "replace")
    assert store.read("customers").count() == 2
    other = tmp_path / "other.csv"
    other.write_text("customer_id,town\nC1,x\n")
    with pytest.raises(DataQualityError, match="Columns differ"):
        load.load(store, data, 5, str(other), "append")
    repeated = tmp_path / "repeated.csv"
    repeated.write_text("customer_id,city,state,zip,status\nC1,a,b,c,d\nC1,a,b,c,d\n")
    with pytest.raises(DataQualityError, match="duplicate"):
        load.load(store, data, 6, str(repeated))
    with pytest.raises(DataQualityError, match="load mode"):
        load.load(store, data, 7, mode="merge")


def test_reference_tables(spark, store, tmp_path):
    path = tmp_path / "states.csv"
    path.write_text("state_code,state_name\nMA,Massachusetts\nFL,\n")
    assert load.load_reference(store, load.REFERENCES[0], str(path), source_version="v1") == 2
    table, keys = load.reference_tables(store)["us_states"]
    assert keys == ("state_code",) and table.where("state_name is null").count() == 1
    path.write_text("state_code,capital\nMA,Boston\n")
    with pytest.raises(DataQualityError, match="not registered"):
        load.load_reference(store, load.REFERENCES[0], str(path))


def test_profile(spark):
    df = spark.createDataFrame([("A", "10%", "2024", 1)] * 5 + [("Z", "25%", "1999", 2)] * 2 + [("M", "5.5%", "2001", 3), (None, None, None, None), (None, None, None, None)], "t string, p string, y string, n int")
    p = {x["column_name"]: x for x in profile.profile(df)}
    assert (p["t"]["row_count"], p["t"]["null_count"], p["t"]["distinct_count"], p["t"]["min_value"], p["t"]["max_value"], p["t"]["null_percent"]) == (10, 2, 3, "A", "Z", 20.0)
    assert [p[c]["inferred_type"] for c in ("t", "p", "y", "n")] == ["text", "percentage", "year", "integer"]
    assert p["t"]["sample_values"] == ["A", "Z", "M"]
    assert profile.infer_type("string", ["$10", "$2,000.50"]) == "currency" and profile.infer_type("string", []) == "unknown"
    empty = profile.profile(df.limit(0))
    assert [(x["row_count"], x["null_percent"], x["inferred_type"]) for x in empty][0] == (0, 0.0, "unknown")


def _pairs(spark):
    rows = []
    for i in range(60):
        done = i % 2 == 0
        rows.append(("CANCELLED" if done else "ACTIVE", "20240101" if done else None, f"L{i}" if i % 3 else None, f"N{i}", "email" if done else "none", "a@b.c" if done else None, "person", f"name{i}"))
    return spark.createDataFrame(rows, "cancellation_status string, cancellation_date string, license_id string, license_number string, contact_type string, contact_email string, owner_1_type string, owner_1_name string")


def test_miner_finds_relationships(spark):
    df = _pairs(spark)
    profiles = profile.profile(df)
    found = mine.discover(profiles)
    good, figures = mine.screen(df, found)
    families = {c.family: c for c in good}
    assert {"status_date_relationship", "identifier_relationship", "conditional_completeness", "repeated_structure_completeness"} <= set(families)
    assert all(c.evidence["support"] >= 0.95 and c.evidence["comparable_count"] >= mine.MIN_COMPARABLE for c in good)
    assert figures["discovered"] == len(found)
    rules, counts = mine.mine(df, profiles)
    assert counts["accepted"] == len(rules) > 0
    assert mine.mine(df, profiles, known=rules)[0] == []


def test_answers_must_repeat_the_evidence():
    c = mine.Candidate("status_date_relationship", "s", "d", 95, "conditional_required", {"support": 0.97, "condition_column": "s", "condition_operator": "==", "condition_value": "X", "required_column": "d"})
    answer = {"accepted": True, "confidence_score": 0.99, "executable_rule": {"type": "conditional_required", "parameters": {"condition_column": "s", "condition_operator": "==", "condition_value": "X", "required_column": "d"}}}
    ok, _, rule = mine.validate_response(answer, c, {})
    assert ok and rule["confidence_score"] == 0.97 and rule["model_confidence_score"] == 0.99
    answer["executable_rule"]["parameters"]["condition_value"] = "Y"
    assert not mine.validate_response(answer, c, {})[0]
    for bad in ({}, {"accepted": True, "confidence_score": "x"}, {"accepted": True, "confidence_score": 1.2}, {"accepted": True, "confidence_score": 0.5}, {"accepted": True, "confidence_score": 0.9}):
        assert not mine.validate_response(bad, c, {})[0]


def test_ordered_text_dates_need_leave():
    c = mine.Candidate("date_relationship", "end_date", "start_date", 100, "column_comparison", {"support": 1.0, "comparable_count": 40, "left_column": "start_date", "operator": "<=", "right_column": "end_date"})
    profiles = {x: {"inferred_type": "text"} for x in ("end_date", "start_date")}
    assert not mine.validate_response(mine.default_response(c), c, profiles)[0]
    assert mine.validate_response(mine.default_response(c), c, profiles, text_dates=True)[0]


def test_date_order_and_ties(spark):
    df = spark.createDataFrame([("01/01/2024", "2024-01-02")] * 30 + [("2024-01-01", None)], "start_date string, end_date string")
    assert tuple(mine.date_order(df, "start_date", "end_date").first()) == (30, 30, 0)
    swapped = mine.analyze(df, mine.Candidate("date_relationship", "end_date", "start_date", 100, "column_comparison"))
    assert (swapped["left_column"], swapped["operator"], swapped["right_column"]) == ("start_date", "<=", "end_date")


def test_proposals():
    assert [(s, c) for s, c, _ in propose.propose_references(["CUSTOMER_ID", "City", "state_code", "zip_code", "naics_code"])] == [("COLUMN", ["state_code"]), ("COLUMN", ["zip_code"]), ("COLUMN", ["naics_code"]), ("ROW", ["City", "state_code", "zip_code"])]
    assert len(propose.propose_dataset("id")) == 2 and len(propose.propose_dataset()) == 1
    p = {"column_name": "home_city", "distinct_count": 26, "inferred_type": "text"}
    asked = propose.propose_columns([p], lambda _: {"executable_rule": {"type": "allowed_values", "parameters": {"values": ["a"]}}})
    assert asked[0][2] == "guardrail_rejected" and asked[0][1]["executable_rule"]["type"] == "not_executable"
    assert propose.propose_columns([p], lambda _: {"executable_rule": {"type": "none"}}) == []
    assert "home_city" in propose.column_prompt(p)
    assert propose.new_rules([{"a": 1, "b": 2}], [{"b": 2, "a": 1}]) == []


def test_status_logs(spark):
    rules = spark.createDataFrame([(1, "d", "c", "llm_generated", "COLUMN", ["c"], '{"executable_rule": {"type": "pattern", "pattern": "a"}}', "llm", None), (2, "d", "c", "llm_generated", "COLUMN", ["c"], '{"executable_rule": {"type": "regex"}}', "llm", None)], control.RULES)
    log = spark.createDataFrame([], control.LOG)
    definition, entry = control.approve_rule(rules, log, 1, "ann", "fine")
    assert definition["executable_rule"] == {"type": "regex", "parameters": {"pattern": "a"}}
    log = log.unionByName(entry)
    log = log.unionByName(control.change_rule_status(log, 1, "retired", "bo"))
    assert [tuple(r) for r in log.orderBy("at").select("from_status", "to_status", "actor").collect()] == [(None, "approved", "ann"), ("approved", "retired", "bo")]
    assert control.approved_only(log).count() == 0
    with pytest.raises(DataQualityError, match="cannot be approved"):
        control.approve_rule(rules, log, 2, "ann")
    with pytest.raises(DataQualityError, match="actor"):
        control.change_rule_status(log, 1, "rejected", " ")
    with pytest.raises(DataQualityError, match="Unsupported"):
        control.change_remediation_status(log, 1, "done", "ann")


def test_whole_pipeline(spark, store, csv):
    data = load.Dataset("customers", source_file=csv, primary_key="customer_id")
    first = stewardship.run(store, data, file=csv)
    assert first.phases == [("load", "completed"), ("profile", "completed"), ("rules", "completed"), ("evaluate", "skipped"), ("remediate", "skipped")]
    assert len(first.new_rules) >= 5 and not store.exists("dq_result")  # proposals aren't evaluated
    city = control.save_rules(store, "customers", [("COLUMN", "city", {"executable_rule": {"type": "city_ends_with_state_or_zip"}})], "ann")
    for i in [*first.new_rules, *city]:
        control.decide_rule(store, i, "approved", "ann", "fine")
    control.decide_rule(store, first.new_rules[0], "retired", "bo")
    second = stewardship.run(store, data, actor="ann")
    assert second.new_rules == [] and [s for _, s in second.phases] == ["skipped"] + ["completed"] * 4
    results = store.read("dq_result")
    assert results.count() == len(first.new_rules) and results.where(f"rule_id = {first.new_rules[0]}").isEmpty()
    # reference tables aren't loaded, so those rules are errors of their own
    assert results.where("status = 'ERROR'").count() == 3 and results.where("result_id is null").isEmpty()
    assert store.read("dq_rule").where(f"rule_id = {city[0]}").first().rule_type == "city_contains_state_or_zip"
    assert tuple(second.suggestions.first()) == (2, 2, 0)
    states = {(r.run_id, r.phase): r.status for r in control.run_states(store.read("control_run")).collect()}
    assert states[1, "run"] == states[2, "run"] == "completed" and states[1, "evaluate"] == "skipped"


def test_remediations_are_decided_and_applied(spark, store, csv):
    data = load.Dataset("customers", source_file=csv, primary_key="customer_id")
    load.load(store, data, 1)
    (rule,) = control.save_rules(store, "customers", [("COLUMN", "city", {"executable_rule": {"type": "city_contains_state_or_zip"}})], "ann")
    control.decide_rule(store, rule, "approved", "ann")
    stewardship.judge(store, data)
    assert tuple(stewardship.suggest(store, data).first()) == (2, 2, 0)
    assert tuple(stewardship.suggest(store, data).first()) == (0, 0, 0)  # what has a suggestion is known
    assert [r.status for r in control.remediations(store).collect()] == ["proposed"] * 2
    with pytest.raises(DataQualityError):
        control.decide_remediations(store, F.lit(True), "applied", "ann")
    with pytest.raises(DataQualityError):
        control.decide_remediations(store, F.lit(True), "approved", " ")
    control.decide_remediations(store, F.lit(True), "approved", "ann")
    made = stewardship.apply(store, data, "bo")
    assert (made["version"], made["changes"], made["rows"]) == (1, 4, 4)
    assert [(r.status) for r in control.remediations(store).collect()] == ["applied"] * 2
    control.decide_remediations(store, F.lit(True), "rejected", "ann")  # what is applied stays so
    assert [(r.from_status, r.to_status, r.actor) for r in store.read("dq_remediation_log").orderBy("entry").collect()] == [("proposed", "approved", "ann")] * 2 + [("approved", "applied", "bo")] * 2
    assert stewardship.apply(store, data, "bo")["changes"] == 0
    assert {r.city for r in store.read("customers__current").where("customer_id = 'C002'").collect()} == {"Miami"}
    assert [r.status for r in control.run_states(store.read("control_run")).where("kind = 'remediation'").collect()] == ["completed"] * 2


def test_failed_loads_and_runs_are_recorded(spark, store, tmp_path):
    data = load.Dataset("customers", source_file=str(tmp_path / "none.csv"), primary_key="id")
    with pytest.raises(Exception):  # noqa: B017
        control.load_recorded(store, data)
    with pytest.raises(Exception):  # noqa: B017
        stewardship.run(store, data, file=str(tmp_path / "none.csv"))
    assert [r.status for r in store.read("control_load_run").orderBy("load_run_id").collect()] == ["failed"] * 2
    states = {r.phase: r.status for r in control.run_states(store.read("control_run")).collect()}
    assert states == {"run": "failed", "load": "failed"}


def test_appends_write_their_own_rows_only(spark, store):
    rows = lambda a, b: spark.range(a, b).selectExpr("cast(id as int) as v", "cast(id as string) as k")
    store.write("t", rows(0, 5))
    store.append("t", rows(5, 7).select("k", "v"))
    store.append("t", rows(7, 8))
    assert sorted(r.v for r in store.read("t").collect()) == list(range(8)) and store.read("t", 2).count() == 7
    assert [p.rsplit("=", 1)[1] for p in store.parts("t")] == ["1", "2", "3"] and spark.read.parquet(store.path("t")).count() == 1
    with pytest.raises(DataQualityError):
        store.append("t", rows(1, 2).select("k"))
    store.compact("t")
    assert len(store.parts("t")) == 1 and store.read("t").count() == 8


def test_stream_of_files(spark, store, tmp_path):
    from veridat.streaming import incremental

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("id,v\n1,a\n2,b\n")
    for name, content in (("a", None), ("b", "id,v\n2,c\n3,d\n")):
        if content:
            (folder / f"{name}.csv").write_text(content)
        incremental.upsert_stream(store, incremental.watch(spark, str(folder), ["id", "v"]), "t", "id", str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r.id, r.v) for r in store.read("t").collect()) == [("1", "a"), ("2", "c"), ("3", "d")]


def bytes_of(folder):
    return sum(p.stat().st_size for p in pathlib.Path(folder).rglob("*.parquet"))


def test_an_upsert_writes_the_partitions_it_touches(spark, tmp_path):
    store = load.Store(spark, str(tmp_path / "store"), buckets=32)
    rows = lambda where: spark.range(20_000).selectExpr("cast(id as string) as k", "sha2(cast(id as string), 512) as v").where(where)
    assert store.upsert("t", rows("true"), "k").inserted == 20_000
    whole = bytes_of(store.path("t"))
    of = F.pmod(F.xxhash64("k"), F.lit(32 * load._PIECES)) % 32
    few = rows("true").where(of == 5).limit(200).withColumn("v", F.lit("new"))
    added = rows("true").withColumn("k", F.concat(F.lit("n"), "k")).where(of == 5).limit(3)
    done = store.upsert("t", few.unionByName(added), "k")
    assert (done.read, done.inserted, done.updated) == (203, 3, 200)
    assert 0 < bytes_of(done.path) < whole / 16
    assert len([p for p in store.parts("t") if p.startswith(done.path)]) == 1 and len(store.parts("t")) == 32
    found = store.read("t")
    assert found.count() == 20_003 and found.where("v = 'new'").count() == 200 and found.select("k").distinct().count() == 20_003
    assert store.read("t", 1).where("v = 'new'").isEmpty()
    store.append("t", rows("id < 10"))  # dealt likewise
    assert store.upsert("t", rows("id < 10").withColumn("v", F.lit("last")), "k").updated == 10
    assert store.read("t").where("v = 'last'").count() == 10 and store.read("t").count() == 20_003
    with pytest.raises(DataQualityError, match="duplicate"):
        store.upsert("t", rows("id < 2").unionByName(rows("id < 2")), "k")
    with pytest.raises(DataQualityError, match="blank"):
        store.upsert("t", rows("id < 2").withColumn("k", F.lit(" ")), "k")
    assert store.version("t") == 4 and store.upsert("t", rows("false"), "k").read == 0 and store.read("t").count() == 20_003
    store.compact("t")
    assert store.read("t").count() == 20_003 and store.manifest("t", store.version("t")).key == "k"


def test_a_table_that_was_not_dealt_by_key_becomes_so(spark, store):
    store.write("t", spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string"))
    done = store.upsert("t", spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string"), "k")
    assert (done.inserted, done.updated) == (1, 1)
    assert sorted(map(repr, map(tuple, store.read("t").collect()))) == sorted(map(repr, [(1, "a"), (2, "x"), (3, "y"), (None, "c")]))


def test_half_written_manifests_are_not_seen(spark, store):
    store.write("t", spark.range(3))
    published = pathlib.Path(store.folder("t")) / "published"
    (published / "_left-by-a-dead-writer").write_text("")
    (published / "2").write_text("")  # by a store that doesn't rename
    assert store.version("t") == 1 and store.read("t").count() == 3
    store.append("t", spark.range(2))
    assert store.version("t") == 3 and store.read("t").count() == 5


def test_two_writers_do_not_lose_rows(spark, store, monkeypatch):
    store.write("t", spark.range(3))
    other, real, first = load.Store(spark, store.root), load.Store._publish, [True]

    def late(self, table, number, manifest):
        if self is store and first.pop() if first else False:
            other.append("t", spark.range(10, 12))
        return real(self, table, number, manifest)

    monkeypatch.setattr(load.Store, "_publish", late)
    store.append("t", spark.range(20, 21))
    assert sorted(r.id for r in store.read("t").collect()) == [0, 1, 2, 10, 11, 20]
    first.append(True)
    with pytest.raises(load.Taken):  # what was made from the rows before can't go over theirs
        store.write("t", store.read("t").where("id > 1"))
    assert store.read("t").count() == 8


def test_a_version_waits_for_another(spark, store):
    store.write("a", spark.range(1))
    store.append("a", spark.range(1), after=load.Awaited("b", 1, "x"))
    assert store.read("a").count() == 1 and not store.exists("b")
    store.write("b", spark.range(1), token="y")
    assert store.read("a").count() == 1
    store.append("a", spark.range(5), after=load.Awaited("b", 2, "z"))
    store.append("b", spark.range(1), token="z")
    assert store.read("a").count() == 6 and store.version("a") == 3


def shuffled(spark, work):
    """Bytes that ``work`` writes to shuffles, by the status store."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = sc._jvm.java.util.ArrayList()
        found = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return [found.apply(i) for i in range(found.size())]

    known = {s.stageId() for s in stages()}
    out = work()
    return sum(s.shuffleWriteBytes() for s in stages() if s.stageId() not in known), out


def test_profiles_shuffle_no_values(spark):
    """As many bytes for long values as for short ones."""
    made = lambda size: spark.range(3000).repartition(3).select((F.col("id") % 900).alias("k"), F.expr(f"repeat(sha2(cast(id % 900 as string), 256), {size})").alias("v")).cache()
    short, long_ = made(1), made(200)
    short.count(), long_.count()
    few, a = shuffled(spark, lambda: profile.statistics(short).collect())
    many, b = shuffled(spark, lambda: profile.statistics(long_).collect())
    assert 0 < many < few * 1.2
    assert [(r.row_count, r.null_count, r.distinct_count) for r in a] == [(r.row_count, r.null_count, r.distinct_count) for r in b] == [(3000, 0, 900)] * 2
    assert len(b[1].min_value) == 64 * 200 and b[0].min_value == "0" and b[0].max_value == "99"


def test_digests_that_collide_are_told(spark, monkeypatch):
    real = profile.digest
    monkeypatch.setattr(profile, "digest", lambda v: (F.when(v.isNotNull(), F.length(v).cast("long")), F.when(v.isNotNull(), F.lit(1).cast("long")), real(v)[2]))
    df = spark.createDataFrame([("a",), ("a",), ("bb",), (None,)], "v string")
    assert profile.statistics(df).first().distinct_count == 2
    with pytest.raises(DataQualityError, match="same digest"):
        profile.statistics(df.unionByName(spark.createDataFrame([("b",)], "v string")))


def test_samples_of_sparse_columns(spark, monkeypatch):
    """The first hundred values that aren't null, wherever they are, in two jobs for any number of columns."""
    n = 3000
    every = {"dense": 1, "sparse": 7, "rare": 500, "never": 10**9}
    df = spark.range(n).coalesce(3).select(*[F.when((F.col("id") + 1) % k == 0, F.concat(F.lit(" v"), F.floor(F.col("id") / 5).cast("string"))).alias(c) for c, k in every.items()]).repartitionByRange(4, F.col("dense")).cache()
    rows = df.collect()
    want = {}
    for i, c in enumerate(every):
        first = [r[i] for r in rows if r[i] is not None][:100]
        want[c] = [v.strip() for v in list(dict.fromkeys(first))[:10]]
    assert profile.samples(df, list(every)) == want and want["never"] == []
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for columns in (["dense", "rare"], ["rare", "dense", "sparse", "never"] * 1):
        spark.sparkContext.setJobGroup(f"samples{len(columns)}", "")
        profile.samples(df, columns)
        jobs.append(len(tracker.getJobIdsForGroup(f"samples{len(columns)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    assert profile.samples(df, []) == {}


def test_candidates_share_two_jobs(spark):
    df = _pairs(spark)
    found = mine.discover(profile.profile(df))
    assert len(found) >= 5
    alone = [mine.evidence(df, [c])[0] for c in found]
    assert together_of(spark, df, found) == (together_of(spark, df, [found[0], found[-1]])[0], alone) and any(alone)


def together_of(spark, df, candidates):
    """The number of jobs for some candidates, and what comes of them."""
    group = f"evidence{len(candidates)}"
    spark.sparkContext.setJobGroup(group, "")
    out = mine.evidence(df, candidates)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out
