"""Queries over the sample tables, one for each operator, and the SQL they are held against.

Where the sample tables lack a kind of value (cities, blanks, dates as text), both sides
derive it from a key in the same way.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import date
from ..operators import control, duplicates, mine, profile, propose, registry, remediate, report
from ..operators.evaluate import Rule, evaluate, evaluate_rule, failing_rows, plan_rules, rule_counts
from ..operators.profile import statistics
from ..operators.rules import numeric_shares
from ..sources import files
from ..streaming import incremental
from ..sources.load import Dataset, REFERENCES, Store, check_schema, load, load_reference, upsert, upsert_counts, with_lineage

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rule(kind: str, **parameters) -> dict:
    return {"executable_rule": {"type": kind, "parameters": parameters}}


# ---------------------------------------------------------------- tables with flaws


def customers(spark, sf_dir) -> DataFrame:
    """customer with a blank or missing segment and a padded name now and then."""
    k = F.col("c_custkey")
    segment = F.when(k % 11 == 0, F.lit("  ")).when(k % 13 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 5 == 0, F.concat(F.lit("\t "), "c_name", F.lit(" "))).otherwise(F.col("c_name")).alias("c_name"), segment.alias("c_mktsegment"), "c_acctbal", "c_nationkey")


CUSTOMERS = """(SELECT c_custkey, c_name, CASE WHEN c_custkey % 11 = 0 THEN '  ' WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_acctbal, c_nationkey FROM customer)"""


def orders(spark, sf_dir) -> DataFrame:
    """orders with the day as text, in another format now and then, and some urgent orders
    without a priority."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 7 == 0, F.date_format(day, "MM/dd/yyyy")).when(k % 17 == 0, F.lit("2020-13-01")).when(k % 19 == 0, F.lit("")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", text.alias("o_orderdate"), F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


ORDERS = """(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN o_orderkey % 17 = 0 THEN '2020-13-01' WHEN o_orderkey % 19 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE o_orderpriority END AS o_orderpriority FROM orders)"""


def places(spark, sf_dir) -> DataFrame:
    """Customers with a city, state and ZIP code made from the key, some in the wrong field."""
    k = F.col("c_custkey")
    city = F.element_at(F.array(*[F.lit(x) for x in ("Boston", "Miami", "Albany", "Salem")]), (k % 4 + 1).cast("int"))
    state = F.element_at(F.array(*[F.lit(x) for x in ("MA", "FL", "NY", "OR")]), (k % 4 + 1).cast("int"))
    zip_ = F.element_at(F.array(*[F.lit(x) for x in ("02108", "33101", "12207", "97301")]), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"),
        F.when(k % 6 == 0, F.concat_ws(", ", city, state)).when(k % 9 == 0, F.concat_ws(" ", city, zip_)).otherwise(city).alias("city"),
        F.when(k % 6 == 0, "").when(k % 10 == 0, F.concat_ws(" ", state, zip_)).when(k % 25 == 0, "ZZ").otherwise(state).alias("state"),
        F.when((k % 9 == 0) | (k % 10 == 0), "").otherwise(zip_).alias("zip"),
    )


PLACES = """(SELECT CAST(k AS VARCHAR) AS id,
  CASE WHEN k % 6 = 0 THEN c || ', ' || s WHEN k % 9 = 0 THEN c || ' ' || z ELSE c END AS city,
  CASE WHEN k % 6 = 0 THEN '' WHEN k % 10 = 0 THEN s || ' ' || z WHEN k % 25 = 0 THEN 'ZZ' ELSE s END AS state,
  CASE WHEN k % 9 = 0 OR k % 10 = 0 THEN '' ELSE z END AS zip
 FROM (SELECT c_custkey AS k, list_extract(['Boston', 'Miami', 'Albany', 'Salem'], CAST(c_custkey % 4 + 1 AS BIGINT)) AS c,
   list_extract(['MA', 'FL', 'NY', 'OR'], CAST(c_custkey % 4 + 1 AS BIGINT)) AS s, list_extract(['02108', '33101', '12207', '97301'], CAST(c_custkey % 4 + 1 AS BIGINT)) AS z FROM customer))"""


def zip_codes(spark) -> dict:
    rows = [("02108", "Boston", "MA"), ("33101", "Miami", "FL"), ("12207", "ALBANY", "NY"), ("97301", "Salem", "OR")]
    return {"us_zip_codes": (spark.createDataFrame(rows, "zip_code string, place_name string, state_code string"), ("zip_code", "place_name", "state_code")), "us_states": (spark.createDataFrame([("MA",), ("FL",), ("NY",), ("OR",)], "state_code string"), ("state_code",))}


def shipments(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date"))
    return line.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date")), "l_orderkey")


SHIPMENTS = """(SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS ship_date, strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def failing(df: DataFrame, definition: dict, column: str | None = None, key: str | None = None, tables: dict | None = None) -> DataFrame:
    """Identifiers of the rows that one rule finds, as evaluation records them."""
    plans, broken = plan_rules(df, [Rule(1, definition, column)], tables or {})
    if broken:
        raise ValueError(str(broken))
    return failing_rows(df, plans, key).select("source_row_identifier")


def _ids(source: str, key: str, where: str) -> str:
    return f"SELECT CAST({key} AS VARCHAR) AS source_row_identifier FROM {source} AS t WHERE {where}"


# ---------------------------------------------------------------- rules


@query(_ids("documents", "doc_id", "lang IS NOT NULL AND lang NOT IN ('en', 'de', 'fr')"))
def rule_allowed_values(spark, sf_dir):
    return failing(table(spark, sf_dir, "documents"), rule("allowed_values", values=["en", "de", "fr"]), "lang", "doc_id")


@query(_ids(CUSTOMERS, "c_custkey", "c_mktsegment IS NULL OR trim(c_mktsegment) = ''"))
def rule_not_null(spark, sf_dir):
    return failing(customers(spark, sf_dir), rule("not_null"), "c_mktsegment", "c_custkey")


@query(_ids(CUSTOMERS, "c_custkey", "length(trim(c_mktsegment)) > 9"))
def rule_max_length(spark, sf_dir):
    return failing(customers(spark, sf_dir), rule("max_length", max_length=9), "c_mktsegment", "c_custkey")


@query(_ids(CUSTOMERS, "c_custkey", "trim(c_mktsegment) <> '' AND length(trim(c_mktsegment)) < 9"))
def rule_min_length(spark, sf_dir):
    return failing(customers(spark, sf_dir), rule("min_length", min_length=9), "c_mktsegment", "c_custkey")


@query(_ids("customer", "c_custkey", "NOT regexp_full_match(c_name, 'Customer#0+[0-9]*[02468]')"))
def rule_regex(spark, sf_dir):
    return failing(customers(spark, sf_dir), rule("regex", pattern="Customer#0+[0-9]*[02468]"), "c_name", "c_custkey")


@query(_ids("customer", "c_custkey", "c_acctbal < 0 OR c_acctbal > 5000"))
def rule_numeric_range(spark, sf_dir):
    return failing(customers(spark, sf_dir), rule("numeric_range", min=0, max=5000), "c_acctbal", "c_custkey")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS source_row_identifier FROM (SELECT l_orderkey, CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) END AS pct FROM lineitem) WHERE TRY_CAST(pct AS DOUBLE) IS NULL OR TRY_CAST(pct AS DOUBLE) > 8")
def rule_percentage_range(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.round(F.col("l_discount") * 100).cast("int").cast("string")).alias("pct"))
    return failing(line, rule("percentage_range", min=0, max=8), "pct", "l_orderkey")


@query(_ids(ORDERS, "o_orderkey", "o_orderdate <> '' AND (NOT regexp_full_match(o_orderdate, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') OR try_strptime(o_orderdate, '%Y-%m-%d') IS NULL)"))
def rule_date_format(spark, sf_dir):
    return failing(orders(spark, sf_dir), rule("date_format", format="YYYY-MM-DD"), "o_orderdate", "o_orderkey")


@query(_ids(PLACES, "id", r"regexp_matches(city, '\b\d{5}(-\d{4})?\b') OR regexp_matches(trim(city), '(,\s*|\s+)[A-Z]{2}\s*$')"))
def rule_city_contains_state_or_zip(spark, sf_dir):
    return failing(places(spark, sf_dir), rule("city_ends_with_state_or_zip"), "city", "id")


@query(_ids(PLACES, "id", r"regexp_matches(state, '\d{5}(-\d{4})?')"))
def rule_state_field_contains_zip(spark, sf_dir):
    return failing(places(spark, sf_dir), rule("state_field_contains_zip"), "state", "id")


@query(_ids(PLACES, "id", "trim(state) <> '' AND lower(trim(state)) NOT IN ('ma', 'fl', 'ny', 'or')"))
def rule_reference_value(spark, sf_dir):
    return failing(places(spark, sf_dir), rule("reference_value", reference_dataset="us_states", reference_column="state_code"), "state", "id", zip_codes(spark))


@query(_ids(SHIPMENTS, "l_orderkey", "ship_date < order_date"))
def rule_column_comparison(spark, sf_dir):
    return failing(shipments(spark, sf_dir), rule("column_comparison", left_column="order_date", operator="<=", right_column="ship_date"), None, "l_orderkey")


@query(_ids(ORDERS, "o_orderkey", "o_orderstatus = 'F' AND trim(o_orderpriority) = ''"))
def rule_conditional_required(spark, sf_dir):
    return failing(orders(spark, sf_dir), rule("conditional_required", condition_column="o_orderstatus", condition_operator="==", condition_value="F", required_column="o_orderpriority"), None, "o_orderkey")


@query(_ids(ORDERS, "o_orderkey", "o_orderdate = '' AND o_orderpriority = ''"))
def rule_at_least_one_present(spark, sf_dir):
    return failing(orders(spark, sf_dir), rule("at_least_one_present", columns=["o_orderdate", "o_orderpriority"]), None, "o_orderkey")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS source_row_identifier FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL AND l_returnflag <> l_linestatus")
def rule_columns_equal(spark, sf_dir):
    return failing(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), rule("columns_equal", columns=["l_returnflag", "l_linestatus"]), None, "l_orderkey")


_TRIPLES = "('boston', 'ma', '02108'), ('miami', 'fl', '33101'), ('albany', 'ny', '12207'), ('salem', 'or', '97301')"


@query(_ids(PLACES, "id", "trim(city) <> '' AND trim(state) <> '' AND (lower(city), lower(state)) NOT IN (SELECT (a, b) FROM (VALUES ('boston', 'ma'), ('miami', 'fl'), ('albany', 'ny'), ('salem', 'or')) v(a, b))"))
def rule_reference_combination(spark, sf_dir):
    return failing(places(spark, sf_dir), rule("reference_combination", reference_dataset="us_zip_codes", column_mapping={"city": "place_name", "state": "state_code"}), None, "id", zip_codes(spark))


@query(_ids(PLACES, "id", f"trim(city) <> '' AND trim(state) <> '' AND trim(zip) <> '' AND (lower(city), lower(state), lower(zip)) NOT IN (SELECT (a, b, c) FROM (VALUES {_TRIPLES}) v(a, b, c))"))
def rule_city_state_zip_reference(spark, sf_dir):
    return failing(places(spark, sf_dir), rule("city_state_zip_reference", city_column="city", state_column="state", zip_column="zip"), None, "id", zip_codes(spark))


@query("SELECT CAST(1 AS BIGINT) AS rule_id, CAST(CASE WHEN count(*) < 1000000000 THEN 1 ELSE 0 END AS BIGINT) AS failed_count FROM lineitem UNION ALL SELECT 2, 0")
def rule_minimum_row_count(spark, sf_dir):
    return rule_counts(table(spark, sf_dir, "lineitem"), [Rule(1, rule("minimum_row_count", minimum_rows=1_000_000_000)), Rule(2, rule("minimum_row_count", minimum_rows=1))])


@query(_ids("orders", "o_orderkey", "o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)"))
def rule_primary_key_unique(spark, sf_dir):
    return failing(table(spark, sf_dir, "orders"), rule("primary_key_unique", column="o_custkey"), None, "o_orderkey")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS source_row_identifier FROM lineitem JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) USING (l_orderkey, l_linenumber)")
def rule_column_combination_unique(spark, sf_dir):
    return failing(table(spark, sf_dir, "lineitem"), rule("column_combination_unique", columns=["l_orderkey", "l_linenumber"]), None, "l_orderkey")


@query(f"SELECT CAST(o_custkey AS BIGINT) AS o_custkey, count(*) AS times FROM orders GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT -CAST(c_custkey AS BIGINT) - 1, 2 FROM customer WHERE c_custkey % 50 = 0")
def repeated_keys_by_marks(spark, sf_dir):
    """Repeated keys among the rows only whose compact marks are shared: customers of many orders,
    and customers of whom some stand twice."""
    own = table(spark, sf_dir, "customer").select((-F.col("c_custkey").cast("long") - 1).alias("o_custkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("o_custkey")).unionByName(own).unionByName(own.where("o_custkey % 50 = -1"))
    return duplicates.possible(rows, [F.col("o_custkey")], 0, 2_000_000).groupBy("o_custkey").agg(F.count("*").alias("times")).where("times > 1")


# ---------------------------------------------------------------- all at once

FUSED = [
    Rule(1, rule("numeric_range", min=1, max=40), "l_quantity"),
    Rule(2, rule("numeric_range", min=0, max=0.06), "l_tax"),
    Rule(3, rule("allowed_values", values=["A", "R"]), "l_returnflag"),
    Rule(4, rule("not_null"), "l_linestatus"),
    Rule(5, rule("max_length", max_length=1), "l_returnflag"),
    Rule(6, rule("regex", pattern="[FO]"), "l_linestatus"),
    Rule(7, rule("column_comparison", left_column="l_tax", operator="<=", right_column="l_discount")),
    Rule(8, rule("conditional_required", condition_column="l_returnflag", condition_operator="==", condition_value="A", required_column="l_linestatus")),
    Rule(9, rule("at_least_one_present", columns=["l_returnflag", "l_linestatus"])),
    Rule(10, rule("columns_equal", columns=["l_returnflag", "l_linestatus"])),
    Rule(11, rule("minimum_row_count", minimum_rows=1)),
    Rule(12, rule("column_combination_unique", columns=["l_orderkey", "l_linenumber"])),
]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_counts(table(spark, sf_dir, "lineitem"), FUSED)


@query("""
SELECT CAST(rule_id AS BIGINT) AS rule_id, CAST(failed_count AS BIGINT) AS failed_count FROM (
  SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]) AS rule_id, unnest([
    count(*) FILTER (l_quantity < 1 OR l_quantity > 40), count(*) FILTER (l_tax < 0 OR l_tax > 0.06), count(*) FILTER (l_returnflag NOT IN ('A', 'R')),
    count(*) FILTER (l_linestatus IS NULL), count(*) FILTER (length(l_returnflag) > 1), count(*) FILTER (l_linestatus NOT IN ('F', 'O')), count(*) FILTER (l_tax > l_discount),
    0, 0, count(*) FILTER (l_returnflag <> l_linestatus), 0]) AS failed_count FROM lineitem
  UNION ALL SELECT 12, (SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE c > 1))
""")
def evaluate_fused(spark, sf_dir):
    return flagship(spark, sf_dir)


def _large(spark, sf_dir) -> DataFrame:
    """Whole numbers that a double can't tell apart, as text and as numbers."""
    k = F.col("o_orderkey").cast("long")
    base = F.lit(2**53).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", (base + k).cast("string").alias("left_number"), (base + k - k % 2).alias("right_number"))


@query(_ids("orders", "o_orderkey", "o_orderkey % 2 = 1"))
def rule_large_integers(spark, sf_dir):
    return failing(_large(spark, sf_dir), rule("column_comparison", left_column="left_number", operator="==", right_column="right_number"), None, "o_orderkey")


@query(_ids("orders", "o_orderkey", "o_orderkey > 1001"))
def rule_large_range(spark, sf_dir):
    return failing(_large(spark, sf_dir), rule("numeric_range", min=0, max=2**53 + 1001), "left_number", "o_orderkey")


@query(_ids("customer", "c_custkey", "NOT regexp_full_match(c_name, 'Customer#[0-9]*([0-9])[0-9]*[13579]')"))
def rule_regex_named_groups(spark, sf_dir):
    return failing(table(spark, sf_dir, "customer"), rule("regex", pattern=r"(?P<who>[C]ustomer)#\d*(?P<last_but>\d)\d*[13579]\Z"), "c_name", "c_custkey")


@query(f"SELECT o_orderkey, CAST(CASE WHEN contains(o_orderdate, '/') THEN try_strptime(o_orderdate, '%m/%d/%Y') ELSE try_strptime(o_orderdate, '%Y-%m-%d') END AS DATE) AS day FROM {ORDERS}")
def date_parse(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", date(F.col("o_orderdate")).alias("day"))


@query("SELECT 'pct' AS column_name, count(TRY_CAST(pct AS DOUBLE)) / count(pct) AS share FROM (SELECT CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(l_partkey AS VARCHAR) END AS pct FROM lineitem)")
def numeric_share(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_partkey").cast("string")).alias("pct"))
    return spark.createDataFrame(list(numeric_shares(line, ["pct"]).items()), "column_name string, share double")


@query("SELECT *, CASE WHEN failed_count > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (EVALUATED)")
def evaluation_recorded(spark, sf_dir):
    """Results as they are stored, of two evaluations of which the second is asked for."""
    store = Store(spark, files.scratch(spark, "store"))
    for _ in range(2):
        control.evaluate_recorded(store, table(spark, sf_dir, "lineitem"), FUSED, dataset="lineitem", samples=False)
    return store.read("dq_result").where(F.col("result_id") > len(FUSED)).select("rule_id", "failed_count", "status")


_sql["evaluation_recorded"] = _sql["evaluation_recorded"].replace("EVALUATED", _sql["evaluate_fused"])


# ---------------------------------------------------------------- profiles


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    one = "SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) - count({e}) AS BIGINT) AS null_count, CAST(count(DISTINCT {e}) AS BIGINT) AS distinct_count, min({e}) AS min_value, max({e}) AS max_value FROM {t}"
    return " UNION ALL ".join(one.format(c=c, e=e, t=name) for c, e in columns.items())


def _text(*names: str) -> dict[str, str]:
    return {n: f"CAST({n} AS VARCHAR)" for n in names}


_LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@query(_profile_sql(CUSTOMERS.replace("c_name,", "CASE WHEN c_custkey % 5 = 0 THEN chr(9) || ' ' || c_name || ' ' ELSE c_name END AS c_name,", 1) + " AS t", _text("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")))
def profile_customer(spark, sf_dir):
    return statistics(customers(spark, sf_dir))


@query(_profile_sql("lineitem", _text(*_LINEITEM)))
def profile_lineitem(spark, sf_dir):
    return statistics(table(spark, sf_dir, "lineitem"))


@query(_profile_sql("documents", _text("doc_id", "text", "lang", "source", "n_chars")))
def profile_documents(spark, sf_dir):
    return statistics(table(spark, sf_dir, "documents"))


_KINDS = {"c_custkey": "integer", "c_name": "text", "c_mktsegment": "text", "c_acctbal": "numeric", "c_nationkey": "integer"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{kind}' AS inferred_type, round(100 * (count(*) - count({c})) / count(*), 6) AS null_percent FROM {CUSTOMERS} AS t" for c, kind in _KINDS.items()))
def profile_types(spark, sf_dir):
    found = profile.profile(customers(spark, sf_dir))  # a row for each column
    return spark.createDataFrame([(p["column_name"], p["inferred_type"], round(p["null_percent"], 6)) for p in found], "column_name string, inferred_type string, null_percent double")


_FIRST = "(SELECT {c} AS v, c_custkey FROM {t} AS t WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 100)"
_KEPT = "SELECT '{c}' AS column_name, trim(CAST(v AS VARCHAR), ' ' || chr(9)) AS sample FROM {first} GROUP BY v ORDER BY min(c_custkey) LIMIT 10"
_SAMPLED = (("c_mktsegment", CUSTOMERS), ("c_nationkey", CUSTOMERS), ("flag", f"(SELECT CASE WHEN c_custkey % 40 = 7 THEN 'seg ' || c_mktsegment END AS flag, c_custkey FROM {CUSTOMERS})"))


@query(" UNION ALL ".join(f"SELECT * FROM ({_KEPT.format(c=c, first=_FIRST.format(c=c, t=t))})" for c, t in _SAMPLED))
def profile_samples(spark, sf_dir):
    """The values that a profile shows of each column, also of one that is mostly null."""
    df = customers(spark, sf_dir).orderBy("c_custkey").select("c_mktsegment", "c_nationkey", F.when(F.col("c_custkey") % 40 == 7, F.concat(F.lit("seg "), "c_mktsegment")).alias("flag"))
    rows = [(c, v) for c, values in profile.samples(df, df.columns).items() for v in values]
    return spark.createDataFrame(rows, "column_name string, sample string")


@query("SELECT 'nation' AS dataset_name, column_name, row_count, null_count, distinct_count FROM (" + _profile_sql("nation", _text("n_nationkey", "n_name", "n_regionkey")) + ")")
def profile_saved(spark, sf_dir):
    store = Store(spark, files.scratch(spark, "store"))
    for _ in range(2):  # the second takes the place of the first
        control.save_profiles(store, profile.profile(table(spark, sf_dir, "nation"), dataset="nation"))
    return store.read("control_profile").select("dataset_name", "column_name", "row_count", "null_count", "distinct_count")


# ---------------------------------------------------------------- relationships


@query(f"SELECT CAST(count(*) AS BIGINT) AS comparable, CAST(count(*) FILTER (order_date <= ship_date) AS BIGINT) AS left_first, CAST(count(*) FILTER (ship_date <= order_date) AS BIGINT) AS right_first FROM {SHIPMENTS}")
def mine_date_order(spark, sf_dir):
    return mine.date_order(shipments(spark, sf_dir), "order_date", "ship_date")


@query(f"SELECT o_orderstatus AS value, CAST(count(*) AS BIGINT) AS comparable, CAST(count(*) FILTER (trim(o_orderpriority) <> '') AS BIGINT) AS passed FROM {ORDERS} GROUP BY 1 HAVING count(*) >= 25 ORDER BY 2 DESC, 1 LIMIT 25")
def mine_conditional(spark, sf_dir):
    return mine.conditional(orders(spark, sf_dir), "o_orderstatus", "o_orderpriority")


@query(f"SELECT CAST(count(*) AS BIGINT) AS comparable, CAST(count(*) FILTER (o_orderdate <> '' OR o_orderpriority <> '') AS BIGINT) AS passed FROM {ORDERS}")
def mine_at_least_one(spark, sf_dir):
    return mine.at_least_one(orders(spark, sf_dir), "o_orderdate", "o_orderpriority")


@query("SELECT CAST(count(*) AS BIGINT) AS comparable, CAST(count(*) FILTER (l_returnflag = l_linestatus) AS BIGINT) AS passed FROM lineitem")
def mine_equal(spark, sf_dir):
    return mine.equality(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT CAST(doc_id AS VARCHAR) AS source_row_identifier FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ref_anti_join(spark, sf_dir):
    known = {"labelled": (table(spark, sf_dir, "labels").select("doc_id"), ("doc_id",))}
    return failing(table(spark, sf_dir, "documents"), rule("reference_value", reference_dataset="labelled", reference_column="doc_id"), "doc_id", "doc_id", known)


@query("SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS source_row_identifier FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def reference_by_distinct_keys(spark, sf_dir):
    """A reference whose keys are taken as too many to send: the distinct keys of the rows are
    looked up, and rows stay where they are."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    known = {"orders": (table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey"), ("o_orderkey",))}
    plans, _ = plan_rules(line, [Rule(1, rule("reference_value", reference_dataset="orders", reference_column="o_orderkey"), "l_orderkey")], known)
    plans[1].small = False
    return failing_rows(line, plans, "id").select("source_row_identifier")


def _contracts(spark, sf_dir) -> DataFrame:
    """Orders with names in which the miner sees relationships."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    closed = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(
        k.alias("contract_number"), F.when(k % 50 != 0, k.cast("string")).alias("contract_id"), F.date_format(day, "yyyy-MM-dd").alias("contract_start_date"), F.date_format(F.date_add(day, F.pmod(k, F.lit(7)).cast("int")), "yyyyMMdd").alias("contract_end_date"),
        F.when(closed, "CLOSED").otherwise("OPEN").alias("delivery_status"), F.when(closed, F.date_format(day, "MM/dd/yyyy")).alias("delivery_date"),
    )


_CONTRACTS = """(SELECT o_orderkey AS k, o_orderdate AS d, o_orderstatus = 'F' AS closed FROM orders ORDER BY o_orderkey LIMIT 10000)"""


@query(f"""
SELECT 'date_relationship' AS family, 'contract_end_date' AS left_column, 'contract_start_date' AS right_column, 1.0::DOUBLE AS support, CAST(count(*) AS BIGINT) AS comparable FROM {_CONTRACTS}
UNION ALL SELECT 'date_relationship', unnest(['contract_end_date', 'contract_start_date']), 'delivery_date', 1.0, CAST(count(*) FILTER (closed) AS BIGINT) FROM {_CONTRACTS}
UNION ALL SELECT 'status_date_relationship', 'delivery_status', 'delivery_date', 1.0, CAST(count(*) FILTER (closed) AS BIGINT) FROM {_CONTRACTS}
UNION ALL SELECT 'conditional_completeness', 'delivery_status', 'delivery_date', 1.0, CAST(count(*) FILTER (closed) AS BIGINT) FROM {_CONTRACTS}
UNION ALL SELECT 'identifier_relationship', 'contract_number', 'contract_id', 1.0, CAST(count(*) AS BIGINT) FROM {_CONTRACTS}
""")
def mine_screened(spark, sf_dir):
    """Candidates from names and profiles that a bounded sample supports."""
    df = _contracts(spark, sf_dir)
    profiles = profile.profile(df)
    sample = mine.bounded_sample(df, df.columns, ["contract_number"])
    good, _ = mine.screen(sample, mine.discover(profiles))
    return spark.createDataFrame([(c.family, c.left, c.right, float(c.evidence["support"]), c.evidence["comparable_count"]) for c in good], "family string, left_column string, right_column string, support double, comparable long")


@query("""
SELECT 'column_comparison' AS rule_type, 'contract_start_date,delivery_date' AS columns UNION ALL SELECT 'conditional_required', 'delivery_status,delivery_date' UNION ALL SELECT 'at_least_one_present', 'contract_number,contract_id'
""")
def mine_rules(spark, sf_dir):
    """What becomes of them: one rule where two families find the same, and none over columns
    that their samples show as of different types (days of eight digits look like numbers)."""
    df = _contracts(spark, sf_dir)
    profiles = profile.profile(df)
    found, _ = mine.mine(mine.bounded_sample(df, df.columns, ["contract_number"]), profiles, text_dates=True)
    return spark.createDataFrame([(d["executable_rule"]["type"], ",".join(d["target_columns"])) for d in found], "rule_type string, columns string")


# ---------------------------------------------------------------- files


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 5 = 0 THEN chr(9) || ' ' || c_name || ' ' ELSE c_name END AS c_name, coalesce(c_mktsegment, '') AS c_mktsegment FROM (SELECT c.* FROM " + CUSTOMERS + " c)")
def scan_csv(spark, sf_dir):
    """Customers written as delimited files and read back as text."""
    path = files.scratch(spark, "csv")
    rows = customers(spark, sf_dir).select("c_custkey", "c_name", "c_mktsegment")
    rows.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_csv(spark, path)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, md5(replace(replace(text, chr(13), ' '), chr(0), ' ')) AS text_md5 FROM documents WHERE text IS NOT NULL")
def scan_csv_large(spark, sf_dir):
    """Whole documents, line ends and quotes in them, as delimited files that many tasks write and
    read: a file larger than a byte range is read by several."""
    path = files.scratch(spark, "csv")
    text = F.translate("text", "\r\x00", "  ")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", F.concat(text, F.lit('"')).alias("text"))
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    found = files.csv_records(spark, path, ["doc_id", "lang", "text"], files._CSV)
    return found.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.md5(F.expr("substring(text, 1, char_length(text) - 1)")).alias("text_md5"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, coalesce(trim(c_mktsegment), '') AS segment FROM " + CUSTOMERS + " AS t")
def scan_fixed_width(spark, sf_dir):
    path = files.scratch(spark, "fixed")
    cut = F.concat(F.lpad(F.col("c_custkey").cast("string"), 12, " "), F.rpad(F.trim(F.translate("c_name", "\t", " ")), 30, " "), F.coalesce("c_mktsegment", F.lit("")))
    customers(spark, sf_dir).select(cut.alias("value")).write.text(path)
    columns = files.fixed_columns("column_name,start_position,field_length,sequence_number\nid,1,12,1\nname,13,30,2\nsegment,43,12,3")
    return files.read_fixed_width(spark, path, columns)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS state_code, n_name AS state_name, CAST(NULL AS VARCHAR) AS state_fips, 'v1' AS source_version FROM nation")
def scan_reference_csv(spark, sf_dir):
    path, store = files.scratch(spark, "csv"), Store(spark, files.scratch(spark, "store"))
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("state_code"), F.col("n_name").alias("state_name")).write.csv(path, header=True)
    load_reference(store, REFERENCES[0], path, source_version="v1")
    return store.read("us_state").drop("refreshed_at")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS load_run_id FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, 3 FROM nation WHERE n_nationkey < 3")
def load_modes(spark, sf_dir):
    """A table that was created, upserted and appended to."""
    store, rows = Store(spark, files.scratch(spark, "store")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    data = Dataset("nations", primary_key="id")
    for number, (mode, part) in enumerate((("upsert", rows), ("upsert", rows.where("id % 2 = 0")), ("append", rows.where("id < 3"))), 1):
        path = files.scratch(spark, "csv")
        part.write.csv(path, header=True)
        load(store, data, number, path, mode)
    return store.read("nations").select("id", "name", F.col("_load_run_id").alias("load_run_id"))


# ---------------------------------------------------------------- loads


def _changed_orders(spark, sf_dir) -> DataFrame:
    """A tenth of the orders with another status, and as many new ones."""
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    tenth = base.where("o_orderkey % 10 = 0")
    return tenth.withColumn("o_orderstatus", F.lit("X")).unionByName(tenth.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus")))


_CHANGED = "(SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT -o_orderkey - 1, o_custkey, 'N' FROM orders WHERE o_orderkey % 10 = 0)"


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_CHANGED}) UNION ALL SELECT * FROM {_CHANGED}")
def upsert_merge(spark, sf_dir):
    return upsert(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), _changed_orders(spark, sf_dir), "o_orderkey")


@query(f"SELECT CAST(count(*) FILTER (o.o_orderkey IS NULL) AS BIGINT) AS rows_inserted, CAST(count(*) FILTER (o.o_orderkey IS NOT NULL) AS BIGINT) AS rows_updated FROM {_CHANGED} c LEFT JOIN orders o USING (o_orderkey)")
def upsert_load_counts(spark, sf_dir):
    return upsert_counts(table(spark, sf_dir, "orders"), _changed_orders(spark, sf_dir), "o_orderkey")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_CHANGED}) UNION ALL SELECT * FROM {_CHANGED}")
def upsert_partitions(spark, sf_dir):
    """The same merge in a stored table whose rows are dealt by their key."""
    store = Store(spark, files.scratch(spark, "store"))
    store.write("orders", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), key="o_orderkey")
    store.upsert("orders", _changed_orders(spark, sf_dir), "o_orderkey")
    return store.read("orders")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_CHANGED}) UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderstatus FROM {_CHANGED}")
def upsert_stream(spark, sf_dir):
    """The same merge by files that arrive in a folder, in two runs of a stream."""
    store, folder, checkpoint = Store(spark, files.scratch(spark, "store")), files.scratch(spark, "in"), files.scratch(spark, "stream")
    for rows in (table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), _changed_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")):
        rows.write.mode("append").csv(folder, header=True)
        incremental.upsert_stream(store, incremental.watch(spark, folder, ["o_orderkey", "o_orderstatus"]), "orders", "o_orderkey", checkpoint).awaitTermination()
    return store.read("orders").select("o_orderkey", "o_orderstatus")


@query("SELECT r_regionkey, r_name, 'region.csv' AS _source_file, CAST(7 AS BIGINT) AS _load_run_id FROM region")
def load_lineage(spark, sf_dir):
    return with_lineage(table(spark, sf_dir, "region"), "region.csv", 7).drop("_ingested_at")


# ---------------------------------------------------------------- reports


def results(spark, sf_dir) -> DataFrame:
    """Rule results made from events: a rule for each user, some passing, some not."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "ERROR").when(F.col("value") > 20, "FAIL").otherwise("PASS")
    return e.select(F.col("event_id").alias("result_id"), F.col("user_id").alias("rule_id"), F.concat(F.lit("set_"), (F.col("user_id") % 7).cast("string")).alias("dataset_name"), status.alias("status"), F.when(status == "FAIL", F.floor("value")).otherwise(0).cast("long").alias("failed_count"), F.col("ts").alias("checked_at"))


RESULTS = """(SELECT event_id AS result_id, user_id AS rule_id, 'set_' || (user_id % 7) AS dataset_name, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 20 THEN 'FAIL' ELSE 'PASS' END AS status,
  CAST(CASE WHEN event_type <> 'error' AND value > 20 THEN floor(value) ELSE 0 END AS BIGINT) AS failed_count, ts AS checked_at FROM events)"""
LATEST = f"(SELECT * FROM {RESULTS} QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY checked_at DESC, result_id DESC) = 1)"


def rules_table(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("rule_id")).distinct().where("rule_id % 5 <> 0")
    return own.select("rule_id", F.when(F.col("rule_id") % 2 == 0, "regex").otherwise("not_null").alias("rule_type"), F.when(F.col("rule_id") % 3 == 0, "retired").otherwise("approved").alias("rule_status"))


RULES = "(SELECT DISTINCT user_id AS rule_id, CASE WHEN user_id % 2 = 0 THEN 'regex' ELSE 'not_null' END AS rule_type, CASE WHEN user_id % 3 = 0 THEN 'retired' ELSE 'approved' END AS rule_status FROM events WHERE user_id % 5 <> 0)"


@query(f"SELECT result_id, rule_id, dataset_name, status, failed_count FROM {LATEST}")
def latest_result_per_rule(spark, sf_dir):
    return report.latest_results(results(spark, sf_dir)).drop("checked_at")


_BY_STATUS = "CAST(count(*) FILTER (status = 'PASS') AS BIGINT) AS passed, CAST(count(*) FILTER (status = 'FAIL') AS BIGINT) AS failed, CAST(count(*) FILTER (status = 'ERROR') AS BIGINT) AS errors"


@query(f"""
WITH o AS (SELECT dataset_name, CAST(count(*) AS BIGINT) AS evaluated, {_BY_STATUS} FROM {LATEST} GROUP BY 1),
d AS (SELECT DISTINCT dataset_name, dataset_name <> 'set_3' AS loaded FROM {RESULTS} UNION ALL SELECT 'never', TRUE),
j AS (SELECT dataset_name, loaded, coalesce(evaluated, 0) AS evaluated, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(errors, 0) AS errors FROM d LEFT JOIN o USING (dataset_name))
SELECT dataset_name, evaluated, passed, failed, errors, CASE WHEN evaluated > 0 THEN round(passed / evaluated * 100, 1) END AS quality_score,
 CASE WHEN NOT loaded THEN 'Not Loaded' WHEN evaluated = 0 THEN 'Not Yet Assessed' WHEN errors > 0 THEN 'Evaluation Error' WHEN round(passed / evaluated * 100, 1) >= 95 THEN 'Healthy' WHEN round(passed / evaluated * 100, 1) >= 85 THEN 'Needs Attention' ELSE 'At Risk' END AS health FROM j
""")
def health_score(spark, sf_dir):
    own = results(spark, sf_dir)
    datasets = own.select("dataset_name").distinct().withColumn("loaded", F.col("dataset_name") != "set_3").unionByName(spark.createDataFrame([("never", True)], "dataset_name string, loaded boolean"))
    return report.health(report.latest_results(own), datasets)


@query(f"SELECT dataset_name, CAST(count(*) AS BIGINT) AS runs, {_BY_STATUS}, CAST(sum(failed_count) AS BIGINT) AS failed_records FROM {RESULTS} GROUP BY 1")
def results_by_dataset(spark, sf_dir):
    return report.results_by_dataset(results(spark, sf_dir))


@query(f"SELECT CAST(count(DISTINCT dataset_name) AS BIGINT) AS datasets, CAST(count(*) AS BIGINT) AS runs, {_BY_STATUS}, CAST(sum(failed_count) AS BIGINT) AS failed_records FROM {RESULTS}")
def results_totals(spark, sf_dir):
    return report.totals(results(spark, sf_dir))


@query(f"SELECT round(count(*) FILTER (status = 'PASS') / count(*) * 100, 2) AS all_runs_score FROM {RESULTS}")
def all_runs_score(spark, sf_dir):
    return report.all_runs_score(results(spark, sf_dir))


@query(f"SELECT result_id, rule_id, dataset_name, status, failed_count FROM {RESULTS} ORDER BY checked_at DESC, result_id DESC LIMIT 25")
def recent_results(spark, sf_dir):
    return report.recent(results(spark, sf_dir), "checked_at", "result_id").drop("checked_at")


@query(f"SELECT r.result_id, r.rule_id, r.dataset_name, r.status, r.failed_count, t.rule_type, t.rule_status FROM {RESULTS} r LEFT JOIN {RULES} t USING (rule_id)")
def results_with_rules(spark, sf_dir):
    return report.results_with_rules(results(spark, sf_dir).drop("checked_at"), rules_table(spark, sf_dir))


@query(f"SELECT r.result_id, rule_id, r.dataset_name, r.status, r.failed_count, t.rule_type FROM {LATEST} r JOIN {RULES} t USING (rule_id) WHERE rule_status = 'approved'")
def approved_latest_results(spark, sf_dir):
    return report.approved_latest(results(spark, sf_dir), rules_table(spark, sf_dir)).drop("checked_at")


def _failed(spark, sf_dir) -> DataFrame:
    """Three failed rows for each failing result."""
    own = results(spark, sf_dir).where("status = 'FAIL'").select("result_id", "rule_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    return own.select((F.col("result_id") * 10 + F.col("n")).alias("failed_record_id"), "result_id", "rule_id", F.concat_ws("-", F.col("rule_id").cast("string"), F.col("n").cast("string")).alias("source_row_identifier"))


_FAILED = f"(SELECT result_id * 10 + n AS failed_record_id, result_id, rule_id, rule_id || '-' || n AS source_row_identifier FROM {RESULTS}, (SELECT unnest([1, 2, 3]) AS n) WHERE status = 'FAIL')"


@query(f"SELECT f.failed_record_id, f.result_id, rule_id, f.source_row_identifier, r.status, t.rule_type FROM {_FAILED} f JOIN {RESULTS} r USING (result_id, rule_id) LEFT JOIN {RULES} t USING (rule_id)")
def failed_record_trace(spark, sf_dir):
    return report.failed_record_trace(_failed(spark, sf_dir), results(spark, sf_dir), rules_table(spark, sf_dir)).drop("checked_at")


def _remediations(spark, sf_dir) -> DataFrame:
    own = _failed(spark, sf_dir).where("failed_record_id % 4 = 1")
    return own.select((F.col("failed_record_id") + 5).alias("remediation_id"), "failed_record_id", F.lit("city_contains_state").alias("issue_type"), F.when(F.col("result_id") % 2 == 0, "approved").otherwise("proposed").alias("status"))


_REMEDIATIONS = f"(SELECT failed_record_id + 5 AS remediation_id, failed_record_id, 'city_contains_state' AS issue_type, CASE WHEN result_id % 2 = 0 THEN 'approved' ELSE 'proposed' END AS status FROM {_FAILED} WHERE failed_record_id % 4 = 1)"


@query(f"SELECT m.remediation_id, m.failed_record_id, m.issue_type, m.status AS remediation_status, f.result_id, rule_id, f.source_row_identifier, r.dataset_name, t.rule_type FROM {_REMEDIATIONS} m JOIN {_FAILED} f USING (failed_record_id) JOIN {RESULTS} r USING (result_id, rule_id) JOIN {RULES} t USING (rule_id)")
def remediation_queue(spark, sf_dir):
    return report.remediation_queue(_remediations(spark, sf_dir), _failed(spark, sf_dir), results(spark, sf_dir), rules_table(spark, sf_dir))


@query(f"SELECT status, CAST(count(*) AS BIGINT) AS n FROM {_REMEDIATIONS} GROUP BY 1")
def remediation_by_status(spark, sf_dir):
    return report.status_counts(_remediations(spark, sf_dir))


@query(f"SELECT (SELECT CAST(count(*) AS BIGINT) FROM {RULES} WHERE rule_status = 'proposed') AS proposed_rules, (SELECT CAST(count(*) AS BIGINT) FROM {_REMEDIATIONS} WHERE status = 'proposed') AS proposed_remediations, (SELECT CAST(count(*) AS BIGINT) FROM {_REMEDIATIONS} WHERE status = 'approved') AS approved_remediations, (SELECT CAST(count(*) AS BIGINT) FROM {RESULTS} WHERE status = 'ERROR') AS evaluation_errors")
def inbox(spark, sf_dir):
    return report.inbox(rules_table(spark, sf_dir), _remediations(spark, sf_dir), results(spark, sf_dir))


@query(f"SELECT CAST(3 AS BIGINT) AS run, (SELECT count(*) FROM {RULES} WHERE rule_id % 10 = 3) AS rules, (SELECT count(*) FROM {RESULTS} WHERE rule_id % 10 = 3) AS results, (SELECT count(*) FROM {_FAILED} WHERE rule_id % 10 = 3) AS failed_records, (SELECT count(*) FROM {_REMEDIATIONS} m JOIN {_FAILED} f USING (failed_record_id) WHERE f.rule_id % 10 = 3) AS remediations")
def run_artifacts(spark, sf_dir):
    own = lambda df: df.withColumn("stewardship_run_id", F.col("rule_id") % 10)
    failed = _failed(spark, sf_dir)
    made = _remediations(spark, sf_dir).join(failed.select("failed_record_id", "rule_id"), "failed_record_id")
    return report.run_artifacts(3, own(rules_table(spark, sf_dir)), own(results(spark, sf_dir)), failed, own(made)).withColumn("run", F.lit(3).cast("long"))


@query(f"SELECT rule_id AS subject_id, status, dataset_name AS actor FROM {LATEST}")
def status_log_current(spark, sf_dir):
    """The last entry of each subject of an append-only log."""
    log = results(spark, sf_dir).select(F.col("result_id").alias("entry"), F.col("rule_id").alias("subject_id"), F.lit(None).cast("string").alias("from_status"), F.col("status").alias("to_status"), F.col("dataset_name").alias("actor"), F.lit(None).cast("string").alias("note"), F.col("checked_at").alias("at"))
    return control.current_status(log).drop("at")


@query(f"SELECT result_id, CASE status WHEN 'PASS' THEN 'Completed' WHEN 'FAIL' THEN 'Failed' ELSE 'Running' END AS status_label, round(failed_count / 7, 2) AS duration_seconds FROM {RESULTS}")
def load_history(spark, sf_dir):
    name = F.when(F.col("status") == "PASS", "completed").when(F.col("status") == "FAIL", "failed").otherwise("running")
    runs = results(spark, sf_dir).select("result_id", name.alias("status"), (F.col("failed_count") / 7).alias("duration_seconds"))
    return report.load_history(runs).drop("status")


# ---------------------------------------------------------------- corrections

_CITY_STATE, _CITY_ZIP, _STATE_ZIP = (p.replace("\\A", "^").replace("\\z", "$") for p in (remediate.CITY_STATE, remediate.CITY_ZIP, remediate.STATE_ZIP))


@query(rf"""
SELECT id, issue_type, new_city, new_state, new_zip FROM (
  SELECT id, CASE WHEN regexp_matches(city, '{_CITY_STATE}') AND trim(state) = '' THEN 'city_contains_state' WHEN regexp_matches(city, '{_CITY_ZIP}') AND trim(zip) = '' THEN 'city_contains_zip' WHEN regexp_matches(state, '{_STATE_ZIP}') AND trim(zip) = '' THEN 'state_contains_zip' END AS issue_type,
   CASE issue_type WHEN 'city_contains_state' THEN rtrim(trim(regexp_extract(city, '{_CITY_STATE}', 1)), ',') WHEN 'city_contains_zip' THEN rtrim(trim(regexp_extract(city, '{_CITY_ZIP}', 1)), ',') END AS new_city,
   CASE issue_type WHEN 'city_contains_state' THEN regexp_extract(city, '{_CITY_STATE}', 2) WHEN 'state_contains_zip' THEN regexp_extract(state, '{_STATE_ZIP}', 1) END AS new_state,
   CASE issue_type WHEN 'city_contains_zip' THEN regexp_extract(city, '{_CITY_ZIP}', 2) WHEN 'state_contains_zip' THEN regexp_extract(state, '{_STATE_ZIP}', 2) END AS new_zip
  FROM {PLACES} AS p) WHERE issue_type IS NOT NULL
""")
def remediation_split(spark, sf_dir):
    df = places(spark, sf_dir)
    s = F.coalesce(remediate.location_suggestion(df.columns, "city_contains_state_or_zip", "city"), remediate.location_suggestion(df.columns, "state_field_contains_zip", "state"))
    made = df.select("id", s.alias("s")).where("s is not null")
    value = lambda c: F.col("s.suggested_values")[c].alias(f"new_{c}")
    return made.select("id", F.col("s.issue_type").alias("issue_type"), value("city"), value("state"), value("zip"))


def _approved(spark, sf_dir) -> DataFrame:
    """Two remediations for some customers, the second of which may undo the first."""
    own = places(spark, sf_dir).where("cast(id as int) % 6 = 0")
    first = own.select((F.col("id").cast("long") * 2).alias("remediation_id"), F.lit(1).cast("long").alias("rule_id"), F.col("id").alias("source_row_identifier"), F.create_map(F.lit("city"), F.lit("Boston"), F.lit("state"), F.lit("MA"), F.lit("unknown"), F.lit("x")).alias("suggested_values"))
    second = own.where("cast(id as int) % 12 = 0").select((F.col("id").cast("long") * 2 + 1).alias("remediation_id"), F.lit(2).cast("long").alias("rule_id"), F.col("id").alias("source_row_identifier"), F.create_map(F.lit("city"), F.lit("Salem"), F.lit("state"), F.lit("MA")).alias("suggested_values"))
    return first.unionByName(second)


@query(f"SELECT id, CASE WHEN CAST(id AS INT) % 12 = 0 THEN 'Salem' WHEN CAST(id AS INT) % 6 = 0 THEN 'Boston' ELSE city END AS city, CASE WHEN CAST(id AS INT) % 6 = 0 THEN 'MA' ELSE state END AS state, zip, CAST(1 AS BIGINT) AS _dataset_version_id, id AS _raw_source_row_identifier FROM {PLACES}")
def curated_apply(spark, sf_dir):
    base = places(spark, sf_dir)
    return remediate.curated(remediate.apply_changes(base, remediate.field_changes(base, _approved(spark, sf_dir), "id"), "id"), "id", 1)


@query(f"""
WITH p AS (SELECT * FROM {PLACES} WHERE CAST(id AS INT) % 6 = 0), s AS (
  SELECT CAST(id AS BIGINT) * 2 AS remediation_id, CAST(1 AS BIGINT) AS rule_id, id AS "row", 'city' AS column_name, city AS old_value, 'Boston' AS new_value FROM p
  UNION ALL SELECT CAST(id AS BIGINT) * 2, 1, id, 'state', state, 'MA' FROM p
  UNION ALL SELECT CAST(id AS BIGINT) * 2 + 1, 2, id, 'city', 'Boston', 'Salem' FROM p WHERE CAST(id AS INT) % 12 = 0)
SELECT * FROM s WHERE old_value <> new_value
""")
def change_history(spark, sf_dir):
    return remediate.field_changes(places(spark, sf_dir), _approved(spark, sf_dir), "id")


@query(rf"""
SELECT id AS source_row_identifier, issue_type, new_city, new_state, new_zip FROM (
  SELECT id, CASE WHEN regexp_matches(city, '{_CITY_STATE}') AND trim(state) = '' THEN 'city_contains_state' WHEN regexp_matches(city, '{_CITY_ZIP}') AND trim(zip) = '' THEN 'city_contains_zip' END AS issue_type,
   rtrim(trim(regexp_extract(city, CASE issue_type WHEN 'city_contains_state' THEN '{_CITY_STATE}' ELSE '{_CITY_ZIP}' END, 1)), ',') AS new_city,
   CASE issue_type WHEN 'city_contains_state' THEN regexp_extract(city, '{_CITY_STATE}', 2) END AS new_state, CASE issue_type WHEN 'city_contains_zip' THEN regexp_extract(city, '{_CITY_ZIP}', 2) END AS new_zip
  FROM {PLACES} AS p WHERE CAST(id AS INT) % 4 <> 0) WHERE issue_type IS NOT NULL
""")
def remediation_generate(spark, sf_dir):
    """Suggestions for recorded failures that have none yet: those of every fourth row are known."""
    df, city = places(spark, sf_dir), {"type": "city_contains_state_or_zip", "parameters": {}}
    result, failed = control.results_of(evaluate(df, [Rule(1, {"executable_rule": city}, "city")], "id", samples=False), 1)
    known = failed.where("cast(source_row_identifier as int) % 4 = 0")
    made, _ = remediate.generate(df, failed, result, [(1, "city", city)], known, "id")
    value = lambda c: F.col("suggested_values")[c].alias(f"new_{c}")
    return made.select("source_row_identifier", "issue_type", value("city"), value("state"), value("zip"))


@query(f"SELECT CAST(4 AS BIGINT) AS dataset_version_id, id AS curated_row_identifier, id AS raw_source_row_identifier FROM {PLACES}")
def row_lineage(spark, sf_dir):
    return remediate.row_lineage(places(spark, sf_dir), "id", 4)


_sql["change_history_with_rules"] = "SELECT h.*, r.rule_type FROM (HISTORY) h JOIN (SELECT 1 AS rule_id, 'regex' AS rule_type UNION ALL SELECT 3, 'not_null') r USING (rule_id)".replace("HISTORY", _sql["change_history"])


@query()
def change_history_with_rules(spark, sf_dir):
    """Changes whose rule is still known; those of other rules have no row."""
    rules = spark.createDataFrame([(1, "regex"), (3, "not_null")], "rule_id long, rule_type string")
    return report.change_history(change_history(spark, sf_dir), rules)


@query(f"""
SELECT id, CASE WHEN CAST(id AS INT) % 12 = 0 THEN 'Salem' WHEN CAST(id AS INT) % 6 = 0 THEN 'Boston' ELSE city END AS city, CAST(1 AS BIGINT) AS version FROM {PLACES}
""")
def version_applied(spark, sf_dir):
    """A whole version as it is written and read back."""
    store = Store(spark, files.scratch(spark, "store"))
    store.write("places", places(spark, sf_dir))
    remediate.apply_version(store, "places", _approved(spark, sf_dir), "id")
    return store.read("places__current").select("id", "city", F.col("_dataset_version_id").alias("version"))


@query(f"""
SELECT CAST(2 AS BIGINT) AS dataset_version_id, id AS curated_row_identifier, id AS raw_source_row_identifier, CAST(CASE WHEN CAST(id AS INT) % 10 = 5 THEN 2 WHEN CAST(id AS INT) % 6 = 0 AND NOT (city = 'Boston' AND state = 'MA' AND CAST(id AS INT) % 12 <> 0) THEN 1 ELSE 0 END AS BIGINT) AS changed_in FROM {PLACES}
""")
def row_lineage_versions(spark, sf_dir):
    """The lineage of all rows of a second version, of which only changed rows are recorded."""
    store = Store(spark, files.scratch(spark, "store"))
    store.write("places", places(spark, sf_dir))
    remediate.apply_version(store, "places", _approved(spark, sf_dir), "id")
    more = places(spark, sf_dir).where("cast(id as int) % 10 = 5").select(F.col("id").cast("long").alias("remediation_id"), F.lit(3).cast("long").alias("rule_id"), F.col("id").alias("source_row_identifier"), F.create_map(F.lit("zip"), F.lit("00000")).alias("suggested_values"))
    remediate.apply_version(store, "places", more, "id")
    return remediate.lineage_of(store, "places", "id")


# ---------------------------------------------------------------- catalog, previews, registry, lifecycle


@query("SELECT CAST(n AS INTEGER) AS position, c AS column_name, k AS data_type, filled FROM (SELECT unnest([1, 2, 3]) AS n, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS c, unnest(['int', 'string', 'int']) AS k, unnest([count(n_nationkey), count(n_name), count(n_regionkey)]) AS filled FROM nation)")
def catalog_scan(spark, sf_dir):
    """Columns in their order without those of the load, each with its number of values."""
    df = with_lineage(table(spark, sf_dir, "nation"), "nation.csv", 1)
    columns = spark.createDataFrame(profile.catalog(df), "position int, column_name string, data_type string")
    return columns.join(statistics(df).select("column_name", (F.col("row_count") - F.col("null_count")).alias("filled")), "column_name")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer ORDER BY customer.c_custkey LIMIT 20")
def preview_file(spark, sf_dir):
    """The first parsed rows of a file."""
    path = files.scratch(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey").coalesce(1).write.csv(path, header=True)
    return files.preview(files.read_csv(spark, path))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")
def preview_table(spark, sf_dir):
    return files.preview(table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey"), 100)


@query("SELECT 'set_' || n_nationkey AS dataset_name, CASE WHEN n_nationkey % 4 = 0 THEN 'fixed_width' ELSE 'csv' END AS source_type, n_nationkey % 4 <> 0 AS active FROM nation")
def registry_upsert(spark, sf_dir):
    """Datasets that are registered, some of them again."""
    store = Store(spark, files.scratch(spark, "store"))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("set_"), F.col("n_nationkey").cast("string")).alias("dataset_name"), F.lit("csv").alias("source_type"), F.lit(True).alias("active"), "n_nationkey")
    control.merge_rows(store, "control_dataset", rows, "dataset_name")
    again = rows.where("n_nationkey % 4 = 0").withColumns({"source_type": F.lit("fixed_width"), "active": F.lit(False)})
    control.merge_rows(store, "control_dataset", again, "dataset_name")
    return store.read("control_dataset").drop("n_nationkey")


@query(f"SELECT id, city, state, zip, CAST(3 AS BIGINT) AS _dataset_version_id, id AS _raw_source_row_identifier FROM {PLACES}")
def curated_projection(spark, sf_dir):
    return remediate.curated(places(spark, sf_dir), "id", 3)


@query("SELECT CAST(1 AS BIGINT) AS rule_id, CAST(n_nationkey AS INTEGER) AS failing FROM nation WHERE n_nationkey > 17 UNION ALL SELECT 2, n_nationkey FROM nation WHERE n_nationkey % 5 = 3")
def failure_samples(spark, sf_dir):
    """The rows that results show of rules with few failures: all of them."""
    df = table(spark, sf_dir, "nation").withColumn("even", F.when(F.col("n_nationkey") % 5 != 3, "x"))
    found = evaluate(df, [Rule(1, rule("numeric_range", min=0, max=17), "n_nationkey"), Rule(2, rule("not_null"), "even")], "n_nationkey")
    shown = F.from_json("details", "sample_failures array<struct<n_nationkey int>>")["sample_failures"]
    return found.results.select("rule_id", F.explode(shown).alias("x")).select("rule_id", F.col("x.n_nationkey").alias("failing"))


_NEW_YORK = "ts - CASE WHEN ts >= TIMESTAMP '2024-03-10 07:00:00' AND ts < TIMESTAMP '2024-11-03 06:00:00' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END"


@query(f"SELECT event_id, CASE WHEN d = DATE '2024-01-15' THEN 'Today' WHEN d = DATE '2024-01-14' THEN 'Yesterday' ELSE strftime(d, '%b ') || day(d) || ', ' || year(d) END || strftime(t, ' %-I:%M %p') AS shown FROM (SELECT event_id, {_NEW_YORK} AS t, CAST({_NEW_YORK} AS DATE) AS d FROM events)")
def last_loaded(spark, sf_dir):
    """Times of events as a page in New York shows them."""
    return table(spark, sf_dir, "events").select("event_id", report.last_loaded(F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("shown"))


@query("SELECT CAST(v AS BIGINT) AS version, count(*) AS n_rows, CAST(CASE WHEN v = 1 THEN count(*) FILTER (c_custkey % 6 = 0) ELSE count(*) FILTER (c_custkey % 10 = 5) END AS BIGINT) AS changed_rows FROM customer, (SELECT unnest([1, 2]) AS v) GROUP BY v")
def version_rows(spark, sf_dir):
    """Rows of each version and rows that it changed."""
    store = Store(spark, files.scratch(spark, "store"))
    store.write("places", places(spark, sf_dir))
    change = lambda every, rest, value: places(spark, sf_dir).where(f"cast(id as int) % {every} = {rest}").select(F.col("id").cast("long").alias("remediation_id"), F.lit(1).cast("long").alias("rule_id"), F.col("id").alias("source_row_identifier"), F.create_map(F.lit("zip"), F.lit(value)).alias("suggested_values"))
    made = [remediate.apply_version(store, "places", change(*x), "id") for x in ((6, 0, "00001"), (10, 5, "00002"))]
    changed = store.read("places__lineage").groupBy(F.col("dataset_version_id").alias("version")).agg(F.count("*").alias("changed_rows"))
    return spark.createDataFrame([(m["version"], m["rows"]) for m in made], "version long, n_rows long").join(changed, "version")


def _owners(spark, sf_dir) -> DataFrame:
    """Customers under names that repeat a structure and a meaning."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("owner_1_key"), F.when(k % 3 > 0, "person").otherwise("firm").alias("owner_1_type"), F.when(k % 3 > 0, F.col("c_name")).alias("owner_1_name"),
        k.alias("owner_2_key"), F.when(k % 2 > 0, "person").otherwise("firm").alias("owner_2_type"), F.when(k % 2 > 0, F.col("c_name")).alias("owner_2_name"),
    )


@query("""
SELECT 'conditional_completeness' AS family, 'owner_{n}_type' AS one, 'owner_{n}_key' AS other, 78 AS score WHERE (SELECT count(DISTINCT c_custkey % 3 > 0) FROM customer) > 1 UNION ALL SELECT 'conditional_completeness', 'owner_{n}_type', 'owner_{n}_name', 78
UNION ALL SELECT 'conditional_completeness', 'owner_{n}_type', 'owner_{n}_type', 78 UNION ALL SELECT 'repeated_structure_completeness', 'owner_{n}_key', 'owner_{n}_type', 76 UNION ALL SELECT 'repeated_structure_completeness', 'owner_{n}_key', 'owner_{n}_name', 76
UNION ALL SELECT 'repeated_structure_completeness', 'owner_{n}_type', 'owner_{n}_name', 76 UNION ALL SELECT 'duplicate_semantic_field', 'owner_{n}_key', 'owner_{n}_key', 70 UNION ALL SELECT 'duplicate_semantic_field', 'owner_{n}_type', 'owner_{n}_type', 70 UNION ALL SELECT 'duplicate_semantic_field', 'owner_{n}_name', 'owner_{n}_name', 70
""")
def mine_discovered(spark, sf_dir):
    """Candidates by repeated structure and meaning, one for each kind of pair."""
    found = mine.discover(profile.profile(_owners(spark, sf_dir)))
    return spark.createDataFrame([(c.family, names.generalized(c.left), names.generalized(c.right), int(c.score)) for c in found], "family string, one string, other string, score int")


_ODD_RULES = [("pattern", {"pattern": "[A-Z]+"}), ("allowed_values", {"values": []}), ("numeric_range", {"min": 3, "max": 1}), ("city_ends_with_state_or_zip", {}), ("no_such_rule", {})]


@query("""
SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'regex' WHEN 3 THEN 'city_contains_state_or_zip' WHEN 1 THEN 'allowed_values' WHEN 2 THEN 'numeric_range' ELSE NULL END AS rule_type,
 CASE n_nationkey % 5 WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 4 THEN FALSE ELSE TRUE END AND n_nationkey % 2 = 0 AS approved, n_nationkey % 5 IN (0, 1, 3) AS valid FROM nation
""")
def rules_validated(spark, sf_dir):
    """Stored definitions, one a nation, as the registry normalises, validates and approves them."""
    rows = []
    for r in table(spark, sf_dir, "nation").select("n_nationkey").collect():  # 25 rows
        kind, parameters = _ODD_RULES[r.n_nationkey % 5]
        definition = json.dumps({"executable_rule": {"type": kind, "parameters": parameters or None}})
        spec = registry.get_rule_spec(kind)
        valid, _, _ = registry.validate_executable_rule(registry.executable_of(definition))
        approved, _, _ = registry.validate_rule_for_approval(definition, registry.COLUMN if r.n_nationkey % 2 == 0 else registry.ROW)
        rows.append((r.n_nationkey, spec.rule_type if spec else None, approved, valid))
    return spark.createDataFrame(rows, "n_nationkey int, rule_type string, approved boolean, valid boolean")


@query("""
SELECT 'COLUMN' AS scope, 'state' AS columns, 'reference_value' AS rule_type, (SELECT count(*) FROM customer) AS n_rows UNION ALL SELECT 'COLUMN', 'zip', 'reference_value', (SELECT count(*) FROM customer) UNION ALL SELECT 'ROW', 'city,state,zip', 'city_state_zip_reference', (SELECT count(*) FROM customer)
UNION ALL SELECT 'DATASET', '', 'minimum_row_count', (SELECT count(*) FROM customer) UNION ALL SELECT 'DATASET', '', 'primary_key_unique', (SELECT count(*) FROM customer) UNION ALL SELECT 'COLUMN', 'state', 'not_null', (SELECT count(*) FROM customer)
""")
def proposals_made(spark, sf_dir):
    """What is proposed for a profiled table that knows one of the rules already: by a proposer
    for columns with nulls or blanks, by the key, and by names of reference keys."""
    df = places(spark, sf_dir).where("zip <> ''").unionByName(places(spark, sf_dir).where("zip = ''").withColumn("zip", F.lit("0")))
    found = profile.profile(df)
    lacking = {p["column_name"] for p in found if p["min_value"] == ""}
    ask = lambda p: rule("not_null" if p["column_name"] in lacking else "none")
    made = [("COLUMN", [c], d["executable_rule"]) for c, d, status in propose.propose_columns(found, ask) if status == "proposed"]
    made += [("DATASET", [], r) for r in propose.propose_dataset("id")] + propose.propose_references(df.columns)
    fresh = propose.new_rules([r for _, _, r in made] * 2, [])
    return spark.createDataFrame([(scope, ",".join(columns), r["type"], found[0]["row_count"]) for scope, columns, r in made if r in fresh], "scope string, columns string, rule_type string, n_rows long")


@query(f"SELECT CASE WHEN result_id % 3 = 0 THEN 'approved' WHEN result_id % 3 = 1 THEN 'rejected' ELSE 'proposed' END AS status, count(*) AS n FROM {_FAILED} GROUP BY 1")
def remediation_decided(spark, sf_dir):
    """Suggestions by status after two decisions, of which the second changes some of the first."""
    store = Store(spark, files.scratch(spark, "store"))
    made = _failed(spark, sf_dir).select("failed_record_id", "result_id", "rule_id", "source_row_identifier", F.lit("city_contains_state").alias("issue_type"), *[F.create_map(F.lit("city"), F.lit("x")).alias(f"{x}_values") for x in ("original", "suggested")], F.lit(0.9).alias("confidence_score"), F.lit("deterministic").alias("generation_method"))
    control.save_remediations(store, "set", made)
    control.decide_remediations(store, F.col("result_id") % 3 < 2, "approved", "ann")
    control.decide_remediations(store, F.col("result_id") % 3 == 1, "rejected", "bo", "not so")
    return report.status_counts(control.remediations(store))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN NULL ELSE n_name END AS name FROM nation")
def json_replies(spark, sf_dir):
    """The object in replies that have fences, words around it, or none."""
    rows = []
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows
        body = json.dumps({"name": r.n_name, "more": {"a": [1]}})
        reply = (f"```json\n{body}\n```", f"Here it is: {body} and so on", "no object")[r.n_nationkey % 3]
        try:
            rows.append((r.n_nationkey, names.first_object(reply)["name"]))
        except names.DataQualityError:
            rows.append((r.n_nationkey, None))
    return spark.createDataFrame(rows, "n_nationkey int, name string")


@query("SELECT result_id, 'numeric_range' AS rule_type, CAST(failed_count AS DOUBLE) AS top FROM (SELECT event_id AS result_id, CAST(floor(value) AS BIGINT) AS failed_count FROM events)")
def json_definitions(spark, sf_dir):
    """Types and parameters in definitions that are stored as JSON text."""
    e = table(spark, sf_dir, "events")
    text = F.to_json(F.struct(F.struct(F.lit("numeric_range").alias("type"), F.struct(F.lit(0).alias("min"), F.floor("value").alias("max")).alias("parameters")).alias("executable_rule")))
    read = F.from_json(text, "executable_rule struct<type: string, parameters: struct<min: double, max: double>>")["executable_rule"]
    return e.select(F.col("event_id").alias("result_id"), read["type"].alias("rule_type"), read["parameters"]["max"].alias("top"))


@query(f"SELECT 'city' AS target, 'FAIL' AS status, count(*) FILTER (regexp_matches(city, '\\b\\d{{5}}(-\\d{{4}})?\\b') OR regexp_matches(trim(city), '(,\\s*|\\s+)[A-Z]{{2}}\\s*$')) AS failed_count FROM {PLACES} AS p UNION ALL SELECT 'id', 'PASS', 0")
def rule_alone(spark, sf_dir):
    """One rule at a time, as a caller of a single rule gets it."""
    df, rows = places(spark, sf_dir), []
    for target, kind in (("city", "city_contains_state_or_zip"), ("id", "not_null")):
        status, details = evaluate_rule(rule(kind), df, "id", target)
        rows.append((target, status, details["failed_count"]))
    return spark.createDataFrame(rows, "target string, status string, failed_count long")


@query("SELECT n_nationkey, 'Postal_Code' AS found, left('nations_' || lower(replace(n_name, ' ', '_')) || repeat('x', 50), 42) || '__v3' AS version_name, left('nations_' || lower(replace(n_name, ' ', '_')) || repeat('x', 50), 50) || '__current' AS current_name FROM nation")
def names_of_versions(spark, sf_dir):
    rows = []
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows
        own = "nations_" + r.n_name.lower().replace(" ", "_") + "x" * 50
        rows.append((r.n_nationkey, names.find_column(["City", "Postal_Code"], "zip", None, "postal_code"), remediate.version_name(own, 3), remediate.current_name(own)))
    return spark.createDataFrame(rows, "n_nationkey int, found string, version_name string, current_name string")


@query("SELECT CAST(r_regionkey + 1 AS BIGINT) AS run_id, p AS phase, CASE WHEN r_regionkey % 2 = 1 THEN 'failed' ELSE 'completed' END AS status FROM region, (SELECT unnest(['run', 'load']) AS p)")
def run_bookkeeping(spark, sf_dir):
    """Runs, one a region, with the last state of each phase."""
    store = Store(spark, files.scratch(spark, "store"))
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():  # 5 rows
        run_id = control.start_run(store, "stewardship", r.r_name)
        control.record_phase(store, run_id, "stewardship", r.r_name, "load", "running")
        for phase in ("load", "run"):
            control.record_phase(store, run_id, "stewardship", r.r_name, phase, "failed" if r.r_regionkey % 2 else "completed")
    return control.run_states(store.read("control_run")).select("run_id", "phase", "status")


@query(f"SELECT status, n, CAST(row_number() OVER (ORDER BY status) - 1 AS BIGINT) AS place FROM (SELECT status, count(*) AS n FROM {RESULTS} GROUP BY 1)")
def sorted_statuses(spark, sf_dir):
    """Counts in the order in which a page shows them."""
    rows = report.status_counts(results(spark, sf_dir)).collect()  # a row for each status
    return spark.createDataFrame([(r.status, r.n, i) for i, r in enumerate(rows)], "status string, n long, place long")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Missing: [''c''].' ELSE 'Unexpected: [''extra''].' END AS fault FROM nation")
def column_sets(spark, sf_dir):
    """What keeps a file from a table: the columns that one of them lacks."""
    base = spark.createDataFrame([], "a string, b string, c string, _load_run_id long")
    rows = []
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows
        incoming = (base.select("c", "b", "a"), base.select("a", "b"), base.select("a", "b", "c", F.lit("x").alias("extra")))[r.n_nationkey % 3]
        try:
            check_schema(base, incoming)
            rows.append((r.n_nationkey, None))
        except names.DataQualityError as problem:
            told = str(problem)
            rows.append((r.n_nationkey, next(f"{k}: {v}." for k, v in re.findall(r"(Missing|Unexpected): (\[[^\]]*\])", told) if v != "[]")))
    return spark.createDataFrame(rows, "n_nationkey int, fault string")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
