"""Every registered query of the engine against its SQL on small star tables."""

import duckdb
import pytest

from veridat.plans import registered

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
NOW = "timestamp'1995-01-01'"


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    """Small tables of the sample's shape, made by rule."""
    folder = str(tmp_path_factory.mktemp("sf"))
    db = duckdb.connect()
    made = {
        "region": "select i::int r_regionkey, 'R' || i r_name from range(5) t(i)",
        "nation": "select i::int n_nationkey, 'N' || i n_name, (i % 5)::int n_regionkey from range(25) t(i)",
        "customer": "select i c_custkey, 'Customer#' || lpad(i::varchar, 9, '0') c_name, (i % 25)::int c_nationkey, round((i * 37 % 11000) - 990.5, 2) c_acctbal, ['BUILDING', 'MACHINERY', 'HOUSEHOLD', 'AUTOMOBILE'][i % 4 + 1] c_mktsegment from range(300) t(i)",
        "supplier": "select i s_suppkey, 'S' || i s_name, 1::int s_nationkey, 1.5 s_acctbal from range(10) t(i)",
        "part": "select i p_partkey, 'part' p_name, 'B' p_brand, 'T' p_type, 1::int p_size, 9.5 p_retailprice from range(10) t(i)",
        "orders": f"select i o_orderkey, i * 7 % 300 o_custkey, ['O', 'F', 'P'][i % 3 + 1] o_orderstatus, i * 10.5 o_totalprice, {NOW} + interval (i % 900) day o_orderdate, ['1-URGENT', '2-HIGH', '5-LOW'][i % 5 % 3 + 1] o_orderpriority from range(800) t(i)",
        "lineitem": f"select i * 13 % 800 l_orderkey, i % 10 l_partkey, i % 10 l_suppkey, (i % 7)::int l_linenumber, (i % 50)::double l_quantity, i * 1.5 l_extendedprice, (i % 11) / 100 l_discount, (i % 9) / 100 l_tax, ['A', 'R', 'N'][i % 3 + 1] l_returnflag, ['F', 'O'][i % 2 + 1] l_linestatus, {NOW} + interval (i % 1000) day l_shipdate from range(3000) t(i)",
        "events": "select i event_id, timestamp'2024-01-01' + interval (i * 977 % 5000) second ts, i % 40 user_id, ['view', 'error', 'click'][i % 7 % 3 + 1] event_type, (i * 31 % 60)::double value, '{}' props from range(1000) t(i)",
        "documents": "select i doc_id, 'text ' || i as text, ['en', 'de', 'fr', 'es'][i % 4 + 1] lang, 'src' || (i % 3) source, 5 + length(i::varchar) n_chars from range(200) t(i)",
        "labels": "select i * 3 doc_id, 1::int quality, 0::int toxic from range(50) t(i)",
    }
    for name, sql in made.items():
        db.sql(f"copy ({sql}) to '{folder}/{name}.parquet' (format parquet)")
    return folder


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_equals_its_sql(spark, sf_dir, name):
    found = registered.queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = db.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({registered.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, want))


def test_entry_imports_without_the_corpus_part(spark):
    import __spark_entry__

    assert set(registered.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
