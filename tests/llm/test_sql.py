"""The registered SQL gives the rows of its query."""

import math

import duckdb
import pytest

from veridat.llm import queries

TEXTS = [
    "a b c d e f g h i j k l m n o p q r s t u v w x y z again",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z again and",
    "one | two | three | four\nBUY!! NOW!! THIS!!\nplain words stand here in a line of their own, as many as twenty or more, so that the text is long enough",
    "x y z " * 20, "%%% $$$ text of words", "Line\nLine\nLine", "the passage that the benchmark has is this one here and it ends now", "so the passage that the benchmark has is this one here and it ends now too", None, "", "é è",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "the passage that the benchmark has is this one here and it ends now"), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(3, "u", "p" * 120), (2, "u", "p" * 120), (1, None, None), (4, "u", "é" * 50)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, [math.sin(i * j + j) for j in range(64)], 0) for i in range(90)] + [(90, None, 0), (100, [0.5] * 64, 0), (101, [0.5] * 64, 0)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, tables, name):
    found = queries.queries()[name](spark, tables)
    columns = sorted(found.columns)
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        db.sql(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    want = db.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, want))
