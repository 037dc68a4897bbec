import datetime

import pytest
from pyspark.sql import functions as F

from veridat.functions import text
from veridat.functions.names import DataQualityError, find_column, first_object, generalized, identifier, words


def values(spark, rows, f):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_strip_takes_all_unicode_space(spark):
    assert values(spark, ["\t a b ", " x\x85", "\x1cy\x1f", "", None, "a\n"], text.strip) == ["a b", "x", "y", "", None, "a"]


def test_populated_and_present_are_never_null(spark):
    rows = [" ", None, "nan", "None", "x"]
    assert values(spark, rows, text.populated) == [False, False, True, True, True]
    assert values(spark, rows, text.present) == [False, False, False, False, True]


def test_numbers_as_a_strict_parser_takes_them(spark):
    rows = [" 10 ", "1e3", "+5", "inf", "-Infinity", "1,000", "0x10", "1_000", "5%", "", "nan", "5d", ".5", "5.", None]
    assert values(spark, rows, text.number) == [10.0, 1000.0, 5.0, float("inf"), float("-inf"), None, None, None, None, None, None, None, 0.5, 5.0, None]


def test_dates_in_order_of_formats(spark):
    day = datetime.date
    rows = ["2026-01-02", "2026-1-2", "01/02/2026", "20260102", "01022026", "01-02-2026", "2026-02-30", "nan", "", None, "2026-01-02 00:00"]
    assert values(spark, rows, text.date) == [day(2026, 1, 2)] * 6 + [None] * 5
    assert values(spark, ["01-02-2026"], lambda c: text.date(c, text.MINER_DATE_FORMATS)) == [None]


def test_one_format(spark):
    assert values(spark, ["2026-01-02", "02/01/2026"], lambda c: text.dated(c, "%d/%m/%Y")) == [None, datetime.date(2026, 1, 2)]
    assert text.supported_format("YYYY-MM-DD") and text.supported_format("%d.%m.%y")
    assert not text.supported_format("%H:%M") and not text.supported_format("plain")


def test_full_match_takes_no_trailing_newline(spark):
    assert values(spark, ["ab", "ab\n", "xab"], lambda c: text.full_match(c, "a|ab")) == [True, False, False]


def test_names():
    assert words("The_Record Status-Date") == ["status", "date"]
    assert generalized("owner_12_city") == "owner_{n}_city"
    assert find_column(["City", "zip"], None, "place", "CITY") == "City"
    assert identifier("a_1") == "a_1"
    with pytest.raises(DataQualityError):
        identifier("a b")


def test_replies_with_fences():
    assert first_object('Here:\n```json\n{"a": 1}\n``` and {"b": 2}') == {"a": 1}
    with pytest.raises(DataQualityError):
        first_object("none")
