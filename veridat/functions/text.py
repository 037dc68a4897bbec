"""Column expressions that all rules share: trimming, presence, numbers and dates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's strip() sees it, and the words that stand for null.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # the same, one by one
NULL_WORDS = ("", "None", "nan", "NaN")

NUMBER = r"(?i)\A(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|[+-]?(?:inf|infinity))\z"

# Date formats in the order in which they are tried.
DATE_FORMATS = ("%m%d%Y", "%Y%m%d", "%m/%d/%Y", "%Y-%m-%d", "%m-%d-%Y")
MINER_DATE_FORMATS = DATE_FORMATS[:4]
NAMED_FORMATS = {"YYYYMMDD": "%Y%m%d", "MMDDYYYY": "%m%d%Y", "YYYY-MM-DD": "%Y-%m-%d", "MM/DD/YYYY": "%m/%d/%Y", "MM-DD-YYYY": "%m-%d-%Y"}

_MONTH, _DAY = "1[0-2]|0?[1-9]", "3[01]|[12][0-9]|0?[1-9]"
_PART = {"%Y": "([0-9]{4})", "%m": f"({_MONTH})", "%d": f"({_DAY})", "%y": "([0-9]{2})"}


def strip(column: Column) -> Column:
    """The value as text without white space at either end; null stays null."""
    return F.btrim(column.cast("string"), F.lit(_WHITE))


def populated(column: Column) -> Column:
    """True where there is text but white space, false else, never null."""
    return F.coalesce(strip(column) != "", F.lit(False))


def present(column: Column) -> Column:
    """As populated(), where the words for null count as absent too."""
    return F.coalesce(~strip(column).isin(*NULL_WORDS), F.lit(False))


def number(column: Column) -> Column:
    """The value as a double; null where it isn't a plain number."""
    s = strip(column)
    return F.when(s.rlike(NUMBER), F.when(s.rlike("(?i)inf"), F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(s.try_cast("double")))


def whole_number(column: Column) -> Column:
    """The value as an exact whole number of up to 38 digits; null where it isn't one."""
    s = strip(column)
    return F.when(s.rlike(r"\A[+-]?[0-9]{1,38}\z"), s.try_cast("decimal(38,0)"))


def full_match(column: Column, pattern: str) -> Column:
    return column.rlike(rf"\A(?:{pattern})\z")


def date(column: Column, formats=DATE_FORMATS) -> Column:
    """The first of ``formats`` that the trimmed value matches as a whole and that is a day
    of the calendar. Months and days may have one digit, as in strptime."""
    slashed, dashed = [f for f in formats if "/" in f], [f for f in formats if "-" in f]
    rest = [f for f in formats if f not in (*slashed, *dashed)]

    def parsed(s: Column) -> Column:
        # what separates the parts tells which formats come into question
        tried = lambda some: F.coalesce(*[_dated(s, f) for f in some]) if some else F.lit(None).cast("date")
        return F.when(s.contains("/"), tried(slashed)).when(s.contains("-"), tried(dashed)).otherwise(tried(rest))

    # an array of one binds the trimmed value, which else is computed anew for each format
    return F.transform(F.array(strip(column)), parsed)[0]


def supported_format(fmt: str) -> bool:
    """Whether ``fmt``, named or in strptime's notation, has only %Y, %y, %m and %d once each."""
    fmt = NAMED_FORMATS.get(fmt, fmt)
    found = re.findall("%.", fmt)
    return bool(found) and len(set(found)) == len(found) and set(found) <= set(_PART) and not {"%Y", "%y"} <= set(found)


def dated(column: Column, fmt: str) -> Column:
    """The trimmed value parsed by one format, named or in strptime's notation."""
    return F.transform(F.array(strip(column)), lambda s: _dated(s, NAMED_FORMATS.get(fmt, fmt)))[0]


def _dated(value: Column, fmt: str) -> Column:
    order, pattern, at = [], "", 0
    for m in re.finditer("%.", fmt):
        pattern += re.escape(fmt[at : m.start()]) + _PART[m[0]]
        order.append(m[0])
        at = m.end()
    pattern = rf"\A(?:{pattern}{re.escape(fmt[at:])})\z"
    # a date's own notation needs no format, which makes the cast fast; it knows the calendar
    as_date = lambda text: text.try_cast("date")
    valid = value.rlike(pattern)
    if fmt == "%Y-%m-%d":
        return F.when(valid & ~value.startswith("0000"), as_date(value))
    if fmt in ("%m%d%Y", "%Y%m%d"):  # eight digits are the common case and need no parts
        year, month, day = (F.substring(value, i, n) for i, n in (((5, 4), (1, 2), (3, 2)) if fmt == "%m%d%Y" else ((1, 4), (5, 2), (7, 2))))
        eight = F.when(value.rlike(r"\A[0-9]{8}\z") & (year != "0000"), as_date(F.concat_ws("-", year, month, day)))
        return F.when(F.length(value) == 8, eight).otherwise(_from_parts(value, order, pattern, valid))
    return _from_parts(value, order, pattern, valid)


def _from_parts(value: Column, order: list[str], pattern: str, valid: Column) -> Column:
    part = lambda p: F.regexp_extract(value, pattern, order.index(p) + 1)
    year = part("%Y") if "%Y" in order else F.lit("1900")
    if "%y" in order:
        year = F.concat(F.when(part("%y") >= "69", "19").otherwise("20"), part("%y"))
    month = part("%m") if "%m" in order else F.lit("1")
    day = part("%d") if "%d" in order else F.lit("1")
    return F.when(valid & (year != "0000"), F.concat_ws("-", year, month, day).try_cast("date"))
