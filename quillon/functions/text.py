"""Scalar text, date and number functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word_count(text: Column) -> Column:
    """Words between (Unicode) white space; 0 for blank and null texts."""
    return F.coalesce(F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), F.lit(0))


@F.pandas_udf(T.StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


def normalise_text(text: Column, ascii_only: bool = False) -> Column:
    """NFKC, white space collapsed and stripped, case-folded. ASCII texts need no Python: ``ascii_only``."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))) if ascii_only else _fold(text)


def list_items(text: Column) -> Column:
    """Lines that are not empty once a leading bullet or number is taken off."""
    stripped = F.transform(F.split(text, r"\R"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.filter(stripped, lambda x: x != "")


def iso_day(text: Column) -> Column:
    """The day that an ISO string names (2026-03-31, 20260331, 2026-W14-2, 2026-3-31), else null; slashes are refused."""
    t = F.trim(text)
    week = t.rlike(r"^\d{4}-?W\d{2}(?:-?[1-7])?$")
    year, nth = F.substring(t, 1, 4).try_cast("int"), F.regexp_extract(t, r"W(\d{2})", 1).try_cast("int")
    day = F.coalesce(F.regexp_extract(t, r"W\d{2}-?([1-7])$", 1).try_cast("int"), F.lit(1))
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in week 1
    monday = F.date_sub(fourth, F.weekday(fourth))
    by_week = F.date_add(monday, (nth - 1) * 7 + day - 1)
    last = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    loose = F.regexp_replace(F.regexp_replace(t, r"-(\d)(?=-|$)", "-0$1"), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    plain = F.when(loose.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(loose, "yyyy-MM-dd"))
    return F.when(week, F.when(nth.between(1, last), by_week)).otherwise(plain)


def is_calendar_date(text: Column) -> Column:
    """Exactly YYYY-MM-DD and a real day."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def hundredths(number_text: Column) -> Column:
    """Integer hundredths of a decimal number, rounded half up through its text, not its binary value."""
    return (F.round(number_text.try_cast("decimal(38,6)"), 2) * 100).cast("long")


def field_stem(path: Column) -> Column:
    """Top-level field of a path: what stands before the first of ``. [ {``."""
    for mark in ".[{":
        path = F.substring_index(path, mark, 1)
    return path


def path_shape(path: Column) -> Column:
    """The path with indices as [] and a set member as {}."""
    return F.regexp_replace(F.regexp_replace(path, r"\[\d+\]", "[]"), r"(?s)\{.*\}$", "{}")


_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def spell_number(value: Column) -> Column:
    """0 to 999,999 in words, with "and" before the part below a hundred; null outside."""
    small, tens = F.array(*map(F.lit, _SMALL)), F.array(*map(F.lit, _TENS))

    def below_hundred(n: Column) -> Column:
        two = F.concat(F.element_at(tens, F.greatest((n / 10).cast("int") - 1, F.lit(1))), F.when(n % 10 > 0, F.concat(F.lit("-"), F.element_at(small, (n % 10 + 1).cast("int")))).otherwise(""))
        return F.when(n < 20, F.element_at(small, F.least(n + 1, F.lit(20)).cast("int"))).otherwise(two)

    def below_thousand(n: Column) -> Column:
        hundreds = F.concat(F.element_at(small, (n / 100).cast("int") + 1), F.lit(" hundred"))
        return F.when(n < 100, below_hundred(n)).when(n % 100 == 0, hundreds).otherwise(F.concat(hundreds, F.lit(" and "), below_hundred(n % 100)))

    n = value.cast("int")
    high, low = (n / 1000).cast("int"), n % 1000
    thousands = F.concat(below_thousand(high), F.lit(" thousand"))
    joined = F.when(n < 1000, below_thousand(n)).when(low == 0, thousands).when(low < 100, F.concat(thousands, F.lit(" and "), below_hundred(low))).otherwise(F.concat(thousands, F.lit(" "), below_thousand(low)))
    return F.when(n.between(0, 999_999), joined)


def dollars(amount: Column) -> Column:
    """$1,234 or, with cents, $1,234.50."""
    return F.when(amount == F.floor(amount), F.concat(F.lit("$"), F.format_number(amount, 0))).otherwise(F.concat(F.lit("$"), F.format_number(amount, 2)))


def basis_points(pct: Column) -> Column:
    """0.88 -> 88 basis points."""
    return F.concat(F.round(pct * 100).cast("long").cast("string"), F.lit(" basis points"))


def ordinal(day: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th .."""
    end = F.when(day % 100 / 10 >= 1, F.when(day % 100 < 14, F.lit("th"))).otherwise(None)
    end = F.coalesce(end, F.when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th"))
    return F.concat(day.cast("string"), end)
