"""Column expressions for text, numbers and similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_empty(col: Column | str, kind: T.DataType | None = None) -> Column:
    """NULL, NaN and ``""`` are the three empty values."""
    c = F.col(col) if isinstance(col, str) else col
    test = c.isNull()
    if kind is None or isinstance(kind, T.StringType):
        test = test | (c.cast("string") == "")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        test = test | F.isnan(c)
    return test


def empty_test(df: DataFrame, name: str) -> Column:
    return is_empty(F.col(name), df.schema[name].dataType)


def sanitize_name(col: Column) -> Column:
    c = F.regexp_replace(col, "[^A-Za-z0-9_]", "_")
    c = F.regexp_replace(c, "_+", "_")
    return F.regexp_replace(c, "^_|_$", "")


def norm_token(col: Column) -> Column:
    low = F.lower(col)
    stem = (F.length(low) > 3) & low.endswith("s") & ~low.endswith("ss")
    return F.when(stem, F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def norm_key(col: Column) -> Column:
    """Canonical key of a text variant: lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "))


def significant_digits(col: Column, kind: T.DataType | None = None) -> Column:
    """Number of significant digits of a number written as text, or of a number of type ``kind``.

    The digits of an exponent never count. A DOUBLE or FLOAT is written with ``.0`` where it is whole; that does not count.
    """
    plain = F.regexp_replace(col.cast("string"), "[eE][+-]?[0-9]+$", "")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(plain, r"\.0$", "")
    digits = F.regexp_replace(F.regexp_replace(plain, "[^0-9]", ""), "^0+", "")
    return F.length(digits).cast("int")


# Target scales and letter suffixes of written amounts.
SCALES = {"none": 1.0, "thousands": 1e3, "millions": 1e6, "billions": 1e9, "trillions": 1e12, "basis_points": 1e-4}
SUFFIXES = {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}


def rescale(col: Column, scale: str) -> Column:
    """``1.23B`` as a number in ``scale``; parentheses mean negative."""
    text = F.lower(F.trim(col))
    number = F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9,]*\.?[0-9]*|\.[0-9]+)", 1), ",", "").try_cast("double")
    word = F.regexp_extract(text, r"[0-9.]\s*(thousand|million|billion|trillion|k|m|b|t)\b", 1)
    factor = F.lit(1.0)
    for suffix, value in SUFFIXES.items():
        factor = F.when(word == suffix, F.lit(value)).otherwise(factor)
    percent = F.when(text.contains("%"), F.lit(0.01)).otherwise(F.lit(1.0))
    sign = F.when(text.rlike(r"^[^0-9]*\(.*\)\s*$") | text.rlike(r"^[^0-9]*-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    plain = sign * number * factor * F.when(F.lit(scale == "basis_points"), percent).otherwise(F.lit(1.0))
    if scale == "log10":
        return F.log10(plain)
    if scale == "ln":
        return F.log(plain)
    return plain / F.lit(SCALES[scale])


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, in [0, 1]."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def first_match(col: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str | None) -> Column:
    """Label of the first rule of which any keyword occurs in the lower-cased text."""
    low = F.lower(col)
    out = F.lit(default)
    for label, words in reversed(list(rules)):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def minutes_of_day(col: Column) -> Column:
    """``H:MM`` … ``24:00`` as minutes 0..1440, NULL if it is no time of day."""
    hour = F.regexp_extract(col, r"^\s*(\d{1,2}):(\d{2})\s*$", 1).try_cast("int")
    minute = F.regexp_extract(col, r"^\s*(\d{1,2}):(\d{2})\s*$", 2).try_cast("int")
    total = hour * 60 + minute
    return F.when((minute < 60) & (total <= 1440), total)


def clock(minutes: Column) -> Column:
    m = minutes.cast("int")
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside a lambda an outer expression runs per element."""
    return F.transform(F.array(value), body)[0]
