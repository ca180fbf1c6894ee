"""Filters, sampling, typing and row rules."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException, ParseException

from ..functions.text import empty_test


def filter_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Semi join; Spark broadcasts the id list when its size statistics allow."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def apply_filters(
    df: DataFrame,
    type_: str | None = None,
    types: Sequence[str] | None = None,
    level: int | str | None = None,
    levels: Sequence | None = None,
    ids: DataFrame | None = None,
    columns: tuple[str, str, str] = ("type", "level", "id"),
) -> DataFrame:
    """AND of the given filters; an id list has priority over all of them."""
    kind, lev, key = columns
    if ids is not None:
        return filter_by_ids(df, ids, key)
    if type_ is not None:
        df = df.filter(F.col(kind) == type_)
    if types:
        df = df.filter(F.col(kind).isin(list(types)))
    if level is not None:
        df = df.filter(F.col(lev) == level)
    if levels:
        df = df.filter(F.col(lev).isin(list(levels)))
    return df


def sample_exact(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """min(n, count) rows, the same for any partitioning: the n smallest hashes of (key, seed)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def filter_text(df: DataFrame, predicate: str) -> tuple[DataFrame, str | None]:
    """Filter by a predicate string; an invalid one filters nothing and its message is returned."""
    if not predicate or not predicate.strip():
        return df, None
    try:
        return df.filter(F.expr(predicate)), None
    except (AnalysisException, ParseException) as ex:
        return df, str(ex)


def contains_filters(df: DataFrame, exact: Mapping[str, str], loose: Mapping[str, str]) -> DataFrame:
    """Substring filters: ``exact`` keeps case, ``loose`` ignores it."""
    for col, text in exact.items():
        if text:
            df = df.filter(F.col(col).contains(text))
    for col, text in loose.items():
        if text:
            df = df.filter(F.lower(F.col(col)).contains(text.lower()))
    return df


def search(df: DataFrame, columns: Sequence[str], term: str, key: str, limit: int = 20) -> DataFrame:
    """First ``limit`` hits in key order, each with the number of hits left out."""
    low = term.lower()
    hit = functools.reduce(operator.or_, [F.lower(F.col(c).cast("string")).contains(low) for c in columns])
    hits = df.filter(hit)
    total = hits.agg(F.count("*").alias("n"))
    shown = hits.orderBy(key).limit(limit)
    return shown.join(F.broadcast(total)).withColumn("more", F.greatest(F.col("n") - limit, F.lit(0))).drop("n")


def value_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.endswith(("_quote", "_rationale"))])


# Declared field types.
FIELD_TYPES = {
    "str": "string",
    "int": "bigint",
    "float": "double",
    "decimal": "decimal(38,10)",
    "bool": "boolean",
    "date": "date",
    "enum": "string",
}


def typed(df: DataFrame, fields: Mapping[str, str], enums: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Cast text columns to declared types; what does not fit becomes NULL."""
    out = {}
    for name, kind in fields.items():
        c = F.trim(F.col(name))
        if kind == "enum":
            out[name] = F.when(c.isin(list((enums or {})[name])), c)
        elif kind == "int":
            out[name] = F.when(c.rlike(r"^[+-]?\d+(\.0*)?$"), c.try_cast("decimal(38,10)").try_cast("bigint"))
        elif kind == "bool":
            low = F.lower(c)
            out[name] = F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)
        else:
            out[name] = c.try_cast(FIELD_TYPES[kind])
    return df.withColumns(out)


def normalize_percent(col: Column, rule: str) -> Column:
    """``0_100``: fractions times 100. ``0_1``: percentages over 100. The text's own % sign decides its form."""
    text = F.trim(col.cast("string"))
    number = F.regexp_replace(text, "[%\\s]", "").try_cast("double")
    percent = text.contains("%") | (F.abs(number) > 1)
    if rule == "0_100":
        return F.when(percent, number).otherwise(number * 100)
    if rule == "0_1":
        return F.when(percent, number / 100).otherwise(number)
    raise ValueError(f"unknown percent rule {rule}")


def normalize_date(col: Column, fmt: str, accepted: Sequence[str] = ("yyyy-MM-dd", "MM/dd/yyyy", "d MMM yyyy")) -> Column:
    parsed = F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in accepted])
    return F.date_format(parsed, fmt)


def keep_condition(df: DataFrame, rules: Mapping) -> Column:
    """One boolean column from row rules: drop_row_if, requirements and primary keys."""

    def missing(name: str) -> Column:
        return empty_test(df, name) if name in df.columns else F.lit(True)

    def every(parts: list[Column]) -> Column:
        return functools.reduce(operator.and_, parts, F.lit(True))

    def some(parts: list[Column]) -> Column:
        return functools.reduce(operator.or_, parts, F.lit(False))

    def required(node) -> Column:
        if isinstance(node, str):
            return ~missing(node)
        if "all_of" in node:
            return every([required(n) for n in node["all_of"]])
        return some([required(n) for n in node["any_of"]])

    keep = every([~missing(k) for k in rules.get("primary_keys", [])])
    keep = keep & every([required(r) for r in rules.get("requirements", [])])
    for rule in rules.get("drop_row_if", []):
        if "missing_any_of" in rule:
            keep = keep & ~some([missing(f) for f in rule["missing_any_of"]])
        if "missing_all_of" in rule:
            keep = keep & ~every([missing(f) for f in rule["missing_all_of"]])
    return keep


def drop_row_if(df: DataFrame, rules: Mapping) -> DataFrame:
    return df.filter(keep_condition(df, rules))


def relevant_chunks(chunks: DataFrame, verdicts: DataFrame, keys: Sequence[str], flag: str = "relevant") -> DataFrame:
    """Chunks judged relevant; ids stay as they were."""
    yes = verdicts.filter(F.col(flag)).select(*keys).distinct()
    return chunks.join(yes, list(keys), "left_semi")

