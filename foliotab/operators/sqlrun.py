"""Read-only SQL over named DataFrames; errors come back as data."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)
_STRING = re.compile(r"'(?:[^']|'')*'")
_NOT_READS = ("Command", "ParsedStatement")


@dataclass(frozen=True)
class SqlResult:
    """``frame`` on success, otherwise ``error``."""

    frame: DataFrame | None
    error: str | None


def read_only(sql: str) -> str | None:
    """Reason to reject by the first word, or None for what may be a single query."""
    text = _STRING.sub("''", _COMMENT.sub(" ", sql)).strip().rstrip(";").strip()
    words = re.findall(r"[A-Za-z_]+", text.lower())
    if not words:
        return "empty statement"
    if ";" in text:
        return "only one statement is allowed"
    if words[0] not in {"select", "with", "from", "values", "table"}:
        return f"only SELECT is allowed, got {words[0].upper()}"
    return None


def writes(spark: SparkSession, sql: str) -> str | None:
    """Name of a command or write anywhere in the parsed statement; nothing is run."""
    jvm = spark._jvm
    kinds = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{k}") for k in _NOT_READS]
    nodes = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while nodes:
        node = nodes.pop()
        if any(k.isInstance(node) for k in kinds):
            return node.nodeName()
        children = node.children()
        nodes.extend(children.apply(i) for i in range(children.size()))
    return None


@contextmanager
def _named(spark: SparkSession, views: Mapping[str, DataFrame]) -> Iterator[None]:
    """The views under their names while a statement is planned; what had these names before comes back."""
    before = {name: spark.table(name) for name in views if spark.catalog.tableExists(name)}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        yield
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
            if name in before and not spark.catalog.tableExists(name):
                before[name].createOrReplaceTempView(name)


def transform_sql(spark: SparkSession, sql: str, views: Mapping[str, DataFrame]) -> SqlResult:
    """Plan ``sql`` over ``views``. Errors of syntax and analysis surface here, before any job runs.

    The statement is parsed first and turned down if any command, insert or other write is part of it.
    """
    reason = read_only(sql)
    if reason:
        return SqlResult(None, reason)
    try:
        kind = writes(spark, sql)
        if kind:
            return SqlResult(None, f"only SELECT is allowed, got {kind}")
        with _named(spark, views):
            return SqlResult(spark.sql(sql), None)
    except PySparkException as ex:
        return SqlResult(None, str(ex))


def sql(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """As ``transform_sql`` for callers that want the exception."""
    out = transform_sql(spark, text, views)
    if out.error:
        raise ValueError(out.error)
    return out.frame
