"""Simulation series: wide CSV with a time column to (time, series, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def series_long(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Every numeric column but the ids as rows; other columns are left out."""
    cols = [f.name for f in wide.schema.fields if f.name not in ids and isinstance(f.dataType, T.NumericType)]
    return wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(list(ids), cols, "series", "value")


# Time formats in the order they are tried.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "d MMM yyyy"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def parse_time(text: Column, year: int = 2000) -> Column:
    """``MM/DD  HH:MM:SS`` (24:00:00 is the next day), a month name, or a full timestamp; else NULL."""
    t = F.trim(text)
    form = r"^(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?$"
    part = lambda i: F.regexp_extract(t, form, i).try_cast("int")
    day = F.try_to_timestamp(F.concat(F.lit(f"{year}-"), F.lpad(part(1).cast("string"), 2, "0"), F.lit("-"), F.lpad(part(2).cast("string"), 2, "0")), F.lit("yyyy-MM-dd"))
    short = (day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), part(3), part(4), F.coalesce(part(5), F.lit(0)))).cast("timestamp_ntz")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(t))
    named = F.when(month > 0, F.make_timestamp_ntz(F.lit(year), month.cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    full = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS]).cast("timestamp_ntz")
    return F.coalesce(short, named, full)


def read_series(spark: SparkSession, path: str, year: int = 2000) -> DataFrame:
    """(file, row, time, series, unit, value); rows whose time does not parse keep time NULL and their row number.

    Every file has its own header, so a folder may mix files of different columns. Cells may be quoted and hold commas.
    Rows of another number of cells than their header (summary rows at the end) are left out. The time column is the one
    called date/time, time or datetime, else the first.
    """
    from .readers import number_lines_of, text_lines

    lines = number_lines_of(text_lines(spark, path)).select("file", "line", csv_cells(F.col("text")).alias("c"))
    lowered = F.transform("c", lambda x: F.lower(F.trim(x)))
    stamp = F.greatest(F.array_position(F.transform(lowered, lambda x: x.isin("date/time", "time", "datetime")), True), F.lit(1)) - 1
    heads = lines.filter("line = 1").select("file", F.col("c").alias("names"), stamp.cast("int").alias("stamp"))
    rows = lines.filter("line > 1").join(heads, "file").filter(F.size("c") == F.size("names")).select("file", (F.col("line") - 2).alias("row"), "c", "names", "stamp")
    cells = F.filter(F.transform("names", lambda n, i: F.struct(n.alias("name"), F.get("c", i).alias("v"), i.alias("i"))), lambda x: x["i"] != F.col("stamp"))
    rows = rows.withColumn("time", parse_time(F.get("c", F.col("stamp")), year))
    out = rows.select("file", "row", "time", F.inline(cells)).withColumn("value", F.trim("v").try_cast("double")).filter("value is not null")
    unit = F.regexp_extract("name", r"\[([^\]]*)\](?:\([^)]*\))?\s*$", 1)
    return out.select("file", "row", "time", F.trim(F.regexp_replace("name", r"\s*\[[^\]]*\](\([^)]*\))?\s*$", "")).alias("series"), unit.alias("unit"), "value")


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line; a cell in double quotes may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    plain = lambda x: F.when(x.rlike('^".*"$'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(raw, plain)
