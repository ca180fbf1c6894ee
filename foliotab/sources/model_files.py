"""Model files (object text) and output dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ordered
from ..operators.outputs import resource_type
from .readers import number_lines_of, text_lines


def parse_model_lines(lines: DataFrame, keys: Sequence[str] = ("model",), line: str = "line", text: str = "text", width: int | None = None) -> DataFrame:
    """Lines of object text to (model…, obj_type, obj_idx, field_idx, field_name, value).

    ``!`` starts a comment, ``,`` ends a field, ``;`` ends an object; ``!- Name {unit}`` names the last field of
    its line. The first value of an object is its type.
    """
    data = F.split(F.col(text), "!", 2)[0]
    comment = F.regexp_extract(text, r"!-\s*(.*?)\s*(?:\{[^}]*\}\s*)?$", 1)
    values = F.regexp_extract_all(data, F.lit(r"([^,;]*)([,;])"), F.lit(1))
    ends = F.regexp_extract_all(data, F.lit(r"([^,;]*)([,;])"), F.lit(2))
    zipped = F.zip_with(values, ends, lambda v, e: F.struct(F.trim(v).alias("v"), (e == ";").alias("stop")))
    t = lines.select(*keys, line, comment.alias("__c"), F.size(values).alias("__n"), F.posexplode(zipped).alias("__p", "__t"))
    t = t.select(*keys, line, "__p", F.col("__t.v").alias("value"), F.col("__t.stop").cast("bigint").alias("__stop"), F.when((F.col("__p") == F.col("__n") - 1) & (F.col("__c") != ""), F.col("__c")).alias("__name"))
    t = ordered.running_sum(t, keys, line, {"__ends": F.col("__stop")}, ["__p"], width)
    t = t.withColumn("obj_idx", F.col("__ends") - F.col("__stop"))
    # values of one object: bounded by the object's own size
    start = t.groupBy(*keys, "obj_idx").agg(F.min(F.struct(line, "__p", "value")).alias("__s"))
    t = t.join(start, [*keys, "obj_idx"])
    order = F.struct(line, "__p")
    from pyspark.sql import Window

    t = t.withColumn("field_idx", F.row_number().over(Window.partitionBy(*keys, "obj_idx").orderBy(order)) - 2)
    name = F.coalesce(F.regexp_replace("__name", r"[^A-Za-z0-9]+", "_"), F.concat(F.lit("Field_"), (F.col("field_idx") + 1).cast("string")))
    return t.filter("field_idx >= 0").select(*keys, F.col("__s.value").alias("obj_type"), "obj_idx", "field_idx", F.regexp_replace(name, "_$", "").alias("field_name"), "value")


def read_model_objects(spark: SparkSession, path: str) -> DataFrame:
    lines = number_lines_of(text_lines(spark, path)).withColumnRenamed("file", "model")
    return parse_model_lines(lines)


def parse_meter_dictionary(lines: DataFrame, keys: Sequence[str] = ("file",), line: str = "line", text: str = "text") -> DataFrame:
    """Meters of either form: ``Output:Meter,name,freq; !- [unit]`` or CSV ``type,Meter,name [unit]``.

    A file with any object line is read in the object form. The first line of a name stays.
    """
    s = F.trim(text)
    objects = lines.filter(s.startswith("Output:Meter")).select(*keys).distinct().withColumn("__obj", F.lit(True))
    l = lines.join(objects, list(keys), "left").withColumn("__s", s)
    o = l.filter(F.col("__obj") & F.col("__s").startswith("Output:Meter,"))
    form = r"^Output:Meter,([^,]*),([^;,]*)"
    o = o.select(*keys, line, F.trim(F.regexp_extract("__s", form, 1)).alias("name"), F.trim(F.regexp_extract("__s", r"!-[^\[]*\[([^\]]*)\]", 1)).alias("unit"), F.lit("Zone").alias("var_type"), F.trim(F.regexp_extract("__s", form, 2)).alias("frequency"))
    head = l.filter(F.col("__obj").isNull() & F.col("__s").contains("Var Type") & F.col("__s").contains("Variable Name")).groupBy(*keys).agg(F.min(line).alias("__from"))
    c = l.filter(F.col("__obj").isNull()).join(head, list(keys)).filter(F.col(line) > F.col("__from"))
    cells = F.split("__s", ",")
    c = c.filter((F.size(cells) >= 3) & (F.lower(F.trim(F.get(cells, F.lit(1)))) == "meter"))
    full = F.trim(F.get(cells, F.lit(2)))
    c = c.select(*keys, line, F.trim(F.regexp_replace(full, r"\[[^\[]*$", "")).alias("name"), F.trim(F.regexp_extract(full, r"\[([^\[\]]*)\]?$", 1)).alias("unit"), F.trim(F.get(cells, F.lit(0))).alias("var_type"), F.lit("hourly").alias("frequency"))
    return _first_by_name(o.unionByName(c), keys, line).withColumn("resource_type", resource_type(F.col("name")))


def parse_variable_dictionary(lines: DataFrame, keys: Sequence[str] = ("file",), line: str = "line", text: str = "text") -> DataFrame:
    """Variables of either form: ``Output:Variable,key,name,freq; !- … [unit]`` or CSV ``type,report,name [unit]``."""
    s = F.trim(text)
    l = lines.withColumn("__s", s)
    form = r"^Output:Variable,([^,]*),([^,]*),([^;,]*)"
    o = l.filter(F.col("__s").startswith("Output:Variable,"))
    o = o.select(*keys, line, F.trim(F.regexp_extract("__s", form, 2)).alias("name"), F.trim(F.regexp_extract("__s", r"!-[^\[]*\[([^\]]*)\]", 1)).alias("unit"), F.trim(F.regexp_extract("__s", r"!-\s*(\S+)", 1)).alias("var_type"), F.trim(F.regexp_extract("__s", form, 3)).alias("frequency"))
    cells = F.split("__s", ",")
    report = F.lower(F.trim(F.get(cells, F.lit(1))))
    c = l.filter(~F.col("__s").startswith("Output:") & ~F.col("__s").startswith("!") & (F.size(cells) >= 3) & report.isin("average", "sum"))
    full = F.trim(F.get(cells, F.lit(2)))
    c = c.select(*keys, line, F.trim(F.regexp_replace(full, r"\[[^\[]*$", "")).alias("name"), F.trim(F.regexp_extract(full, r"\[([^\[\]]*)\]?$", 1)).alias("unit"), F.trim(F.get(cells, F.lit(0))).alias("var_type"), F.lit("hourly").alias("frequency"))
    return _first_by_name(o.unionByName(c), keys, line)


def _first_by_name(rows: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    return ordered.best_row(rows.filter("name <> ''"), [*keys, "name"], F.col(line), largest=False).drop(line)


def read_meter_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return parse_meter_dictionary(number_lines_of(text_lines(spark, path))).orderBy("file", "name")


def read_variable_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return parse_variable_dictionary(number_lines_of(text_lines(spark, path))).orderBy("file", "name")
