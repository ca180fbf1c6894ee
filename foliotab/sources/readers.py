"""Readers for datasets, logs, results and documents.

Text is read line by line in file blocks, so one large file spreads over many tasks. A line's number comes from
its block's position in the file and its order inside the block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ordered


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """By suffix: .jsonl (blank lines are skipped), .json (one object or a list), .csv (with header)."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix == "jsonl":
        return reader.json(path)
    if suffix == "json":
        return reader.option("multiLine", True).json(path)
    if suffix == "csv":
        return (reader if schema is not None else reader.option("inferSchema", True)).option("header", True).csv(path)
    raise ValueError(f"unsupported dataset suffix: .{suffix}")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, pos, text): ``pos`` grows along a block."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("text")
    )


def number_lines_of(lines: DataFrame) -> DataFrame:
    """1-based ``line`` per file: rank inside the block plus the lines of the blocks before it."""
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("pos"))
    return lines.withColumn("__k", rank).join(offsets, ["file", "block"]).select("file", (F.col("__o") + F.col("__k")).alias("line"), "text")


def read_json_or_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines and of whole JSON texts, decided for each file; a line may hold one object or a list of them.

    A file whose first filled line is a JSON value is read by lines, any other one as a whole. A line that is not JSON, or a
    whole text that is not, fails with the number of the first bad line.
    Only files with a bad line are gathered to one row, as a JSON text over many lines has to be.
    """
    kind = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">")
    numbered = number_lines_of(text_lines(spark, path)).filter(F.trim("text") != "").withColumn("ok", F.try_parse_json("text").isNotNull())
    bad = numbered.groupBy("file").agg(F.min(F.when(~F.col("ok"), F.col("line"))).alias("bad_line"), F.min_by("ok", "line").alias("by_lines")).filter("bad_line is not null")
    lines = numbered.join(bad, "file", "left_anti").select("text", F.lit(None).cast("string").alias("why"))
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).join(bad, "file")
    why = F.when(F.col("by_lines") | F.try_parse_json("text").isNull(), F.concat(F.lit("bad JSON in line "), F.col("bad_line").cast("string"), F.lit(" of "), F.col("file")))
    texts = lines.unionByName(whole.select("text", why.alias("why")))
    checked = F.when(F.col("why").isNotNull(), F.raise_error(F.col("why"))).otherwise(F.trim("text"))
    items = F.when(checked.startswith("["), F.from_json(checked, f"array<struct<{kind}>>")).otherwise(F.array(F.from_json(checked, f"struct<{kind}>")))
    return texts.select(F.inline(items))


def parse_event_lines(lines: DataFrame, schema: T.StructType | str, keys: Sequence[str] = ("file",), line: str = "line", text: str = "text") -> DataFrame:
    """One row per line. A line that is no JSON object becomes a row ``event = parse_error`` with error and raw text."""
    body = lines.filter(F.trim(text) != "")
    good = F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{")
    body = body.withColumn("__ok", F.coalesce(good, F.lit(False))).withColumn("__r", F.from_json(text, schema))
    names = [f.name for f in body.schema["__r"].dataType.fields]
    cols = [F.when(F.col("__ok"), F.col(f"__r.{n}")).otherwise("parse_error" if n == "event" else F.lit(None)).alias(n) for n in names]
    return body.select(
        *keys, F.col(line).alias("__line_number"), *cols, F.when(~F.col("__ok"), "invalid JSON").alias("error_text"), F.when(~F.col("__ok"), F.col(text)).alias("raw")
    )


def read_events(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return parse_event_lines(number_lines_of(text_lines(spark, path)), schema)


def join_physical_lines(lines: DataFrame, keys: Sequence[str] = ("file",), order: str = "line", text: str = "text", width: int | None = None) -> DataFrame:
    """Records of a log whose messages hold line breaks: a record ends with a line that ends in ``"}``."""
    ends = F.when(F.rtrim(text).endswith('"}'), 1).otherwise(0).cast("bigint")
    seen = ordered.running_sum(lines.withColumn("__end", ends), keys, order, {"__upto": F.col("__end")}, width=width)
    seen = seen.withColumn("record", F.col("__upto") - F.col("__end"))
    part = F.struct(order, text)
    return seen.groupBy(*keys, "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p[text]), "\n").alias("record_text"),
        F.min(order).alias("start_line"),
        F.max(order).alias("end_line"),
        (F.max("__end") == 1).alias("complete"),
    )


def parse_multiline_log(lines: DataFrame, schema: T.StructType | str, keys: Sequence[str] = ("file",), order: str = "line", text: str = "text", preview: int = 200, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Parsed records and a table of those that do not parse, an incomplete tail included.

    Double quotes inside ``message`` become single ones and its line breaks are escaped before parsing.
    """
    r = join_physical_lines(lines, keys, order, text, width)
    form = r'(?s)^(.*"message":\s*")(.*)("\s*\}\s*)$'
    inner = F.regexp_extract("record_text", form, 2)
    safe = F.replace(F.replace(F.replace(inner, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit("\\n"))
    fixed = F.when(F.col("record_text").rlike(form), F.concat(F.regexp_extract("record_text", form, 1), safe, F.regexp_extract("record_text", form, 3))).otherwise(F.col("record_text"))
    r = r.withColumn("fixed", fixed).withColumn("ok", F.coalesce(F.col("complete") & F.try_parse_json("fixed").isNotNull(), F.lit(False)))
    rows = r.filter("ok").select(*keys, "start_line", "end_line", F.from_json("fixed", schema).alias("r")).select(*keys, "start_line", "end_line", "r.*")
    why = F.when(F.col("complete"), "invalid JSON").otherwise("incomplete record")
    errors = r.filter("not ok").select(*keys, "start_line", "end_line", why.alias("error"), F.substring("record_text", 1, preview).alias("preview"))
    return rows, errors


def read_multiline_log(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    return parse_multiline_log(number_lines_of(text_lines(spark, path)), schema)


def parse_results(files: DataFrame, result: str, metadata: str, text: str = "text", keys: Sequence[str] = ("file",), order: str | None = None) -> DataFrame:
    """Results files of three shapes: ``[[results],[metadata]]``, ``[results]``, ``{results, metadata}``; keys stay in the rows.

    ``result`` and ``metadata`` are DDL structs; the result struct has ``question_id``. Result and metadata pair up
    by position; where a file has no metadata list, an item's own ``metadata`` counts. Of a question that a file (a run)
    holds twice the first one stays; each run keeps its own.
    """
    t = F.ltrim(text)
    pair = F.from_json(t, "array<string>")
    nested, flat = t.rlike(r"^\[\s*\["), t.rlike(r"^\[")
    obj = F.from_json(t, "struct<results: string, metadata: string, all_metadata: string, misc_question_metadata: string>")
    r = F.when(nested, F.get(pair, F.lit(0))).when(flat, t).otherwise(obj["results"])
    m = F.when(nested, F.get(pair, F.lit(1))).when(~flat, F.coalesce(obj["metadata"], obj["all_metadata"], obj["misc_question_metadata"]))
    own = F.transform(F.from_json(r, f"array<struct<metadata: {metadata}>>"), lambda x: x["metadata"])
    both = F.arrays_zip(F.from_json(r, f"array<{result}>").alias("r"), F.coalesce(F.from_json(m, f"array<{metadata}>"), own).alias("m"))
    rows = files.select(*keys, *([order] if order else []), F.posexplode(both).alias("pos", "x")).filter("x.r is not null")
    rows = rows.select(*keys, *([order] if order else []), "pos", "x.r.*", F.col("x.m").alias("metadata"))
    first = [F.col(order)] if order else []
    return ordered.best_row(rows, [*keys, "question_id"], F.struct(*first, F.col("pos")), largest=False)


def read_results(spark: SparkSession, path: str, result: str, metadata: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return parse_results(files, result, metadata)


def read_documents(spark: SparkSession, path: str, globs: Sequence[str] = ("*.md", "*.txt")) -> DataFrame:
    """One row per file, .md before .txt; bytes that are no UTF-8 are replaced."""
    out = None
    for rank, g in enumerate(globs):
        d = spark.read.option("pathGlobFilter", g).option("recursiveFileLookup", True).format("binaryFile").load(path)
        d = d.select(F.element_at(F.split("path", "/"), -1).alias("document_name"), F.col("path").alias("file_path"), F.lit(rank).alias("rank"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
        out = d if out is None else out.unionByName(d)
    return out


def explode_document_map(rows: DataFrame, text: str, keys: Sequence[str], content_only: Column) -> DataFrame:
    """``{name: {content, result}}`` to one row per document; result is appended unless the row asks for content only."""
    m = F.from_json(text, "map<string, struct<content: string, result: string>>")
    e = rows.select(*keys, content_only.alias("__only"), F.explode(m).alias("document_name", "d"))
    full = F.when(F.col("__only") | F.col("d.result").isNull(), F.col("d.content")).otherwise(F.concat("d.content", "d.result"))
    return e.select(*keys, "document_name", full.alias("content"))


def resolve_documents(questions: DataFrame, files: DataFrame, key: str = "question_id", docs: str = "doc", name: str = "name", prefix: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """First file, in name order, that matches ``*<prefix><name>*.txt`` for each wanted name; missing ones are error rows.

    ``prefix`` may depend on the question, such as a year for one level.
    """
    from ..functions.matching import contains_join

    want = questions.select(key, prefix.alias("__p") if prefix is not None else F.lit("").alias("__p"), F.explode(docs).alias("wanted"))
    want = want.withColumn("__w", F.concat("__p", "wanted")).drop("__p")
    texts = files.filter(F.col(name).endswith(".txt")).select(F.col(name).alias("file"))
    hits = contains_join(want.select("__w").distinct(), "__w", texts, "file", size=5)
    before = hits.filter(F.expr("instr(file, __w) + length(__w) - 1 <= length(file) - 4"))
    first = before.groupBy("__w").agg(F.min("file").alias("file"))
    j = want.join(first, "__w", "left").drop("__w")
    missing = j.filter("file is null").select(key, "wanted", F.concat(F.lit("no file for "), "wanted").alias("error"))
    return j.filter("file is not null").select(key, "wanted", "file"), missing


def backfill_ids(df: DataFrame, id_: str, order: Sequence[str]) -> DataFrame:
    """Rows without an id get their 0-based position as text."""
    p = ordered.global_position(df, order, "__pos")
    return p.withColumn(id_, F.coalesce(F.col(id_).cast("string"), (F.col("__pos") - 1).cast("string"))).drop("__pos")


def inline_documents(rows: DataFrame, key: str, documents: str = "documents", context: str = "context") -> tuple[DataFrame, DataFrame]:
    """Documents inside a row: an object, a list of texts or objects, else one context text; none is an error row."""
    t = F.ltrim(documents)
    as_map = F.transform(F.map_entries(F.from_json(t, "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("text")))
    item = lambda x, i: F.struct(
        F.coalesce(F.when(F.ltrim(x).startswith("{"), F.get_json_object(x, "$.name")), F.concat(F.lit("document_"), (i + 1).cast("string"))).alias("name"),
        F.when(F.ltrim(x).startswith("{"), F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.content"))).otherwise(x).alias("text"),
    )
    as_list = F.transform(F.from_json(t, "array<string>"), item)
    one = F.array(F.struct(F.lit("context").alias("name"), F.col(context).alias("text")))
    docs = F.when(t.startswith("{"), as_map).when(t.startswith("["), as_list).when(F.coalesce(F.col(context), F.lit("")) != "", one)
    r = rows.withColumn("__d", docs)
    out = r.filter(F.size("__d") > 0).select(key, F.posexplode("__d").alias("pos", "d")).select(key, "pos", "d.name", "d.text")
    errors = r.filter(F.coalesce(F.size("__d"), F.lit(0)) <= 0).select(key, F.lit("no documents").alias("error"))
    return out, errors


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and time of the files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


# Output file patterns by category, in order.
OUTPUT_PATTERNS = [
    ("summary_reports", ["Table.html", "Table.htm", "Table.csv", "Summary.csv"]),
    ("time_series_outputs", [".csv", ".eso", ".mtr"]),
    ("error_files", [".err", ".audit", ".bnd"]),
]


def classify_outputs(files: DataFrame, name: str = "name") -> DataFrame:
    cat = F.lit("other_files")
    for label, tails in reversed(OUTPUT_PATTERNS):
        hit = F.lit(False)
        for x in tails:
            hit = hit | F.col(name).endswith(x)
        cat = F.when(hit, label).otherwise(cat)
    ext = F.regexp_extract(name, r"(\.[^./]+)$", 1)
    return files.withColumns({"category": cat, "extension": F.lower(ext)})


def tail(log: DataFrame, order: str, n: int, error: Column | None = None) -> DataFrame:
    """Last n lines (of the error lines only, if ``error`` is given) with total and shown counts."""
    body = log.filter(error) if error is not None else log
    total = body.agg(F.count("*").alias("total"))
    last = body.orderBy(F.col(order).desc()).limit(n)
    return last.join(F.broadcast(total)).withColumn("shown", F.least(F.col("total"), F.lit(n)))
