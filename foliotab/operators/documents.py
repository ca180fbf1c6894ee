"""Document preparation: tables, headers, chunks, pages, context.

A document is one row, so work inside it uses array functions on that row and needs no shuffle; passes that carry a state
from line to line run on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds, ordered
from ..functions.text import bound
from ..session import ship_by_value

for _module in (__name__, folds.__name__):
    ship_by_value(_module)


def _lines(text: str | Column) -> Column:
    return F.split(F.col(text) if isinstance(text, str) else text, "\n", -1)


def _join(parts: Column, sep: str = "\n") -> Column:
    return F.array_join(parts, sep)


def tag_tables(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pipe tables cut out of the text: ``tagged`` keeps ``<table id='i'>`` lines, ``tables`` holds their texts.

    A table starts at the first pipe of a line with two pipes and goes on over following lines that start with
    a pipe and have another one; the last line of a text has no line end and is never part of one.
    """

    def body(ls):
        last = F.size(ls) - 1
        row = lambda i: (i >= 0) & (i < last) & F.get(ls, i).rlike(r"\|[^\n]*\|")
        goes_on = lambda i: row(i) & row(i - 1) & F.get(ls, i).startswith("|")
        index = F.sequence(F.lit(0), last)
        flags = F.transform(index, lambda i: F.when(goes_on(i), 2).when(row(i), 1).otherwise(0))

        def with_flags(fl):
            starts = F.filter(index, lambda i: F.get(fl, i) == 1)

            def with_starts(st):
                line = lambda i: F.get(ls, i)
                pipe = lambda s: F.instr(s, "|")
                nl = lambda i: F.when(i < last, "\n").otherwise("")
                tag = lambda i: F.concat(F.substring(line(i), F.lit(1), pipe(line(i)) - 1), F.lit("<table id='"), (F.array_position(st, i) - 1).cast("string"), F.lit("'>\n"))
                out = F.transform(index, lambda i: F.when(F.get(fl, i) == 0, F.concat(line(i), nl(i))).when(F.get(fl, i) == 1, tag(i)).otherwise(""))

                def table(s, k):
                    end = F.coalesce(F.get(st, k + 1), last + 1)
                    inner = F.filter(F.sequence(s + 1, F.greatest(end - 1, s + 1)), lambda j: (j < end) & (F.get(fl, j) == 2))
                    first = F.substring(line(s), pipe(line(s)), F.length(line(s)))
                    return F.concat(first, F.lit("\n"), _join(F.transform(inner, lambda j: F.concat(line(j), F.lit("\n"))), ""))

                tables = F.transform(st, lambda s, k: F.struct(k.cast("int").alias("table_idx"), F.concat(F.lit("<table id='"), k.cast("string"), F.lit("'>")).alias("tag"), table(s, k).alias("table_text")))
                return F.struct(_join(out, "").alias("tagged"), tables.alias("tables"))

            return bound(starts, with_starts)

        return bound(flags, with_flags)

    return docs.withColumn("__t", bound(_lines(text), body)).select(*docs.columns, "__t.tagged", "__t.tables")


def tag_line_ranges(docs: DataFrame, ranges: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Line ranges ``(key, idx, first, last, notes)``, 0-based inclusive, replaced by tags; texts kept in ``tables``."""
    valid = ranges.filter(F.col("first").isNotNull() & F.col("last").isNotNull())
    per = valid.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "last", "idx", "notes"))).alias("__r"))
    j = docs.join(per, key, "left").withColumn("__r", F.coalesce("__r", F.array().cast(per.schema["__r"].dataType)))

    def body(ls):
        within = lambda i: F.exists("__r", lambda r: (r["first"] < i) & (i <= r["last"]))
        starts = lambda i: F.filter("__r", lambda r: r["first"] == i)
        keep = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: ~within(i))
        tag = lambda r: F.concat(F.lit("<table id='"), r["idx"].cast("string"), F.lit("'>"))
        out = F.transform(keep, lambda i: F.when(F.size(starts(i)) > 0, tag(starts(i)[0])).otherwise(F.get(ls, i)))

        def table(r):
            body_ = _join(F.slice(ls, r["first"].cast("int") + 1, (r["last"] - r["first"]).cast("int") + 1))
            noted = F.concat(F.lit("Table "), (r["idx"] + 1).cast("string"), F.lit(" NOTE: "), r["notes"], F.lit("\n\n"), body_, F.lit("\n\n"))
            return F.struct(r["idx"].alias("table_idx"), tag(r).alias("tag"), F.when(F.coalesce(r["notes"], F.lit("")) != "", noted).otherwise(body_).alias("table_text"))

        return F.struct(_join(out).alias("tagged"), F.transform("__r", table).alias("tables"))

    return j.withColumn("__t", bound(_lines(text), body)).select(*docs.columns, "__t.tagged", "__t.tables")


def clean_table_ranges(specs: DataFrame, ranges: str = "ranges") -> DataFrame:
    """Ordered fold over each row's array of (first, last): bad bounds and overlaps with the last kept one go; 0-based."""
    ok = F.filter(ranges, lambda r: (r["first"] >= 1) & (r["last"] >= 1))
    start = F.struct(F.lit(-1).cast("bigint").alias("end"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("kept"))

    def step(acc, r):
        first, last = r["first"].cast("bigint"), r["last"].cast("bigint")
        taken = F.array_append(acc["kept"], F.struct((first - 1).alias("first"), (last - 1).alias("last")))
        # the kept end is 0-based already when the next 1-based start is compared with it
        return F.when((acc["end"] >= 0) & (acc["end"] > first), acc).otherwise(F.struct((last - 1).alias("end"), taken.alias("kept")))

    return specs.withColumn(ranges, F.aggregate(ok, start, step)["kept"])


def untag(chunks: DataFrame, content: str = "content", tables: str = "tables") -> DataFrame:
    """Table texts back in place of their tags."""
    return chunks.withColumn(content, F.aggregate(tables, F.col(content), lambda acc, t: F.replace(acc, t["tag"], t["table_text"])))


def _lists(texts: pa.Array, kind: pa.DataType, rows: Callable[[str], list[dict]], some: int = 64) -> pa.Array:
    """A list of rows per text, a NULL one without any. Only some texts' rows are Python objects at a time."""
    parts = [pa.array([rows(t.as_py()) if t.is_valid else [] for t in texts[at : at + some]], kind) for at in range(0, len(texts), some)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def split_headers(docs: DataFrame, text: str = "text", strip_headers: bool = False) -> DataFrame:
    """Sections at markdown headers; ``metadata`` maps "Header k" to the active title of that level.

    One pass over the lines with a stack of active titles. A null text has no sections.
    """
    kind = pa.list_(pa.struct([("content", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))]))

    @F.arrow_udf("array<struct<content string, metadata map<string, string>>>")
    def sections(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _lists(texts, kind, lambda t: [{"content": c, "metadata": m} for c, m in folds.header_sections(t, strip_headers)])

    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(sections(F.col(text))).alias("section", "s")).select(*keep, "section", "s.content", "s.metadata")


def split_recursive(docs: DataFrame, text: str, size: int, overlap: int = 0) -> DataFrame:
    """Cut at blank lines, then at ".\\n" inside what is still too long, and pack pieces up to ``size`` characters.

    A piece that stays too long is a chunk of its own; packing never runs across it. ``overlap`` repeats the last
    pieces of a chunk, up to that many characters, in the next one. One pass over the pieces. A null text has no chunks.
    """
    kind = pa.list_(pa.struct([("t", pa.string()), ("long", pa.bool_())]))

    @F.arrow_udf("array<struct<t string, long boolean>>")
    def chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _lists(texts, kind, lambda t: [{"t": c, "long": x} for c, x in folds.packed(t, size, overlap)])

    trimmed = F.transform(chunks(F.col(text)), lambda c: F.when(c["long"], c["t"]).otherwise(F.regexp_replace(c["t"], r"^\s+|\s+$", "")))
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(F.filter(trimmed, lambda c: c != "")).alias("chunk_id", "content"))


def merge_adjacent(chunks: DataFrame, size: int, key: str = "doc_id", order: str = "chunk_id") -> DataFrame:
    """Greedy merge of neighbours while last + this <= size (joiner not counted); metadata values become lists.

    ``metadata`` is MAP<STRING, ARRAY<STRING>>. The chunks of one document are what one document row held.
    """
    by_order = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)
    per = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "content", "metadata")), by_order).alias("cs"))

    def pack(cs):
        length = lambda i: F.length(F.get(cs, i)["content"])
        zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))

        def step(acc, i):
            fits = (F.size(acc["starts"]) > 0) & (acc["n"] + length(i) <= size)
            return F.when(fits, F.struct((acc["n"] + 2 + length(i)).alias("n"), acc["starts"].alias("starts"))).otherwise(
                F.struct(length(i).alias("n"), F.array_append(acc["starts"], i).alias("starts"))
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(cs) - 1), zero, step)["starts"]

    def merged(cs):
        def groups(st):
            def one(s, k):
                part = F.slice(cs, s + 1, F.coalesce(F.get(st, k + 1), F.size(cs)) - s)
                keys = F.array_distinct(F.flatten(F.transform(part, lambda c: F.map_keys(c["metadata"]))))
                values = lambda x: F.flatten(F.transform(part, lambda c: F.coalesce(F.try_element_at(c["metadata"], x), F.array().cast("array<string>"))))
                meta = F.map_from_arrays(keys, F.transform(keys, values))
                return F.struct(_join(F.transform(part, lambda c: c["content"]), "\n\n").alias("content"), meta.alias("metadata"))

            return F.transform(st, one)

        return bound(pack(cs), groups)

    out = per.select(key, F.posexplode(bound(F.col("cs"), merged)).alias(order, "m"))
    return out.select(key, order, "m.content", "m.metadata")


def breadcrumbs(chunks: DataFrame) -> DataFrame:
    """Header lines that the chunk does not already start with go in front, each with ``...``; values join by " > "."""
    levels = F.sequence(F.lit(1), F.lit(6))
    heads = F.flatten(
        F.transform(
            levels,
            lambda k: F.transform(
                F.coalesce(F.try_element_at("metadata", F.concat(F.lit("Header "), k.cast("string"))), F.array().cast("array<string>")),
                lambda v: F.concat(F.repeat(F.lit("#"), k), F.lit(" "), v),
            ),
        )
    )
    found = F.regexp_extract("content", r"(#+[^\n]*)", 1)

    def prefix(hs):
        at = F.array_position(hs, found)
        before = F.when(at > 0, F.slice(hs, F.lit(1), at.cast("int") - 1)).otherwise(hs)
        inside = _join(F.transform(before, lambda h: F.concat(h, F.lit("\n...\n"))), "")
        return F.when(found != "", inside).otherwise(F.concat(_join(hs), F.lit("\n...\n")))

    flat = F.transform_values("metadata", lambda k, v: F.array_join(v, " > "))
    return chunks.withColumns({"content": F.concat(bound(heads, prefix), "content"), "metadata": flat})


def paginate(docs: DataFrame, text: str, page_tokens: int, chars_per_token: int = 4) -> DataFrame:
    """Pages of a fixed size with their start offset; size <= 0 or an empty text gives one page. One pass per text."""
    step = page_tokens * chars_per_token
    whole = F.array(F.coalesce(F.col(text), F.lit("")))
    pages = whole
    if step > 0:
        pages = F.when(F.length(text) > 0, F.regexp_extract_all(F.col(text), F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))).otherwise(whole)
    keep = [c for c in docs.columns if c != text]
    out = docs.select(*keep, F.posexplode(pages).alias("page", "content"))
    return out.withColumn("start", F.col("page") * max(step, 0))


def number_lines(text: Column) -> Column:
    """1-based number before each line; an empty line gets the number only."""
    tail = text.endswith("\n")
    lines = F.split(text, "\n", -1)
    kept = F.when(tail, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    numbered = F.transform(kept, lambda s, i: F.when(F.rtrim(s) == "", F.concat((i + 1).cast("string"), s)).otherwise(F.concat((i + 1).cast("string"), F.lit(" "), s)))
    return F.when(text == "", "").otherwise(F.concat(_join(numbered), F.when(tail, "\n").otherwise("")))


def doc_title(text: Column, file_name: Column) -> Column:
    """First of the first five lines that starts with ``#``, without its marks; else the file's name."""
    first = F.get(F.filter(F.slice(F.split(text, "\n", -1), 1, 5), lambda s: s.startswith("#")), F.lit(0))
    title = F.trim(F.regexp_replace(first, "^#+", ""))
    return F.coalesce(F.when(title != "", title), F.element_at(F.split(file_name, "/"), -1))


def with_context(chunks: DataFrame, keys: Sequence[str], order: str, text: str, size: int, ratio: float, cap: bool = True, width: int | None = None) -> DataFrame:
    """Text of the chunk before and after; one longer than size * ratio keeps its first ``ratio`` part; ends get ""."""
    out = ordered.neighbours(chunks, keys, order, {"previous_context": F.col(text)}, {"next_context": F.col(text)}, width=width)
    for c in ("previous_context", "next_context"):
        n = F.length(c)
        short = F.substring(F.col(c), F.lit(1), F.floor(n * ratio).cast("int"))
        v = F.when(n > size * ratio, short).otherwise(F.col(c)) if cap else F.col(c)
        out = out.withColumn(c, F.coalesce(v, F.lit("")))
    return out


def running_context(chunks: DataFrame, keys: Sequence[str], order: str, summary: str) -> DataFrame:
    """Summaries of chunks 0..i (forward) and i..n (backward).

    The output repeats every summary in each later (earlier) row, so it is meant for short summaries. Each row is
    built from its document's summary list, which is gathered once per document.
    """
    per = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, summary))).alias("all"))
    rows = per.select(*keys, "all", F.posexplode("all").alias("i", "c"))
    texts = F.transform("all", lambda x: x[summary])
    return rows.select(
        *keys,
        F.col(f"c.{order}").alias(order),
        _join(F.slice(texts, F.lit(1), F.col("i") + 1)).alias("forward_context"),
        _join(F.slice(texts, F.col("i") + 1, F.size("all") - F.col("i"))).alias("backward_context"),
    )


def index_chunks(chunks: DataFrame, doc: str, chunk: str, version: str) -> DataFrame:
    """Stable id, source, index and total; of several versions of an id the last one written stays."""
    ident = F.concat(F.col(doc).cast("string"), F.lit("__chunk_"), F.col(chunk).cast("string"))
    one = ordered.best_row(chunks.withColumn("id", ident), ["id"], F.col(version))
    total = one.groupBy(doc).agg(F.count("*").alias("total"))
    return one.join(total, doc)


def add_missing(chunks: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Existing rows, and the chunks whose id is new."""
    return existing.unionByName(chunks.join(existing.select(key), key, "left_anti"))


def parse_pipe_table(tables: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Cells of markdown tables: (row, col, header, value); the rule line is skipped."""
    rows = F.filter(F.split(text, "\n"), lambda s: (F.trim(s) != "") & ~s.rlike(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"))
    cells = F.transform(rows, lambda s: F.transform(F.split(F.regexp_replace(F.trim(s), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    t = tables.select(*keys, cells.alias("cells")).filter(F.size("cells") > 0)
    t = t.select(*keys, F.col("cells")[0].alias("header"), F.posexplode(F.slice("cells", F.lit(2), F.size("cells"))).alias("row", "r"))
    t = t.select(*keys, "header", "row", F.posexplode("r").alias("col", "value"))
    return t.select(*keys, "row", "col", F.get("header", F.col("col")).alias("header"), "value")
