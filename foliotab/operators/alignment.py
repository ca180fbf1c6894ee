"""Tokens, sentences and the location of quotes in their source text.

Tokens and sentences are cut from whole texts in the tasks. Quotes and token intervals meet their document once: a row holds
one text and a bounded part of them, and a task indexes the text once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quotes as kernel
from ..functions import tokens as token_module
from ..functions.tokens import CHARS, ROW, Cut, sentence_rows, slices, token_rows
from ..session import cut_lineage, ship_by_value

for _module in (__name__, kernel.__name__, token_module.__name__):
    ship_by_value(_module)

# Abbreviations that do not end a sentence.
ABBREVIATIONS = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St."]

EXACT, LESSER, FUZZY = "MATCH_EXACT", "MATCH_LESSER", "MATCH_FUZZY"
#: Quotes of one document that a row holds, about; more quotes take more rows.
PART = 4_096


def tokenize(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """(…, __row, idx, token, type, start, end, after_newline, gap), one row per token; see ``functions.tokens``.

    ``keep`` names the columns that go along, by default all but the text.
    """
    return token_rows(docs, [c for c in docs.columns if c != text] if keep is None else keep, text)


TOKEN_COLUMNS = [ROW, "idx", "token", "type", "start", "end", "after_newline", "gap"]


def sentences(tokens: DataFrame) -> DataFrame:
    """(…, sentence, first, last, start, end, text): token interval of each sentence, ends exclusive, and its text.

    A sentence ends at a token that ends in . ? or ! unless it completes a known abbreviation, and before a
    capitalised token on a new line. Of whole texts, ``text_sentences`` gives the same without sorting token rows.
    """
    keep = [c for c in tokens.columns if c not in TOKEN_COLUMNS]
    at = Window.partitionBy(ROW).orderBy("idx")
    known = F.concat(F.lag("token").over(at), "token").isin(ABBREVIATIONS)
    stop = (F.col("type") == "PUNCTUATION") & F.substring("token", -1, 1).isin(".", "?", "!") & ~F.coalesce(known, F.lit(False))
    capital = F.contains(F.lead("gap").over(at), F.lit("\n")) & F.lead("token").over(at).rlike(r"^\p{IsUppercase}")
    marked = tokens.withColumn("__ends", F.when(stop | F.coalesce(capital, F.lit(False)), 1).otherwise(0))
    before = F.sum("__ends").over(at.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("sentence", F.coalesce(before, F.lit(0)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("idx", "gap", "token")))  # of one sentence
    text = F.array_join(F.transform(parts, lambda t, i: F.when(i == 0, t["token"]).otherwise(F.concat(t["gap"], t["token"]))), "")
    out = marked.groupBy(ROW, "sentence").agg(
        *[F.first(c).alias(c) for c in keep], F.min("idx").alias("first"), (F.max("idx") + 1).alias("last"), F.min("start").alias("start"), F.max("end").alias("end"), text.alias("text")
    )
    return out.select(*keep, "sentence", "first", "last", "start", "end", "text")


def text_sentences(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``sentences`` of the tokens of whole texts, cut in one pass over each text."""
    return sentence_rows(docs, [c for c in docs.columns if c != text] if keep is None else keep, ABBREVIATIONS, text).drop(ROW)


def span_text(intervals: DataFrame, tokens: DataFrame | None, docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "span") -> DataFrame:
    """``intervals(key, first, last, …)`` with the text of the token interval [first, last); NULL if the interval is invalid.

    ``key`` is unique in ``docs``. Where ``tokens`` is a table, both ends meet their tokens by (key, place). Without one a text
    meets its intervals once and is cut into its tokens there, so no token rows are shuffled.
    """
    if tokens is None:
        schema = T.StructType([*intervals.schema.fields, T.StructField(name, T.StringType())])
        return _met(intervals, docs.select(key, F.col(text).alias("__text")), key, PART).mapInArrow(_spans(schema.names), schema)
    ends = tokens.select(key, F.col("idx").alias("__i"), F.col("start").alias("__a"), F.col("end").alias("__b"))
    first = ends.select(key, F.col("__i").alias("first"), "__a")
    last = ends.select(key, (F.col("__i") + 1).alias("last"), "__b")
    out = intervals.join(first, [key, "first"], "left").join(last, [key, "last"], "left").join(docs.select(key, F.col(text).alias("__text")), key, "left")
    span = F.when(F.col("first") < F.col("last"), F.substring("__text", F.col("__a") + 1, F.col("__b") - F.col("__a")))
    return out.withColumn(name, span).select(*intervals.columns, name)


PLACES = "first_token int, last_token int, start_pos int, end_pos int, span_text string, status string, ratio double"


def _met(rows: DataFrame, texts: DataFrame, key: str, part: int) -> DataFrame:
    """(__text, __held): a text and about ``part`` of its rows; rows whose text is missing are kept. Reads ``rows`` twice."""
    parts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("__parts"))
    at = rows.join(parts, rows[key].eqNullSafe(parts[key])).drop(parts[key]).withColumn("__part", F.pmod(F.xxhash64(*rows.columns), "__parts").cast("int"))
    held = at.groupBy(key, "__part").agg(F.collect_list(F.struct(*rows.columns)).alias("__held"))
    texts = texts.join(parts, key).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    # the work is far larger than the bytes, by which Spark would merge partitions: their number is given
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return held.join(texts, [key, "__part"], "left").repartition(tasks, key, "__part").select("__text", "__held")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int], pa.StructArray]]:
    """(texts, their numbers of rows, the rows), some texts at a time: what a task holds does not grow with a batch."""
    for batch in batches:
        held, ends = batch.column(1), batch.column(1).value_lengths().to_pylist()
        sizes = [len(t.as_buffer() or b"") + CHARS * n // PART for t, n in zip(batch.column(0), ends)]
        at = 0
        for some in slices(batch, sizes, CHARS):
            yield [t or "" for t in some.column(0).to_pylist()], ends[at : at + some.num_rows], held.slice(at, some.num_rows).flatten()
            at += some.num_rows


def _spans(names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, counts, held in _pieces(batches):
            cut = Cut(texts)
            size = np.bincount(cut.row, minlength=len(texts))  # tokens of each text
            row = np.repeat(np.arange(len(texts)), counts)
            first, last = (held.field(names.index(c)).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("first", "last"))
            valid = (first >= 0) & (first < last) & (last <= size[row])
            base = (np.cumsum(size) - size)[row]
            spans = [cut.text[cut.start[b + i] : cut.end[b + j - 1]] if v else None for b, i, j, v in zip(base, first, last, valid)]
            yield pa.RecordBatch.from_arrays([*(held.field(k) for k in range(held.type.num_fields)), pa.array(spans, pa.string())], names=names)

    return run


def _aligned(quotes: DataFrame, docs: DataFrame, key: str, exact: bool, lesser: bool, fuzzy: float | None, part: int = PART) -> DataFrame:
    """All rows of ``quotes`` with the columns of ``PLACES``.

    Equal rows are looked up once and repeated at the end, so a part holds about ``part`` rows even if most are equal.
    """
    columns = quotes.columns
    rows = cut_lineage(quotes.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")))  # read twice
    met = _met(rows, docs.select(key, F.col("text").alias("__text")), key, part)
    schema = T.StructType([*quotes.schema.fields, *T._parse_datatype_string(PLACES).fields])
    return met.mapInArrow(_located(columns.index("quote"), exact, lesser, fuzzy), schema)


def _located(quote: int, exact: bool, lesser: bool, fuzzy: float | None):
    def place(text: kernel.Text, words: list[str]) -> tuple:
        if exact:
            first = text.exact(words)
            if first is not None:
                return first, len(words), EXACT, 1.0
            if lesser and (found := text.longest_prefix(words)):
                return *found, LESSER, found[1] / len(words)
        if fuzzy is not None and (window := text.fuzzy(words, fuzzy)):
            return window[0], window[1], FUZZY, round(window[2] / len(words), 6)
        return None, 0, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64()]
        for texts, counts, held in _pieces(batches):
            said = held.field(quote).to_pylist()
            out: list[tuple] = []
            at = 0
            for source, size in zip(texts, counts):
                text = kernel.Text(source)
                seen: dict[str, tuple] = {}
                for q in said[at : at + size]:
                    row = seen.get(q)
                    if row is None:
                        first, width, status, ratio = place(text, kernel.split(q or ""))
                        row = (None,) * 7
                        if first is not None:
                            start, end = text.spans[first][0], text.spans[first + width - 1][1]
                            row = (first, first + width, start, end, text.text[start:end], status, ratio)
                        seen[q] = row
                    out.append(row)
                at += size
            columns = list(zip(*out)) if out else [()] * 7
            own = held.type.num_fields - 1
            arrays = [held.field(k) for k in range(own)] + [pa.array(v, k) for v, k in zip(columns, kinds)]
            names = [held.type.field(k).name for k in range(own)]
            found = pa.RecordBatch.from_arrays(arrays, names=[*names, *[f.split()[0] for f in PLACES.split(", ")]])
            copies = held.field(own).to_numpy()
            yield found
            for again in range(1, int(copies.max(initial=1))):
                yield found.take(pa.array((copies > again).nonzero()[0]))

    return run


def align_exact(quotes: DataFrame, docs: DataFrame, key: str = "doc_id", accept_lesser: bool = False) -> DataFrame:
    """First place of each quote's token sequence in its document; NULLs and no status if there is none.

    ``quotes(key, quote, …)``, ``docs(key, text)``. Each quote is looked up on its own. With
    ``accept_lesser`` the longest prefix of the quote that occurs (at its first place) is taken instead.
    """
    return _aligned(quotes, docs, key, True, accept_lesser, None).drop("ratio")


def align_fuzzy(quotes: DataFrame, docs: DataFrame, key: str = "doc_id", threshold: float = 0.75) -> DataFrame:
    """Window of the document whose matching blocks hold ``threshold`` of the quote's stemmed tokens; quotes without one go.

    Matching blocks are the longest common run and, left and right of it, the same again. A quote is placed if any window
    of the document has that share. ``ratio`` is the window's share.
    """
    return _aligned(quotes, docs, key, False, False, threshold).where("status is not null").select(*quotes.columns, "ratio", *[f.split()[0] for f in PLACES.split(", ")[:-1]])


def annotate_alignment(cells: DataFrame, docs: DataFrame, key: str = "doc_id", threshold: float = 0.75) -> DataFrame:
    """Per cell and quote: offsets, span text and status; exact first, fuzzy for the rest, NULLs for neither."""
    ids = [c for c in cells.columns if c != "quote"]
    q = cells.select(*ids, F.posexplode_outer("quote").alias("quote_idx", "quote"))
    return _aligned(q, docs, key, True, False, threshold).drop("ratio")
