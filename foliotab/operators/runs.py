"""Run logs: calls, segments, costs, and files of a run."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.matching import contains_join
from ..session import cut_lineage

# Event names of the call log.
START, END, ERROR, FRAME = "llm_call_start", "llm_call_end", "llm_call_error", "dataframe_log"


def zip_positions(results: DataFrame, metadata: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Positional join of two lists kept as rows."""
    a = ordered.position(results, keys, order, "pos")
    b = ordered.position(metadata, keys, order, "pos").drop(order)
    return a.join(b, [*keys, "pos"])


def run_counts(metadata: DataFrame, error: Column, by: Sequence[str] = ()) -> DataFrame:
    bad = F.count_if(F.coalesce(error, F.lit(False)))
    return metadata.groupBy(*by).agg(F.count("*").alias("total"), (F.count("*") - bad).alias("ok"), bad.alias("errors"))


def request_id(df: DataFrame) -> Column:
    """request_id, else the one in the metadata, else parent_run_id."""
    options = [F.col(c) for c in ("request_id", "metadata_request_id", "parent_run_id") if c in df.columns]
    return F.coalesce(*[F.when(c != "", c) for c in options])


def pair_events(events: DataFrame, keys: Sequence[str], ts: str = "us", event: str = "event", tie: str = "event_id") -> DataFrame:
    """Start and end of each request; the last event of a kind wins; frames follow as zero-length rows.

    ``ts`` is in microseconds. Requests with one side only have ``matched`` false.
    """
    kind = F.when(F.col(event) == START, "start").when(F.col(event).isin(END, ERROR), "end")
    known = events.withColumn("__k", kind).filter(F.col("__k").isNotNull())
    at = F.struct(F.col(ts), F.col(tie))
    pairs = known.groupBy(*keys).agg(
        F.max(F.when(F.col("__k") == "start", at)).alias("s"), F.max(F.when(F.col("__k") == "end", at)).alias("e")
    )
    calls = pairs.select(
        *keys,
        F.lit("call").alias("kind"),
        F.col(f"s.{ts}").alias("start_us"),
        F.col(f"e.{ts}").alias("end_us"),
        (F.col("s").isNotNull() & F.col("e").isNotNull()).alias("matched"),
    )
    frames = events.filter(F.col(event) == FRAME).select(
        *keys, F.lit("frame").alias("kind"), F.col(ts).alias("start_us"), F.col(ts).alias("end_us"), F.lit(True).alias("matched")
    )
    return calls.unionByName(frames).withColumn("duration_ms", F.round((F.col("end_us") - F.col("start_us")) / 1000.0, 3))


def call_kpis(pairs: DataFrame, visible: Column, by: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(visible).alias("visible"), F.count_if(~F.col("matched")).alias("unmatched")
    )


def latency_tokens(events: DataFrame, by: Sequence[str], ms: str = "response_ms", tokens: str = "total_tokens", approximate: bool = True) -> DataFrame:
    """Latency and token use.

    Quantiles are approximate: a sketch per group, off by at most 1 / 10,000 of the group's rank. With ``approximate=False``
    they are exact values of the data (lower nearest rank); see ``exact_quantiles``.
    """
    shares = {"p50": "0.5", "p95": "0.95"}
    sketch = [F.percentile_approx(ms, float(p), 10_000).alias(n) for n, p in shares.items()] if approximate else []
    out = events.groupBy(*by).agg(F.count("*").alias("calls"), *sketch, F.max(ms).alias("worst"), F.sum(tokens).alias("tokens"))
    if not approximate:
        out = _with_group(out, exact_quantiles(events, by, ms, shares), by)
    return out.select(*by, "calls", *shares, "worst", "tokens")


def _with_group(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row with the columns of its group; NULL is a group."""
    named = groups.withColumnsRenamed({c: f"__by_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by] or [F.lit(True)]
    return rows.join(named, functools.reduce(operator.and_, same), "left").drop(*[f"__by_{c}" for c in by])


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, str], ranges: int = 32) -> DataFrame:
    """(by…, shares…): the least value that has the share (a decimal number) of the group's values at or below it.

    A sketch cuts the values of a group into ranges, which are ranked apart from each other and added up. The cuts only
    spread the work: wherever they are, the ranks are exact. NULL values do not count.
    """
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 1_000).alias("__cuts"))
    at = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    filled = _with_group(rows.select(*by, value).where(F.col(value).isNotNull()), cuts, by)
    counts = cut_lineage(filled.groupBy(*by, at.alias("__range"), value).agg(F.count("*").alias("__n")))
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    totals = counts.groupBy(*by, "__range").agg(F.sum("__n").alias("__n")).select(
        *by, "__range", F.sum("__n").over(whole).alias("__all"),
        F.coalesce(F.sum("__n").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = _with_group(counts.withColumn("__rank", F.sum("__n").over(inside)), totals, [*by, "__range"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before"))
    reached = lambda p: F.col("__rank") >= F.greatest(F.lit(1), F.ceil(F.col("__all") * F.lit(Decimal(p))).cast("bigint"))
    return ranked.groupBy(*by).agg(*[F.min(F.when(reached(p), F.col(value))).alias(n) for n, p in shares.items()])


def cost(calls: DataFrame, template_model: Mapping[str, str], prices: Mapping[str, tuple[float, float]], by: Sequence[str] = ("template",)) -> DataFrame:
    """Price per million tokens in and out; unknown templates are skipped."""
    model = F.create_map(*[F.lit(x) for kv in template_model.items() for x in kv])[F.col("template")]
    rate_in = F.create_map(*[x for m, (i, _) in prices.items() for x in (F.lit(m), F.lit(i))])
    rate_out = F.create_map(*[x for m, (_, o) in prices.items() for x in (F.lit(m), F.lit(o))])
    c = calls.withColumn("model", model).filter(F.col("model").isNotNull())
    sums = c.groupBy(*by, "model").agg(F.count("*").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"))
    price = (F.col("in_tokens") * rate_in[F.col("model")] + F.col("out_tokens") * rate_out[F.col("model")]) / 1e6
    return sums.withColumn("cost", F.round(price, 8))


def request_key(prompt: Column, model: Column, fmt: Column) -> Column:
    return F.md5(F.concat_ws(":", prompt, model, fmt))


def uncached(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests to send: cacheable ones (temperature 0) once each and only if unknown; all others as they are."""
    cold = F.col("temperature") == 0
    once = requests.filter(cold).dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    return once.unionByName(requests.filter(~cold))


def segments(df: DataFrame, marker: Column, keys: Sequence[str], order: str, name: str = "bucket", ties: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Number of markers seen so far: 0 for the rows before the first one."""
    m = F.when(marker, 1).otherwise(0).cast("bigint")
    return ordered.running_sum(df, keys, order, {name: m}, ties, width)


def segment_log(lines: DataFrame, keys: Sequence[str] = ("log",), order: str = "line") -> DataFrame:
    """Questions of a flat log: header lines open one; everything from SUMMARY on is left out."""
    msg = F.col("message")
    stop = lines.filter(msg.contains("SUMMARY")).groupBy(*keys).agg(F.min(order).alias("__stop"))
    body = lines.join(stop, list(keys), "left").filter(F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).drop("__stop")
    header = msg.contains("of") & msg.contains("|") & msg.contains("Question")
    s = segments(body, header, keys, order, "segment").filter("segment > 0")
    parts = F.split(F.trim(F.split(msg, r"\|")[1]), ",")
    after = lambda tag: F.trim(F.element_at(F.split(msg, tag), -1))
    gold = F.when(msg.contains("Gold Answer:"), after("Gold Answer:"))
    pred = F.when(~msg.contains("Gold Answer:") & msg.contains("Predicted Answer:"), after("Predicted Answer:"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(order)))
    aggs = [
        F.max(F.when(header, F.replace(after("Question"), F.lit("="), F.lit("")))).alias("question_id"),
        F.max(F.when(header & (F.size(parts) >= 2), F.trim(parts[0]))).alias("question_type"),
        F.max(F.when(header & (F.size(parts) >= 2), F.trim(F.get(parts, F.lit(1))))).alias("question_level"),
        last(gold).alias("gold_answer"),
        last(pred).alias("predicted_answer"),
        F.count("*").alias("lines"),
    ]
    for tool in ("soft_evaluator", "hard_evaluator"):
        # a line about answers is not read for scores
        score = F.when(msg.contains("evaluator:") & msg.contains(tool) & gold.isNull() & pred.isNull(), F.lower(after(":")))
        aggs.append(last(score).alias(tool))
    return s.groupBy(*keys, "segment").agg(*aggs)


def parse_summary(lines: DataFrame, keys: Sequence[str] = ("log",), order: str = "line") -> DataFrame:
    """Evaluator rows after the completion line, each under the last section and group header seen."""
    msg = F.col("message")
    begin = lines.filter(msg == "=== EXPERIMENT COMPLETE ===").groupBy(*keys).agg(F.min(order).alias("__from"))
    body = lines.join(begin, list(keys)).filter(F.col(order) >= F.col("__from")).drop("__from")
    section = F.when(msg.contains("Question Domain Breakdown:") | msg.contains("--- question_domain:"), "domain").when(
        msg.contains("--- question_level:"), "level"
    )
    group = F.when(msg.contains("(N="), F.trim(F.split(msg, ":")[0]))
    count = F.regexp_extract(msg, r"\(N=(\d+)\)", 1).try_cast("bigint")
    mark = F.when(section.isNotNull(), F.struct(section.alias("section"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("n")))
    b = ordered.carry_forward(body, keys, order, {"__sec": mark["section"], "__sec_at": F.when(section.isNotNull(), F.col(order))})
    inside = group.isNotNull() & F.col("__sec").isNotNull()
    b = ordered.carry_forward(b, keys, order, {"__grp": F.when(inside, F.struct(group.alias("name"), count.alias("n"), F.col(order).alias("at")))})
    rows = b.filter(F.ltrim(msg).startswith("LLMAsJudge") & msg.contains(":"))
    live = F.col("__grp.at") > F.col("__sec_at")
    return rows.select(
        *keys,
        order,
        F.coalesce("__sec", F.lit("overall")).alias("section"),
        F.when(live, F.col("__grp.name")).alias("name"),
        F.when(live, F.col("__grp.n")).alias("n"),
        F.trim(F.split(msg, ":")[0]).alias("evaluator"),
        F.trim(F.split(F.split(msg, ":")[1], "±")[0]).try_cast("double").alias("score"),
    ).filter("score is not null")


def match_bucket(buckets: DataFrame, results: DataFrame, bucket: str, text: str, result: str, question: str) -> DataFrame:
    """First result whose question occurs in the bucket's text."""
    hits = contains_join(results, question, buckets, text, size=24)
    return hits.groupBy(bucket).agg(F.min(result).alias(result))


def bucket_profile(calls: DataFrame, keys: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Calls per bucket and template; each output name is the first filled one of its alias columns."""
    picks = {n: F.coalesce(*[F.col(a) for a in names if a in calls.columns]) for n, names in aliases.items()}
    c = calls.withColumns({f"__{n}": p for n, p in picks.items()})
    return c.groupBy(*keys, "template").agg(F.count("*").alias("calls"), *[F.min(f"__{n}").alias(n) for n in picks])


def first_answer(chunks: DataFrame, keys: Sequence[str], order: str, found: Column, answer: str) -> DataFrame:
    """Answer of the first chunk that has one, else of the last chunk."""
    return chunks.groupBy(*keys).agg(
        F.coalesce(F.min_by(answer, F.when(found, F.col(order))), F.max_by(answer, order)).alias("answer"),
        F.min(F.when(found, F.col(order))).alias("found_at"),
    )


def run_timestamp(name: Column) -> Column:
    """Trailing ``digits_digits`` or ``digits`` of a file name without suffix, else the whole name."""
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    two, one = F.regexp_extract(base, r"(?:^|_)([0-9]+_[0-9]+)$", 1), F.regexp_extract(base, r"(?:^|_)([0-9]+)$", 1)
    return F.when(two != "", two).when(one != "", one).otherwise(base)


def link_by_timestamp(logs: DataFrame, results: DataFrame) -> DataFrame:
    """Log and result file of each run, full outer by the timestamp in the name; the last name wins."""
    a = logs.groupBy(run_timestamp(F.col("name")).alias("stamp")).agg(F.max("name").alias("log_file"))
    b = results.groupBy(run_timestamp(F.col("name")).alias("stamp")).agg(F.max("name").alias("results_file"))
    return a.join(b, "stamp", "full_outer")


def link_by_experiment(results: DataFrame, logs: DataFrame) -> DataFrame:
    """Log of each results file: exact ``<id>.jsonl``, else the newest log with the id in its name."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    r = results.select(F.col("name").alias("results_file"), F.element_at(F.split(F.regexp_replace(base(F.col("name")), r"\.[^.]*$", ""), "_"), -1).alias("id"))
    g = logs.select(F.col("name").alias("log_file"), base(F.col("name")).alias("file"), "mtime")
    exact = r.join(g, F.concat("id", F.lit(".jsonl")) == F.col("file")).groupBy("results_file").agg(F.min("log_file").alias("exact"))
    loose = contains_join(r, "id", g, "file", size=4).groupBy("results_file").agg(F.max_by("log_file", F.struct("mtime", "log_file")).alias("loose"))
    out = r.join(exact, "results_file", "left").join(loose, "results_file", "left")
    return out.select("results_file", "id", F.coalesce("exact", "loose").alias("log_file"))


def attach_log_documents(documents: DataFrame, log_docs: DataFrame, keys: Sequence[str] = ("question_id", "name")) -> tuple[DataFrame, DataFrame]:
    """Descriptions copied onto result documents by name within a question; and the log documents that fit none."""
    one = log_docs.groupBy(*keys).agg(F.min("original_description").alias("original_description"), F.min("generated_description").alias("generated_description"))
    return documents.join(one, list(keys), "left"), log_docs.join(documents, list(keys), "left_anti")
