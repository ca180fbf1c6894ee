"""Scores of answers: accuracy, intervals, breakdowns, comparison of runs.

Canonical columns: run, question_id, tool, correct_bool, correct_num, explanation, error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered

_TOOLS = "map<string, struct<explanation: string, correct: string, model: string, prompt_file: string, error: string>>"


def flatten_scores(results: DataFrame, tools: str = "evaluation_tools", keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """One row per question and tool of the JSON tool map; failed tools keep their error."""
    long = results.select(*keys, F.explode(F.from_json(tools, _TOOLS)).alias("tool", "s"))
    text = F.lower(F.trim("s.correct"))
    return long.select(
        *keys,
        "tool",
        F.when(text == "true", True).when(text == "false", False).alias("correct_bool"),
        text.try_cast("double").alias("correct_num"),
        F.col("s.explanation").alias("explanation"),
        F.col("s.error").alias("error"),
    )


def is_correct(bool_: Column | str = "correct_bool", num: Column | str = "correct_num") -> Column:
    """A boolean counts as it is, a number only at 100, anything else not."""
    b = F.col(bool_) if isinstance(bool_, str) else bool_
    n = F.col(num) if isinstance(num, str) else num
    return F.coalesce(b, n == 100, F.lit(False))


def _score(legacy: bool) -> Column:
    return F.coalesce(F.col("correct_bool"), F.col("correct_num") != 0, F.lit(False)) if legacy else is_correct()


def accuracy_by_tool(scores: DataFrame, by: Sequence[str] = ("tool",), legacy: bool = False) -> DataFrame:
    """Errors count as wrong. ``legacy``: any number but zero is correct."""
    ok = F.count_if(_score(legacy) & F.col("error").isNull())
    return scores.groupBy(*by).agg(
        ok.alias("correct"), F.count("*").alias("total"), F.round(F.when(F.count("*") > 0, ok / F.count("*")).otherwise(0.0), 6).alias("accuracy")
    )


def numeric_score(errors_as_zero: bool = True) -> Column:
    """0-100: booleans become 0 or 100."""
    s = F.coalesce(F.col("correct_num"), F.when(F.col("correct_bool"), 100.0).when(~F.col("correct_bool"), 0.0))
    return F.coalesce(s, F.lit(0.0)) if errors_as_zero else s


def running_accuracy(scores: DataFrame, order: str, keys: Sequence[str] = ("tool",), width: int | None = None) -> DataFrame:
    """Mean of the scores so far; sums in two levels, as one tool may hold all rows."""
    s = F.coalesce(F.col("correct_num"), F.col("correct_bool").cast("int").cast("double"), F.lit(0.0)).cast("decimal(18,6)")
    out = ordered.running_sum(scores, keys, order, {"seen": F.lit(1).cast("bigint"), "__sum": s}, width=width)
    return out.withColumn("running", F.round((F.col("__sum") / F.col("seen")).cast("double"), 6)).drop("__sum")


def mean_ci(scores: DataFrame, by: Sequence[str], score: Column | None = None, z: float = 1.96) -> DataFrame:
    """Mean with z * sigma_pop / sqrt(n), and the share of perfect scores with the same interval."""
    s = scores.withColumn("__s", score if score is not None else numeric_score())
    s = s.withColumn("__p", F.when(F.col("__s") == 100, 1.0).otherwise(0.0))
    return s.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg("__s"), 4).alias("mean"),
        F.round(z * F.stddev_pop("__s") / F.sqrt(F.count("*")), 4).alias("half_width"),
        F.round(F.avg("__p"), 4).alias("perfect"),
        F.round(z * F.stddev_pop("__p") / F.sqrt(F.count("*")), 4).alias("perfect_half_width"),
    )


def breakdown(scores: DataFrame, dims: Sequence[str], by: Sequence[str] = ("tool",), score: Column | None = None) -> DataFrame:
    """``mean_ci`` per value of each metadata column."""
    s = scores.withColumn("__score", score if score is not None else numeric_score())
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    long = s.select(*by, "__score", F.inline(pairs))
    return mean_ci(long, ["dim", "value", *by], F.col("__score"))


def score_grid(scores: DataFrame, x: str, y: str, score: Column) -> DataFrame:
    """Mean and n for every (x, y) with empty cells and both margins."""
    s = scores.withColumn("__s", score)
    cells = s.groupBy(x, y).agg(F.count("*").alias("n"), F.sum("__s").alias("t"))
    # the grid itself is the output; its sides are the distinct values
    sides = cells.agg(F.collect_set(x).alias("xs"), F.collect_set(y).alias("ys"))
    grid = sides.select(F.explode(F.array_append("xs", F.lit(None))).alias(x), "ys")
    grid = grid.select(x, F.explode(F.array_append("ys", F.lit(None))).alias(y)).filter(F.col(x).isNotNull() | F.col(y).isNotNull())
    sums = cells.cube(x, y).agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    sums = sums.filter(F.col(x).isNotNull() | F.col(y).isNotNull()).select(F.col(x).alias("__x"), F.col(y).alias("__y"), "n", "t")
    j = grid.join(sums, F.col(x).eqNullSafe(F.col("__x")) & F.col(y).eqNullSafe(F.col("__y")), "left")
    return j.select(x, y, F.coalesce("n", F.lit(0)).alias("n"), F.round((F.col("t") / F.col("n")).cast("double"), 4).alias("mean"))


def dataset_stats(questions: DataFrame, dims: Sequence[str], size: Column) -> DataFrame:
    """Count and mean number of documents per value of each dimension, weighted by question."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    long = questions.select(F.inline(pairs), size.alias("__n"))
    return long.groupBy("dim", "value").agg(F.count("*").alias("questions"), F.round(F.avg("__n"), 6).alias("mean_documents"))


def question_flags(scores: DataFrame, keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """All / any tool right and any wrong; NULL for a question without tools."""
    s = scores.withColumn("__c", F.when(F.col("tool").isNotNull(), is_correct()))
    return s.groupBy(*keys).agg(
        F.bool_and("__c").alias("all_correct"), F.bool_or("__c").alias("any_correct"), F.bool_or(~F.col("__c")).alias("any_incorrect")
    )


def compare_runs(scores: DataFrame, runs: Sequence, meta: Sequence[str] = ()) -> DataFrame:
    """One row per question of any run; ``run_i_correct`` (all tools), ``run_i_any_correct``; metadata of the first run that has it."""
    index = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(runs))):
        index = F.when(F.col("run") == r, F.lit(i)).otherwise(index)
    s = scores.withColumns({"__i": index, "__c": is_correct()}).filter(F.col("__i").isNotNull())
    aggs = []
    for i in range(len(runs)):
        mine = F.when(F.col("__i") == i, F.col("__c"))
        aggs += [F.bool_and(mine).alias(f"run_{i}_correct"), F.bool_or(mine).alias(f"run_{i}_any_correct")]
    aggs += [F.min_by(m, F.when(F.col(m).isNotNull(), F.col("__i"))).alias(m) for m in meta]
    return s.groupBy("question_id").agg(*aggs, (F.count_distinct("__i") == len(runs)).alias("in_all_runs"))


def regressions(compared: DataFrame, preset: str, runs: int = 2) -> DataFrame:
    """``regressed``: run 0 right, run 1 wrong. ``all_wrong``, ``any_right``: over all runs."""
    flags = [F.coalesce(F.col(f"run_{i}_correct"), F.lit(False)) for i in range(runs)]
    any_right = flags[0]
    for f in flags[1:]:
        any_right = any_right | f
    if preset == "regressed":
        return compared.filter(flags[0] & (F.col("run_1_correct") == F.lit(False)))
    if preset == "all_wrong":
        return compared.filter(~any_right)
    if preset == "any_right":
        return compared.filter(any_right)
    raise ValueError(f"unknown preset {preset}")


def questions_wide(scores: DataFrame, tools: Sequence[str], keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """A column per tool with its raw score and one with its correctness."""
    raw = F.coalesce(F.col("correct_bool").cast("string"), F.col("correct_num").cast("string"))
    s = scores.withColumns({"__r": raw, "__c": is_correct()})
    aggs = []
    for t in tools:
        mine = F.col("tool") == t
        aggs += [F.max(F.when(mine, F.col("__r"))).alias(t), F.bool_or(F.when(mine, F.col("__c"))).alias(f"{t}_correct")]
    return s.groupBy(*keys).agg(*aggs)


def stats_with_examples(results: DataFrame, dims: Sequence[str], ok: str = "all_correct", key: str = "question_id", k: int = 3) -> DataFrame:
    """Per metadata key and value: total, fully correct, and up to k examples of success and of failure."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    long = results.select(key, ok, F.inline(pairs))
    totals = long.groupBy("dim", "value").agg(F.count("*").alias("total"), F.count_if(ok).alias("correct"))
    top = ordered.top_per_group(long, ["dim", "value", ok], [F.col(key)], k)
    ex = top.groupBy("dim", "value").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col(ok), F.col(key)))), ",").alias("successes"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col(ok), F.col(key)))), ",").alias("failures"),
    )
    return totals.join(ex, ["dim", "value"], "left")


def avg_numeric_score(scores: DataFrame, by: Sequence[str] = ("tool",)) -> DataFrame:
    """Mean of explained scores; booleans count as 0 and 1."""
    s = F.coalesce(F.col("correct_num"), F.col("correct_bool").cast("int").cast("double"))
    kept = scores.filter(F.col("explanation").isNotNull() & s.isNotNull())
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean"))


def merge_on_answers(questions: DataFrame, results: DataFrame, fill: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Join on ``gold|predicted``: results update scores and fill missing metadata."""
    key = F.concat_ws("|", "gold", "predicted")
    r = results.withColumn("__k", key).groupBy("__k").agg(*[F.min(c).alias(f"__r_{c}") for c in (*fill, *update)])
    out = questions.withColumn("__k", key).join(r, "__k", "left")
    for c in fill:
        out = out.withColumn(c, F.coalesce(c, f"__r_{c}"))
    for c in update:
        out = out.withColumn(c, F.coalesce(F.col(f"__r_{c}"), F.col(c)))
    return out.drop("__k", *[f"__r_{c}" for c in (*fill, *update)])


def bucket_status(buckets: DataFrame, score: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Correct / Incorrect / Unknown by the soft score; share per status."""
    status = F.when(F.col(score).isNull(), "Unknown").when(F.col(score), "Correct").otherwise("Incorrect")
    s = buckets.withColumn("status", status)
    per = s.groupBy(*by, "status").agg(F.count("*").alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    total = per.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = per.join(total, list(by)) if by else per.join(F.broadcast(total))
    return joined.withColumn("percent", F.round(100.0 * F.col("n") / F.col("total"), 4))


def wrong_ids(buckets: DataFrame, score: str, key: str) -> DataFrame:
    """Ids of the incorrect buckets, as rows."""
    return buckets.filter(F.col(score) == F.lit(False)).select(key)

