"""Reconciliation of fragmentary rows: dedupe, canonicalize, resolve conflicts, aggregate."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ordered
from ..functions.text import empty_test, norm_key, significant_digits
from ..session import cut_lineage

ID = "row_id"


def _meaningful(df: DataFrame, ignore: Sequence[str] = ()) -> Column:
    tests = [~empty_test(df, c) for c in df.columns if c not in ignore]
    return functools.reduce(operator.or_, tests, F.lit(False))


def clear_nan(df: DataFrame, ignore: Sequence[str] = (ID,)) -> DataFrame:
    return df.filter(_meaningful(df, ignore))


def filled_count(df: DataFrame, columns: Sequence[str]) -> Column:
    return functools.reduce(operator.add, [F.when(empty_test(df, c), 0).otherwise(1) for c in columns], F.lit(0))


def dedupe_best(df: DataFrame, keys: Sequence[str], value: str, explicit: str | None = None, row_id: str = ID) -> DataFrame:
    """Best row per key: precision of ``value``, then stated over inferred, then completeness, then first."""
    rest = [c for c in df.columns if c not in (*keys, row_id)]
    score = F.struct(
        significant_digits(F.col(value), df.schema[value].dataType).alias("precision"),
        F.coalesce(F.col(explicit), F.lit(False)).alias("explicit") if explicit else F.lit(False).alias("explicit"),
        filled_count(df, rest).alias("filled"),
        (-F.col(row_id)).alias("first"),
    )
    return ordered.best_row(df, keys, score)


def dedupe_numeric(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tol: float,
    quoted: Column | None = None,
    literal: Column | None = None,
    row_id: str = ID,
    width: int | None = None,
) -> DataFrame:
    """One row per run of near-equal numbers (neighbours at most ``tol`` apart).

    Kept is the number with most digits, then quoted over approximate, then literal over computed. Rows are shuffled once,
    by spans of the numbers; there they become runs. Only the first and last run of a span may go on in another one.
    """
    score = F.struct(
        significant_digits(F.col(value), df.schema[value].dataType).alias("digits"),
        (quoted if quoted is not None else F.lit(False)).alias("quoted"),
        (literal if literal is not None else F.lit(False)).alias("literal"),
        (-F.col(row_id)).alias("first"),
    )
    span, others = ordered.SPAN, [c for c in df.columns if c not in keys]
    inside = Window.partitionBy(*keys, span).orderBy(value, row_id)
    new = lambda x, before: F.coalesce(x - before > tol, F.lit(True)).cast("int")
    d = ordered.with_span(df, value, width).withColumns({"__prev": F.lag(value).over(inside), "__last": F.lead(F.lit(0)).over(inside).isNull()})
    d = d.withColumn("__run", F.sum(new(F.col(value), F.col("__prev"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    best = lambda row, by: F.max_by(row, by).alias("__row")
    runs = d.groupBy(*keys, span, "__run").agg(
        best(F.struct(*others), score), F.max(score).alias("__score"), F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.max("__last").alias("__last"), F.count("*").alias("variants")
    )
    edge = (F.col("__run") == 1) | F.col("__last")
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(span, "__run")
    apart = F.when(F.lag(span).over(along).eqNullSafe(F.col(span)), 1).otherwise(new(F.col("__lo"), F.lag("__hi").over(along)))
    edges = runs.filter(edge).withColumn("__new", apart)
    edges = edges.withColumn("__run", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.groupBy(*keys, "__run").agg(best("__row", "__score"), F.sum("variants").alias("variants"))
    out = [*keys, *[F.col(f"__row.{c}").alias(c) for c in others], "variants"]
    return runs.filter(~edge).select(*out).unionByName(edges.select(*out))


def dedupe_text(df: DataFrame, keys: Sequence[str], text: str, literal: Column | None = None) -> DataFrame:
    """One text per canonical key: literal first, then longest; number of variants kept along."""
    score = F.struct((literal if literal is not None else F.lit(True)).alias("l"), F.length(text).alias("n"), F.col(text).alias("t"))
    return df.withColumn("canonical_key", norm_key(F.col(text))).groupBy(*keys, "canonical_key").agg(
        F.max_by(text, score).alias(text), F.count("*").alias("variants")
    )


def find_conflicts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys and columns with more than one non-NULL value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(*keys, F.inline(pairs)).filter(F.col("value").isNotNull())
    return long.groupBy(*keys, "column").agg(F.count_distinct("value").alias("values")).filter("values > 1")


def resolve_ladder(cells: DataFrame, keys: Sequence[str], ladder: Sequence[Column], value: str = "value", keep_ties: bool = False) -> DataFrame:
    """Per key (which includes the field) the value that is best on the ladder, compared rung by rung.

    Rungs are columns where larger is better. ``keep_ties`` joins all values that share the best rungs.
    """
    score = F.struct(*[c.alias(f"s{i}") for i, c in enumerate(ladder)])
    c = cells.filter(F.col(value).isNotNull()).withColumn("__score", score)
    if not keep_ties:
        tie = F.struct("__score", F.col(value).alias("v"))
        return c.groupBy(*keys).agg(F.max_by(value, tie).alias(value), F.count("*").alias("candidates"))
    once = c.groupBy(*keys, value).agg(F.max("__score").alias("__score"))
    top = once.groupBy(*keys).agg(F.max("__score").alias("__top"))
    best = once.join(top, list(keys)).filter(F.col("__score") == F.col("__top"))
    return best.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(value)), " | ").alias(value), F.count("*").alias("tied"))


def coalesce_rows(df: DataFrame, keys: Sequence[str], row_id: str = ID) -> DataFrame:
    """One record per entity: longer text, most precise number, else the first filled value."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for c in df.columns:
        if c in keys or c == row_id:
            continue
        v = F.when(~empty_test(df, c), F.col(c))
        rank = F.length(c) if isinstance(kinds[c], T.StringType) else significant_digits(F.col(c), kinds[c])
        aggs.append(F.max_by(v, F.when(v.isNotNull(), F.struct(rank, -F.col(row_id)))).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def aggregate_across(df: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), sets: Sequence[str] = ()) -> DataFrame:
    aggs = [F.sum(c).alias(c) for c in sums]
    aggs += [F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), "; ").alias(c) for c in sets]
    return df.groupBy(*keys).agg(*aggs)


def _flat(df: DataFrame, c: str) -> Column:
    nested = isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))
    return (F.to_json(c) if nested else F.col(c)).alias(f"__k_{c}")


def drop_full_duplicates(df: DataFrame, row_id: str = ID) -> DataFrame:
    """Rows equal in all columns but the id; nested values compare by their JSON; the first id stays."""
    cols = [c for c in df.columns if c != row_id]
    keyed = df.select("*", *[_flat(df, c) for c in cols])
    firsts = keyed.groupBy(*[f"__k_{c}" for c in cols]).agg(
        F.min(row_id).alias(row_id), F.min_by(F.struct(*cols), row_id).alias("r")
    )
    return firsts.select(row_id, *[F.col(f"r.{c}").alias(c) for c in cols]).select(*df.columns)


def dedupe_subset(df: DataFrame, pred: Column, row_id: str = ID) -> DataFrame:
    inside = F.coalesce(pred, F.lit(False))
    return df.filter(~inside).unionByName(drop_full_duplicates(df.filter(inside), row_id))


def canonicalize(df: DataFrame, pred: Column, column: str, value) -> DataFrame:
    return df.withColumn(column, F.when(pred, F.lit(value)).otherwise(F.col(column)))


def resolve_rows(df: DataFrame, pred: Column, resolved: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(pred, F.lit(False))).unionByName(resolved, allowMissingColumns=True)


def aggregate_subset(df: DataFrame, pred: Column, keys: Sequence[str], sums: Sequence[str], row_id: str = ID) -> DataFrame:
    """Selected rows become their aggregate; quote and rationale of each sum name its largest contributor and size."""
    inside = F.coalesce(pred, F.lit(False))
    aggs = [F.min(row_id).alias(row_id)]
    for c in sums:
        aggs += [
            F.sum(c).alias(c),
            F.max_by(F.col(c).cast("string"), F.struct(F.col(c), -F.col(row_id))).alias(f"{c}_quote"),
            F.concat(F.lit("sum of "), F.count(c).cast("string"), F.lit(" rows")).alias(f"{c}_rationale"),
        ]
    total = df.filter(inside).groupBy(*keys).agg(*aggs)
    return df.filter(~inside).unionByName(total, allowMissingColumns=True)


@dataclass(frozen=True)
class Resolved:
    frame: DataFrame
    errors: DataFrame


def resolve_entities(df: DataFrame, resolutions: DataFrame, columns: Sequence[str], row_id: str = ID) -> Resolved:
    """Apply (seq, row_ids, column, value) triples; the last one per cell wins.

    Any unknown id or column leaves the whole table as it is; the errors say which.
    """
    r = resolutions.select("seq", F.explode("row_ids").alias(row_id), "column", "value")
    unknown_col = resolutions.filter(~F.col("column").isin(list(columns))).select(
        "seq", F.concat(F.lit("Column does not exist: "), "column").alias("error")
    )
    unknown_id = r.join(df.select(row_id), row_id, "left_anti").select(
        "seq", F.concat(F.lit("Invalid row id: "), F.col(row_id).cast("string")).alias("error")
    )
    errors = unknown_col.union(unknown_id)
    last = r.groupBy(row_id, "column").agg(F.max_by("value", "seq").alias("value"))
    wide = last.groupBy(row_id).pivot("column", list(columns)).agg(F.first("value"))
    wide = wide.select(row_id, *[F.col(c).alias(f"__n_{c}") for c in columns])
    bad = errors.agg((F.count("*") > 0).alias("__bad"))  # one row
    out = df.join(wide, row_id, "left").join(F.broadcast(bad))
    for c in columns:
        kind = df.schema[c].dataType
        out = out.withColumn(c, F.when(F.col("__bad"), F.col(c)).otherwise(F.coalesce(F.col(f"__n_{c}").cast(kind), F.col(c))))
    return Resolved(out.select(*df.columns), errors)


def merge_rows(df: DataFrame, groups: DataFrame, resolutions: DataFrame | None = None, row_id: str = ID) -> DataFrame:
    """Rows named by ``groups(group, row_id)`` become one row at their smallest id, all groups in one pass.

    ``*_quote``, ``*_rationale``, row_number and page_number are joined by " | "; other columns take the first
    filled value. ``resolutions(group, column values…)`` goes before the rows' own values. Groups of one row are
    left alone.
    """
    g = groups.select("group", row_id).distinct()
    big = g.groupBy("group").agg(F.count("*").alias("n")).filter("n >= 2").select("group")
    g = g.join(big, "group", "left_semi")
    rows = df.join(g, row_id)
    aggs = [F.min(row_id).alias(row_id)]
    for c in df.columns:
        if c == row_id:
            continue
        filled = F.col(c).isNotNull()
        if c.endswith(("_quote", "_rationale")) or c in ("row_number", "page_number"):
            pairs = F.array_sort(F.collect_list(F.when(filled, F.struct(F.col(row_id).alias("i"), F.col(c).cast("string").alias("v")))))
            joined = F.array_join(F.transform(pairs, lambda p: p["v"]), " | ")
            aggs.append(F.when(F.size(pairs) > 0, joined).alias(c))
        else:
            aggs.append(F.min_by(c, F.when(filled, F.col(row_id))).alias(c))
    merged = rows.groupBy("group").agg(*aggs)
    if resolutions is not None:
        given = [c for c in resolutions.columns if c != "group"]
        fixed = resolutions.select("group", *[F.col(c).alias(f"__r_{c}") for c in given])
        merged = merged.join(fixed, "group", "left")
        for c in given:
            merged = merged.withColumn(c, F.coalesce(F.col(f"__r_{c}"), F.col(c)))
    rest = df.join(g.select(row_id), row_id, "left_anti")
    text = {c for c in df.columns if c in ("row_number", "page_number")}
    for c in text:
        rest = rest.withColumn(c, F.col(c).cast("string"))
    return rest.unionByName(merged.select(*df.columns))


def attach_provenance(df: DataFrame, prov: DataFrame, row_id: str = ID) -> DataFrame:
    """Quotes and rationales of ``prov`` by row id; where both sides have a column, ``prov`` wins if filled."""
    cols = [c for c in prov.columns if c.endswith(("_quote", "_rationale"))]
    if not cols:
        return df
    p = prov.select(row_id, *[F.col(c).alias(f"__p_{c}") for c in cols])
    out = df.join(p, row_id, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"__p_{c}"), F.col(c)) if c in df.columns else F.col(f"__p_{c}"))
    return out.drop(*[f"__p_{c}" for c in cols])


def accept_if_reduced(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: accepted, rows in, rows out, reduction ratio."""
    a = before.agg(F.count("*").alias("rows_in"))
    b = after.agg(F.count("*").alias("rows_out"))
    fewer = (F.col("rows_out") < F.col("rows_in")) | F.lit(len(after.columns) < len(before.columns))
    return a.join(F.broadcast(b)).select(
        ((F.col("rows_out") > 0) & fewer).alias("accepted"),
        "rows_in",
        "rows_out",
        F.round(F.when(F.col("rows_in") > 0, (F.col("rows_in") - F.col("rows_out")) / F.col("rows_in")).otherwise(0.0), 6).alias("reduction_ratio"),
    )


def _quality(df: DataFrame, columns: Sequence[str], tag: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.when(~empty_test(df, c), F.col(c).cast("string")).alias("v")) for c in columns])
    per = df.select(F.inline(pairs)).groupBy("c").agg(
        F.count("*").alias("n"), F.count("v").alias("k"), F.count_distinct("v").alias("d")
    )
    return per.agg(
        F.max("n").alias(f"rows_{tag}"),
        F.sum(F.col("n") - F.col("k")).alias(f"nulls_{tag}"),
        F.round(F.sum("d") / F.count("*"), 6).alias(f"mean_distinct_{tag}"),
        F.round(F.sum("k") / F.sum("n"), 6).alias(f"completeness_{tag}"),
    )


def quality_compare(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    q = _quality(before, columns, "before").join(F.broadcast(_quality(after, columns, "after")))
    better = (
        (F.col("rows_after") < F.col("rows_before"))
        | (F.col("nulls_after") < F.col("nulls_before"))
        | (F.col("mean_distinct_after") > F.col("mean_distinct_before"))
        | (F.col("completeness_after") > F.col("completeness_before"))
    )
    return q.withColumn("improved", better)


def table_health(rows: DataFrame, expected: DataFrame, table: str = "table_name") -> DataFrame:
    """Non-empty and empty tables and the share of non-empty ones."""
    n = rows.groupBy(table).agg(F.count("*").alias("n"))
    j = expected.select(table).distinct().join(n, table, "left")
    full = F.count_if(F.coalesce("n", F.lit(0)) > 0)
    return j.agg(
        full.alias("non_empty"),
        (F.count("*") - full).alias("empty"),
        F.round(F.when(F.count("*") > 0, full / F.count("*")).otherwise(0.0), 6).alias("completeness"),
    )


def merge_report(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """``steps(rows_in, rows_out, attempts, success)`` summed per ``by``."""
    ok = F.count_if("success")
    return steps.groupBy(*by).agg(
        F.sum("rows_in").alias("rows_in"),
        F.sum("rows_out").alias("rows_out"),
        F.round(F.when(F.sum("rows_in") > 0, (F.sum("rows_in") - F.sum("rows_out")) / F.sum("rows_in")).otherwise(0.0), 6).alias("reduction_ratio"),
        F.sum("attempts").alias("attempts"),
        ok.alias("succeeded"),
        (F.count("*") - ok).alias("failed"),
        F.round(ok / F.count("*"), 6).alias("success_rate"),
    )


def field_lineage(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """Source field of each derived column: the same name, else the longest field name contained in it."""
    from ..functions.matching import contains_join

    c = columns.select("column").distinct()
    f = fields.select("field").distinct()
    hits = contains_join(f, "field", c, "column", size=3)
    score = F.struct((F.col("field") == F.col("column")).alias("same"), F.length("field").alias("n"), F.col("field").alias("f"))
    best = hits.groupBy("column").agg(F.max_by("field", score).alias("field"))
    return c.join(best, "column", "left")


@dataclass
class PlanRun:
    frame: DataFrame
    audit: list[dict] = field(default_factory=list)


# Order of the reconciliation steps.
STEPS = ("clear_nan", "deduplication", "aggregation", "conflict_resolution")


def run_plan(
    df: DataFrame,
    steps: Mapping[str, Callable[[DataFrame], DataFrame]],
    needed: Callable[[str, DataFrame], bool] | None = None,
    max_loops: int = 3,
    table_name: str = "",
) -> PlanRun:
    """Run the needed steps in order, up to ``max_loops`` times.

    A step that loses columns is rejected. The loop ends with at most one row left or no step needed. Empty tables
    and tables named ``AdditionalInformation…`` pass through. Every accepted step is checkpointed, so the plan
    stays short and a lost executor does not replay the loop.
    """
    run = PlanRun(df)
    if table_name.startswith("AdditionalInformation") or df.isEmpty():
        return run
    rows = df.count()
    done: set[str] = set()
    for loop in range(max_loops):
        acted = False
        for name in STEPS:
            if name not in steps or rows <= 1:
                continue
            if not (needed(name, run.frame) if needed else name not in done):
                continue
            after = steps[name](run.frame)
            lost = set(run.frame.columns) - set(after.columns)
            entry = {"loop": loop, "step": name, "rows_in": rows, "rows_out": rows, "success": not lost}
            done.add(name)
            acted = True
            if not lost:
                run.frame = cut_lineage(after)
                rows = run.frame.count()
                entry["rows_out"] = rows
            run.audit.append(entry)
        if not acted or rows <= 1:
            break
    return run


def run_objectives(df: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], max_loops: int = 15, patience: int = 4) -> PlanRun:
    """Rotate through the objectives; accept a step that shrinks rows or columns; stop after ``patience`` misses."""
    run, rows, misses = PlanRun(df), df.count(), 0
    for loop in range(max_loops):
        if rows <= 1 or misses >= patience:
            break
        name, step = steps[loop % len(steps)]
        after = cut_lineage(step(run.frame))
        n = after.count()
        ok = n > 0 and (n < rows or len(after.columns) < len(run.frame.columns))
        run.audit.append({"loop": loop, "step": name, "rows_in": rows, "rows_out": n if ok else rows, "success": ok})
        if ok:
            run.frame, rows, misses = after, n, 0
        else:
            misses += 1
    return run
