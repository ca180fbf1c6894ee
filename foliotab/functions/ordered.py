"""Ordered computations that stay distributed when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(t)`` sends a whole key to one task. Here the order axis of
every key is first cut into ranges ("spans") of fixed width. Work happens in two levels:

* inside a span with an ordinary window (the task holds one span, not one key);
* across spans on the per-span summary, which has one row per span.

The summary is joined back on (key, span). Widths are plain parameters, so a re-run after an executor
loss cuts the same spans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = "__span"
ORDINAL_WIDTH = 1 << 17
TIME_WIDTH_US = 6 * 3600 * 1_000_000


def _axis(df: DataFrame, order: str) -> tuple[Column, int]:
    kind = df.schema[order].dataType
    col = F.col(order)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")), TIME_WIDTH_US
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("bigint"), 1
    return col.cast("bigint"), ORDINAL_WIDTH


def with_span(df: DataFrame, order: str, width: int | None = None) -> DataFrame:
    axis, default = _axis(df, order)
    return df.withColumn(SPAN, F.floor(axis / F.lit(width or default)).cast("bigint"))


def _sort_key(order: str, ties: Sequence[str]) -> Column:
    return F.struct(F.col(order), *[F.col(t) for t in ties])


def _local(keys: Sequence[str], order: str, ties: Sequence[str]):
    return Window.partitionBy(*keys, SPAN).orderBy(order, *ties)


def _between_spans(keys: Sequence[str]):
    # with no key the summary still has one row per span only
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SPAN)


def _rejoin(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [*keys, SPAN]
    s = summary.select(*[F.col(n).alias(f"__s_{n}") for n in names], *[c for c in summary.columns if c not in names])
    on = None
    for n in names:
        c = F.col(n).eqNullSafe(F.col(f"__s_{n}"))
        on = c if on is None else on & c
    return rows.join(s, on, "left").drop(*[f"__s_{n}" for n in names])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    ties: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Inclusive running sums, one new column per entry of ``sums``."""
    base = with_span(df, order, width)
    for name, expr in sums.items():
        base = base.withColumn(f"__v_{name}", expr)
    totals = base.groupBy(*keys, SPAN).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = _between_spans(keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, SPAN, *[F.sum(f"__t_{n}").over(before).alias(f"__o_{n}") for n in sums])
    w = _local(keys, order, ties).rowsBetween(Window.unboundedPreceding, 0)
    local = base
    for n in sums:
        local = local.withColumn(f"__l_{n}", F.sum(f"__v_{n}").over(w))
    out = _rejoin(local, offsets, keys)
    for n in sums:
        out = out.withColumn(
            n,
            F.when(F.col(f"__o_{n}").isNull(), F.col(f"__l_{n}"))
            .when(F.col(f"__l_{n}").isNull(), F.col(f"__o_{n}"))
            .otherwise(F.col(f"__o_{n}") + F.col(f"__l_{n}")),
        )
    drop = [SPAN] + [f"__{p}_{n}" for n in sums for p in ("v", "l", "o")]
    return out.drop(*drop)


def position(
    df: DataFrame, keys: Sequence[str], order: str, name: str, ties: Sequence[str] = (), width: int | None = None
) -> DataFrame:
    """1-based position inside each key."""
    return running_sum(df, keys, order, {name: F.lit(1).cast("bigint")}, ties, width)


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    ties: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Last non-null value at or before each row."""
    base = with_span(df, order, width)
    for name, expr in values.items():
        base = base.withColumn(f"__v_{name}", expr)
    last = base.groupBy(*keys, SPAN).agg(
        *[
            F.max_by(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), _sort_key(order, ties))).alias(f"__t_{n}")
            for n in values
        ]
    )
    before = _between_spans(keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = last.select(
        *keys, SPAN, *[F.last(F.col(f"__t_{n}"), ignorenulls=True).over(before).alias(f"__o_{n}") for n in values]
    )
    w = _local(keys, order, ties).rowsBetween(Window.unboundedPreceding, 0)
    local = base
    for n in values:
        local = local.withColumn(f"__l_{n}", F.last(F.col(f"__v_{n}"), ignorenulls=True).over(w))
    out = _rejoin(local, offsets, keys)
    for n in values:
        out = out.withColumn(n, F.coalesce(f"__l_{n}", f"__o_{n}"))
    return out.drop(SPAN, *[f"__{p}_{n}" for n in values for p in ("v", "l", "o")])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    ties: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """``lag``/``lead`` by one row. The row before a span's first row is the last of the span before."""
    previous, following = dict(previous or {}), dict(following or {})
    base = with_span(df, order, width)
    for name, expr in {**previous, **following}.items():
        base = base.withColumn(f"__v_{name}", expr)
    key = _sort_key(order, ties)
    aggs = [F.max_by(F.struct(F.col(f"__v_{n}").alias("v")), key).alias(f"__t_{n}") for n in previous]
    aggs += [F.min_by(F.struct(F.col(f"__v_{n}").alias("v")), key).alias(f"__t_{n}") for n in following]
    edges = base.groupBy(*keys, SPAN).agg(*aggs)
    spans = _between_spans(keys)
    edges = edges.select(
        *keys,
        SPAN,
        *[F.lag(f"__t_{n}").over(spans).alias(f"__o_{n}") for n in previous],
        *[F.lead(f"__t_{n}").over(spans).alias(f"__o_{n}") for n in following],
    )
    w = _local(keys, order, ties)
    local = base
    for n in previous:
        local = local.withColumn(f"__l_{n}", F.lag(F.struct(F.col(f"__v_{n}").alias("v"))).over(w))
    for n in following:
        local = local.withColumn(f"__l_{n}", F.lead(F.struct(F.col(f"__v_{n}").alias("v"))).over(w))
    out = _rejoin(local, edges, keys)
    for n in (*previous, *following):
        out = out.withColumn(n, F.coalesce(F.col(f"__l_{n}"), F.col(f"__o_{n}"))["v"])
    names = (*previous, *following)
    return out.drop(SPAN, *[f"__{p}_{n}" for n in names for p in ("v", "l", "o")])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key. Spark limits each map task to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def best_row(df: DataFrame, keys: Sequence[str], score: Column, largest: bool = True) -> DataFrame:
    """One whole row per key through a partial aggregate, so that a hot key shrinks before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    pick = F.max_by if largest else F.min_by
    one = df.groupBy(*keys).agg(pick(F.struct(*others), score).alias("__row"))
    return one.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others]).select(*df.columns)


def global_position(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """1-based position over the whole table in ``order`` (which must be unique), with no hot task.

    The range sort spreads the rows whatever their keys; each partition then needs one number, the count of
    the partitions before it. The sorted rows are written once, so both uses see the same partitions.
    """
    from ..session import cut_lineage

    rows = df.sort(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    rows = cut_lineage(rows)
    counts = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    local = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(offsets, "__p").withColumn(name, F.col("__o") + local + 1).drop("__p", "__i", "__o")


def count_in_range(probes: DataFrame, points: DataFrame, keys: Sequence[str], at: str, id_: str, reach: int, name: str, width: int) -> DataFrame:
    """Per probe the number of points of its key in [at - reach, at), without pairing them.

    Two running counts of the points, read at both ends of the range; a hot key is spread over its spans.
    """
    end = F.struct(F.col(at).alias("__x"), F.lit(1).alias("__sign"))
    start = F.struct((F.col(at) - reach).alias("__x"), F.lit(-1).alias("__sign"))
    ends = probes.select(*keys, id_, F.inline(F.array(end, start))).withColumns({"__k": F.lit(0), "__v": F.lit(0).cast("bigint")})
    marks = points.select(*keys, F.col(at).alias("__x")).withColumns({"__k": F.lit(1), "__v": F.lit(1).cast("bigint")})
    both = ends.unionByName(marks, allowMissingColumns=True)
    seen = running_sum(both, keys, "__x", {"__seen": F.col("__v")}, ["__k"], width).filter("__k = 0")
    return seen.groupBy(id_).agg(F.sum(F.col("__seen") * F.col("__sign")).alias(name))
