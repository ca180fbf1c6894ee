"""H: streaming forms, run over the tables as a file source."""

from pyspark.sql import functions as F

from ..operators import runs as N
from ..session import scratch_path
from ..streaming import events as H
from .registry import query


BATCHES = 8
FILES = 8
END = "__end"


def run(t, df, order, stream, mode, sink=None, batches=BATCHES):
    """What ``stream`` writes over the rows as they come in ``order``, in many micro-batches.

    After each part of the rows the stream ends and is started again from its checkpoint, so state and watermark are carried.
    """
    staged, path, at = (scratch_path(t.spark, name) for name in ("staged", "stream", "run"))
    ranges = df.repartitionByRange(batches * FILES, order).sortWithinPartitions(order).withColumn("__range", F.spark_partition_id())
    ranges.write.parquet(staged)
    rows = t.spark.read.parquet(staged)
    out = None
    for b in range(batches):
        first = b * FILES
        last = F.lit(True) if b == batches - 1 else F.col("__range") < first + FILES
        rows.where((F.col("__range") >= first) & last).drop("__range").write.mode("append").parquet(path)
        out = H.run_available(stream(t.spark.readStream.schema(df.schema).parquet(path)), mode, sink, at)
    return out


def calls(t):
    kind = F.when(F.col("event_type") == "view", N.START).when(F.col("event_type") == "click", N.END)
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("request"), kind.alias("event"))
    return e.filter("event is not null")


def closed(e, top, *rows):
    """The events and, a day after the last, rows that move the watermark beyond all of them; they are left out again."""
    last = e.agg((F.max(top) + F.expr("interval 1 day")).alias("__top"))
    return e.unionByName(last.select(F.inline(F.array(*[F.struct(*[(F.col("__top") if v is None else F.lit(v)).cast(e.schema[c].dataType).alias(c) for c, v in zip(e.columns, r)]) for r in rows]))))


@query("h01_pair_events_stream", """
with e as (select event_id, ts, cast(user_id as varchar) as request, event_type from events)
select s.request, cast(epoch_us(s.ts) as bigint) as start_us, cast(epoch_us(c.ts) as bigint) as end_us, c.ts is not null as matched
from e s left join e c on c.event_type = 'click' and c.request = s.request and c.ts >= s.ts and c.ts <= s.ts + interval 1 hour
where s.event_type = 'view'""")
def _(t):
    """Every start, matched or not."""
    e = closed(calls(t), "ts", (-1, None, END, N.START), (-2, None, END, N.END))
    out = run(t, e, "ts", H.pair_events_stream, "append").filter(F.col("request") != END)
    return out.select("request", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "matched")


@query("h02_running_accuracy_stream", """
select 'quality' as tool, cast(count(*) as bigint) as total, cast(sum(quality) as bigint) as correct, round(sum(quality) / count(*), 6) as accuracy from labels
union all select 'clean', cast(count(*) as bigint), cast(count(*) filter (toxic = 0) as bigint), round(count(*) filter (toxic = 0) / count(*), 6) from labels""")
def _(t):
    none = F.lit(None).cast("double")
    pairs = F.array(
        F.struct(F.lit("quality").alias("tool"), (F.col("quality") == 1).alias("correct_bool"), none.alias("correct_num")),
        F.struct(F.lit("clean").alias("tool"), F.lit(None).cast("boolean").alias("correct_bool"), F.when(F.col("toxic") == 0, 100.0).otherwise(10.0).alias("correct_num")),
    )
    s = t.labels.select("doc_id", F.inline(pairs))
    return run(t, s, "doc_id", H.running_accuracy_stream, "complete")


@query("h03_latency_windows", """
select cast(epoch_us(date_trunc('hour', ts)) as bigint) as start_us, event_type, cast(count(*) as bigint) as calls, cast(sum(cast(value as decimal(18,2))) as double) as total, cast(max(cast(value as decimal(18,2))) as double) as worst
from events group by 1, 2""")
def _(t):
    """Every window; cents as decimals, so that the sum has one value in any order."""
    e = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("decimal(18,2)").alias("value"))
    out = run(t, closed(e, "ts", (None, END, 0)), "ts", H.latency_windows, "append").filter(F.col("event_type") != END)
    return out.select(F.unix_micros("window_start").alias("start_us"), "event_type", "calls", F.col("total").cast("double").alias("total"), F.col("worst").cast("double").alias("worst"))


@query("h04_segment_stream", """
select user_id as run, event_id as line, cast(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as segment from events""")
def _(t):
    e = t.events.select(F.col("user_id").alias("run"), F.col("event_id").alias("line"), (F.col("event_type") == "purchase").cast("int").alias("marker"))
    sink, out = H.segment_sink(t.spark)
    run(t, e, "line", lambda rows: rows, "append", sink)
    return t.spark.read.parquet(out).drop("batch")
