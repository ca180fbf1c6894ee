"""Structured Streaming forms of pairing, running accuracy, latency and segmentation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ordered
from ..operators.runs import END, ERROR, START
from ..operators.scoring import is_correct
from ..session import scratch_path


def pair_events_stream(events: DataFrame, request: str = "request", ts: str = "ts", event: str = "event", delay: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """Left outer stream-stream join of starts and ends; an unmatched start comes out once the watermark passed it."""
    s = events.filter(F.col(event) == START).select(F.col(request).alias("request"), F.col(ts).alias("start_ts")).withWatermark("start_ts", delay)
    e = events.filter(F.col(event).isin(END, ERROR)).select(F.col(request).alias("end_request"), F.col(ts).alias("end_ts")).withWatermark("end_ts", delay)
    on = (F.col("request") == F.col("end_request")) & (F.col("end_ts") >= F.col("start_ts")) & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"interval {within}"))
    return s.join(e, on, "left_outer").select("request", "start_ts", "end_ts", F.col("end_request").isNotNull().alias("matched"))


def running_accuracy_stream(scores: DataFrame) -> DataFrame:
    """Accuracy per tool so far; state is two counters per tool."""
    return scores.groupBy("tool").agg(F.count("*").alias("total"), F.count_if(is_correct()).alias("correct")).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))


def latency_windows(events: DataFrame, ts: str = "ts", value: str = "value", key: str = "event_type", window: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Calls, total and worst latency per (sliding) window and key."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    g = events.withWatermark(ts, delay).groupBy(w, key) if events.isStreaming else events.groupBy(w, key)
    return g.agg(F.count("*").alias("calls"), F.sum(value).alias("total"), F.max(value).alias("worst")).select(
        F.col("window.start").alias("window_start"), key, "calls", "total", "worst"
    )


def segment_sink(spark: SparkSession, key: str = "run", order: str = "line", marker: str = "marker", width: int | None = None) -> tuple[Callable[[DataFrame, int], None], str]:
    """Sink of a log stream, and the folder where it leaves (key, order, segment): the number of markers of the run so far.

    Lines of a run are taken in ``order`` inside a micro-batch, by two-level sums, so that a run of any length spreads over
    tasks; batches follow the log. The markers of earlier batches come from a table of one row per run that each batch
    writes anew, under its own number: a batch that is run again after a failure gives the same rows.
    """
    out, seen = scratch_path(spark, "segments"), scratch_path(spark, "seen")

    def sink(batch: DataFrame, i: int) -> None:
        kind = batch.schema[key].dataType.simpleString()
        before = spark.read.parquet(f"{seen}/{i - 1}") if i else spark.createDataFrame([], f"{key} {kind}, __seen bigint")
        rows = batch.select(key, order, F.col(marker).cast("bigint").alias("__m"))
        summed = ordered.running_sum(rows, [key], order, {"__own": F.col("__m")}, width=width).join(before, key, "left")
        summed.select(key, order, (F.col("__own") + F.coalesce("__seen", F.lit(0))).alias("segment")).write.mode("overwrite").parquet(f"{out}/batch={i:09d}")
        now = rows.groupBy(key).agg(F.sum("__m").alias("__seen")).unionByName(before).groupBy(key).agg(F.sum("__seen").alias("__seen"))
        now.write.mode("overwrite").parquet(f"{seen}/{i}")

    return sink, out


def run_available(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None] | None = None, at: str | None = None) -> DataFrame | None:
    """Run a stream over what its source holds now and return what it wrote.

    ``at`` is the folder of its state and output; a later run with the same folder goes on where the one before ended, as
    after a restart. Append output goes to a file sink; complete and update output keep the last batch per id. With a ``sink`` of its own
    nothing is read back.
    """
    spark = stream.sparkSession
    at = at or scratch_path(spark, "run")
    out, ckpt = f"{at}/out", f"{at}/ckpt"
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", ckpt).outputMode(mode)
    if mode == "append" and sink is None:
        q = w.format("parquet").option("path", out).start()
    else:
        q = w.foreachBatch(sink or (lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i:09d}"))).start()
    q.awaitTermination()
    if sink is not None:
        return None
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    b = spark.read.option("basePath", out).parquet(out)
    last = b.agg(F.max("batch").alias("__b"))
    return b.join(F.broadcast(last), F.col("batch") == F.col("__b")).drop("batch", "__b")
