"""No cap, prefix or switch on size drops data; shared folders are asked for where they are needed."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliotab import session
from foliotab.functions.text import significant_digits
from foliotab.operators import alignment, outputs, runs, schedules, vectors
from foliotab.operators.sqlrun import transform_sql
from foliotab.streaming import events as stream


def test_long_schedule_fields(spark):
    long = "x" * 2000
    rows = [(1, 0, f"Through: {long}"), (1, 1, f"For: {long}y"), (1, 2, "Until: 8:00"), (1, 3, "2.5")]
    got = schedules.compact_points(spark.createDataFrame(rows, "k int, field_idx int, value string"), ["k"]).first()
    assert (got.period, got.day_type, got.value) == (long, long + "y", 2.5)


def test_more_points_than_an_interval_object_holds(spark):
    rows = [(1, 10 * i, float(i)) for i in range(30)] + [(2, 10 * i, float(i // 10)) for i in range(30)]
    out = schedules.from_points(spark.createDataFrame(rows, "k int, minute int, value double"), ["k"], "Schedule:Day:Interval")
    first = out.filter("k = 1").collect()
    assert [(r.field_idx, r.field_name, r.value) for r in first] == [(-1, "error", "30 points; the object holds 25")]
    second = {r.field_name: r.value for r in out.filter("k = 2").collect()}
    assert [second[f"Value_Until_Time_{i}"] for i in (1, 2, 3, 4)] == ["0.0", "0.0", "1.0", "2.0"]


def test_significant_digits_of_doubles(spark):
    values = [12345678.0, 1234567.0, 0.00012, 5.0, 1.25e-7, 100.0]
    d = spark.createDataFrame([(v,) for v in values], "v double").select(significant_digits(F.col("v"), T.DoubleType()).alias("n"))
    assert [r.n for r in d.collect()] == [8, 7, 2, 1, 3, 3]
    assert spark.range(1).select(significant_digits(F.lit("5.0")).alias("n")).first().n == 2


def test_text_ids_from_chunks_to_context(spark):
    chunks = [(f"d__chunk_{i}", [float(i == j) + 0.1 * j for j in range(4)], f"text {i}") for i in range(4)]
    x = spark.createDataFrame(chunks, "id string, v array<double>, text string")
    hits = vectors.knn(x.filter("id = 'd__chunk_2'").select("id", "v"), x.select("id", "v"), 2)
    got = vectors.context_text(hits, x.select(F.col("id").alias("vec_id"), "text")).first()
    assert got.query_id == "d__chunk_2" and got.context.startswith("[1] text 2\n\n[2] text ")
    graph = vectors.chunk_graph(x.select(F.lit("d").alias("doc"), "id", "v", F.substring("id", 10, 9).cast("int").alias("k")), 1, 0.0, order="k")
    assert graph.filter("edge_type = 'sequential'").count() == 3


def test_carriage_return_is_no_new_line(spark):
    d = spark.createDataFrame([(1, "one two\rThree"), (2, "one two\nThree")], "id int, text string")
    n = {r.id: r.n for r in alignment.sentences(alignment.tokenize(d)).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 1, 2: 2}


@pytest.mark.parametrize(
    "text",
    [
        "FROM v INSERT INTO w SELECT *",
        "WITH x AS (SELECT 1 AS a) FROM x INSERT INTO t SELECT a",
        "WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT a FROM x",
        "TABLE v; DROP TABLE v",
    ],
)
def test_no_write_gets_through(spark, text):
    assert transform_sql(spark, text, {"v": spark.range(2)}).frame is None


def test_views_do_not_stay(spark):
    spark.range(5).createOrReplaceTempView("kept_view")
    a = transform_sql(spark, "select count(*) n from kept_view", {"kept_view": spark.range(2)}).frame
    assert a.first().n == 2 and spark.table("kept_view").count() == 5
    assert transform_sql(spark, "select 1 from gone_view", {"gone_view": spark.range(2)}).error is None
    assert not spark.catalog.tableExists("gone_view")
    spark.catalog.dropTempView("kept_view")


def test_exact_quantiles(spark):
    d = spark.createDataFrame([(1, float(i), 1) for i in range(1, 101)], "k int, response_ms double, total_tokens int")
    got = runs.latency_tokens(d, ["k"], approximate=False).first()
    assert (got.p50, got.p95) == (50.0, 95.0)


def test_suggestions_have_one_path(spark):
    cat = spark.createDataFrame([("Zone Air Temperature",), ("Zone Air Humidity",), ("Boiler",)], "name string")
    got = outputs.suggestions(spark.createDataFrame([("zone air temperatur",)], "n string"), "n", cat).collect()
    assert [(r.suggestion, r["rank"]) for r in got] == [("zone air temperature", 1)]


def test_segments_over_batches(spark):
    sink, out = stream.segment_sink(spark)
    rows = [(r, i, int((i * 7 + r) % 3 == 0)) for r in range(3) for i in range(40)]
    for b in range(4):
        part = [x for x in rows if x[1] // 10 == b]
        for _ in range(2 if b == 2 else 1):  # a batch that runs again
            sink(spark.createDataFrame(part, "run long, line long, marker int"), b)
    got = {(r.run, r.line): r.segment for r in spark.read.parquet(out).collect()}
    assert got == {(r, i): sum(m for q, j, m in rows if q == r and j <= i) for r, i, _ in rows}


def test_shared_folder_is_asked_for_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=sc))
