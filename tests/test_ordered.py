"""Two-level windows against the plain ones, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliotab.functions import ordered


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", rnd.randrange(400), i, rnd.choice([None, 1, 2, 5]), rnd.choice([None, "a", "b"])) for i in range(1500)]
    return spark.createDataFrame(rows, "k string, t long, id long, x long, s string").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_running_and_position(data, width):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(ordered.running_sum(data, ["k"], "t", {"r": F.col("x")}, ["id"], width), data.withColumn("r", F.sum("x").over(w)))
    same(ordered.position(data, ["k"], "t", "p", ["id"], width), data.withColumn("p", F.count("*").over(w)))


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_carry_forward(data, width):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(ordered.carry_forward(data, ["k"], "t", {"c": F.col("s")}, ["id"], width), data.withColumn("c", F.last("s", True).over(w)))


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_neighbours(data, width):
    w = Window.partitionBy("k").orderBy("t", "id")
    got = ordered.neighbours(data, ["k"], "t", {"a": F.col("s")}, {"b": F.col("x")}, ["id"], width)
    same(got, data.withColumn("a", F.lag("s").over(w)).withColumn("b", F.lead("x").over(w)))


def test_no_keys_and_global_position(data):
    w = Window.partitionBy(F.lit(0)).orderBy("t", "id")
    same(ordered.position(data, [], "t", "p", ["id"], 50), data.withColumn("p", F.row_number().over(w).cast("long")))
    same(ordered.global_position(data, ["t", "id"], "p"), data.withColumn("p", F.row_number().over(w).cast("long")))


def test_best_row(data):
    w = Window.partitionBy("k").orderBy(F.col("t").desc(), "id")
    want = data.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    same(ordered.best_row(data, ["k"], F.struct("t", -F.col("id"))), want)
