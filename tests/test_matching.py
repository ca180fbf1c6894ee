import itertools
import random

import pytest
from pyspark.sql import functions as F

from foliotab.functions.matching import contains_join, nearest_names, similar_names


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("cut", [0.6, 0.8])
def test_similar_names(spark, cut):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, 14))).strip() or "a"
    left, right = {word() for _ in range(60)} | {"aaaa", "abab"}, {word() for _ in range(60)} | {"aaab", "baba"}
    df = lambda s, c: spark.createDataFrame([(x,) for x in s], f"{c} string")
    got = similar_names(df(left, "l"), "l", df(right, "r"), "r", cut).collect()
    want = {(a, b) for a, b in itertools.product(left, right) if 1 - edit(a, b) / max(len(a), len(b)) >= cut}
    assert {(r.left_name, r.right_name) for r in got} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("levels", [(), (0.9, 0.8, 0.7)])
def test_nearest_names(spark, levels):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randrange(4, 16))).strip() + "x" for _ in range(25)]
    bend = lambda s: "".join(c if rnd.random() > 0.12 else rnd.choice("abz") for c in s)
    left, right = {bend(x) for x in base} | {"A", "qqqqqqqq"}, {bend(x) for x in base for _ in range(5)} | {"", "a"}
    df = lambda s, c: spark.createDataFrame([(x,) for x in s] + [(None,)], f"{c} string")
    got = {(r.left_name, r["rank"]): r.right_name for r in nearest_names(df(left, "l"), "l", df(right, "r"), "r", 0.6, 3, levels).collect()}
    want = {}
    for a in left:
        a = a.lower()
        scored = sorted((-round(1 - edit(a, b) / max(len(a), len(b)), 9), b) for b in right if b and 1 - edit(a, b) / max(len(a), len(b)) >= 0.6)
        want |= {(a, i): b for i, (_, b) in enumerate(scored[:3], 1)}
    assert got == want


def test_contains_join(spark):
    rnd = random.Random(2)
    words = ["alpha", "beta", "gam", "d", "Epsilon.", "ze\nta"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 25))) for _ in range(60)]
    needles = [t[rnd.randrange(len(t)) :][: rnd.randrange(1, 60)] for t in texts if t] + ["", "zzz", "alpha beta gam d beta nothing", "a"]
    n = spark.createDataFrame(list(enumerate(needles)), "i long, needle string")
    h = spark.createDataFrame(list(enumerate(texts)), "j long, text string")
    got = sorted((r.i, r.j) for r in contains_join(n, "needle", h, "text").select("i", "j").collect())
    assert got == sorted((i, j) for i, x in enumerate(needles) for j, y in enumerate(texts) if x and x in y)


def test_contains_join_is_no_cross_join(spark):
    a = spark.range(10).select(F.col("id").cast("string").alias("n"))
    plan = contains_join(a, "n", a.select(F.concat("n", F.lit("x")).alias("t")), "t")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
