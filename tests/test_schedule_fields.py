"""Fields of schedule objects, all types from one gathering of a day's points."""

from foliotab.operators import schedules
from foliotab.plans import load, registry


def test_a_days_points_are_gathered_once(spark):
    load()
    plan = registry.QUERIES["f24_from_points"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # one row per minute, then the days


def test_constant_is_the_smallest_of_the_values_used_most(spark):
    days = {1: [3.0, 1.0, 3.0, 1.0, 2.0], 2: [-0.0, 5.0, 0.0], 3: [None, None, 4.0], 4: [7.0]}
    rows = [(k, i, v) for k, values in days.items() for i, v in enumerate(values)]
    points = spark.createDataFrame(rows, "k int, minute int, value double")
    got = {r.k: r.value for r in schedules.from_points(points, ["k"], "Schedule:Constant").collect()}
    assert got == {1: "1.0", 2: "0.0", 3: None, 4: "7.0"}
