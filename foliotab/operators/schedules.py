"""Schedules as points (minute of day, value).

A day has at most 1441 different minutes, so a schedule's points of one day fit a task once they are one row per
minute; ``day_points`` enforces that before anything is gathered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.text import clock, minutes_of_day

# Schedule object types and their groups, and the day types of a week.
SCHEDULE_GROUPS = {
    "ScheduleTypeLimits": "schedule_type_limits",
    "Schedule:Day:Hourly": "day_schedules",
    "Schedule:Day:Interval": "day_schedules",
    "Schedule:Day:List": "day_schedules",
    "Schedule:Week:Daily": "week_schedules",
    "Schedule:Week:Compact": "week_schedules",
    "Schedule:Year": "annual_schedules",
    "Schedule:Compact": "annual_schedules",
    "Schedule:Constant": "annual_schedules",
    "Schedule:File": "annual_schedules",
    "Schedule:File:Shading": "other_schedules",
}
DAY_TYPES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Holiday", "SummerDesignDay", "WinterDesignDay", "CustomDay1", "CustomDay2"]


def schedule_inventory(objects: DataFrame) -> DataFrame:
    """Per model and schedule group: objects, types found."""
    group = F.create_map(*[F.lit(x) for kv in SCHEDULE_GROUPS.items() for x in kv])[F.col("obj_type")]
    o = objects.select("model", "obj_type", "obj_idx").distinct().withColumn("schedule_group", group).filter(F.col("schedule_group").isNotNull())
    return o.groupBy("model", "schedule_group").agg(F.count("*").alias("objects"), F.array_join(F.sort_array(F.collect_set("obj_type")), ",").alias("types"))


# Columns of the inventory as (field, types that have it, value where it is missing), and fields that hold values.
UNSET = "Not specified"
_LIMITED = ("Schedule:Day:Hourly", "Schedule:Day:Interval", "Schedule:Day:List", "Schedule:Year", "Schedule:Compact", "Schedule:Constant", "Schedule:File")
DETAILS = {
    "type_limits": ("Schedule_Type_Limits_Name", _LIMITED, UNSET),
    "lower_limit": ("Lower_Limit_Value", ("ScheduleTypeLimits",), UNSET),
    "upper_limit": ("Upper_Limit_Value", ("ScheduleTypeLimits",), UNSET),
    "numeric_type": ("Numeric_Type", ("ScheduleTypeLimits",), UNSET),
    "unit_type": ("Unit_Type", ("ScheduleTypeLimits",), UNSET),
    "interpolate": ("Interpolate_to_Timestep", ("Schedule:Day:Interval", "Schedule:Day:List"), "No"),
    "minutes_per_item": ("Minutes_Per_Item", ("Schedule:Day:List",), UNSET),
    "hourly_value": ("Hourly_Value", ("Schedule:Constant",), UNSET),
    "file_name": ("File_Name", ("Schedule:File", "Schedule:File:Shading"), UNSET),
    "column_number": ("Column_Number", ("Schedule:File",), UNSET),
    "number_of_hours": ("Number_of_Hours_of_Data", ("Schedule:File",), UNSET),
}
VALUE_FIELDS = {"Schedule:Day:Hourly": r"Hour_\d+", "Schedule:Day:Interval": r"Value_Until_Time_\d+", "Schedule:Day:List": r"Value_\d+", "Schedule:Compact": r"Field_\d+", "Schedule:Constant": "Hourly_Value"}
FILES = ("Schedule:File", "Schedule:File:Shading")


def schedule_details(objects: DataFrame) -> DataFrame:
    """One row per schedule object: group, name, the columns of its type (NULL for other types) and a summary of its values.

    ``points``, ``low`` and ``high`` are over the fields that hold numbers; a blank or invalid value of an hourly or listed
    day is 0.0, of other types it is left out, as are the words of compact schedules. ``status`` is ``values``, ``no values``,
    ``skipped`` (values in files) or NULL for types without values. One aggregate over the objects, whatever their number.
    """
    group = F.create_map(*[F.lit(x) for kv in SCHEDULE_GROUPS.items() for x in kv])[F.col("obj_type")]
    kind, field = F.col("obj_type"), F.col("field_name")
    holds = F.lit(False)
    for k, pattern in VALUE_FIELDS.items():
        holds = holds | ((kind == k) & field.rlike(f"^{pattern}$"))
    number = F.col("value").try_cast("double")
    number = F.when(holds, F.when(kind.isin("Schedule:Day:Hourly", "Schedule:Day:List"), F.coalesce(number, F.lit(0.0))).otherwise(number))
    picks = {"name": F.coalesce(F.max(F.when(field == "Name", F.col("value"))), F.lit("Unknown"))}
    for name, (source, kinds, missing) in DETAILS.items():
        picks[name] = F.when(kind.isin(list(kinds)), F.coalesce(F.max(F.when(field == source, F.col("value"))), F.lit(missing)))
    one = objects.filter(kind.isin(list(SCHEDULE_GROUPS))).groupBy("model", "obj_type", "obj_idx")
    one = one.agg(*[p.alias(n) for n, p in picks.items()], F.count(number).alias("points"), F.min(number).alias("low"), F.max(number).alias("high"))
    status = F.when(kind.isin(list(FILES)), "skipped").when(kind.isin(list(VALUE_FIELDS)), F.when(F.col("points") > 0, "values").otherwise("no values"))
    return one.withColumns({"schedule_group": group, "profile": F.when(kind == "Schedule:Day:Hourly", "24 hourly values"), "status": status})


def value_summary(details: DataFrame) -> DataFrame:
    """Per model: schedules, and how many have values, have none and are skipped."""
    counts = {"with_values": "values", "without_values": "no values", "skipped_files": "skipped"}
    return details.groupBy("model").agg(F.count("*").alias("schedules"), *[F.count_if(F.col("status") == v).alias(n) for n, v in counts.items()])


def unpivot_fields(view: DataFrame, ids: Sequence[str], fields: Mapping[str, str], name: str, value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(label).alias(name), F.col(c).alias(value)) for i, (c, label) in enumerate(fields.items())])
    return view.select(*ids, F.inline(pairs))


def week_refs(weeks: DataFrame, ids: Sequence[str], suffix: str = "_ScheduleDay_Name") -> DataFrame:
    """12 day-type references per week schedule."""
    return unpivot_fields(weeks, ids, {f"{d}{suffix}": d for d in DAY_TYPES}, "day_type", "schedule").drop("seq")


def hourly_points(view: DataFrame, ids: Sequence[str], prefix: str = "Hour_") -> DataFrame:
    """Hour_1..24 as points; blank or invalid values are 0.0."""
    long = unpivot_fields(view, ids, {f"{prefix}{h}": str(h) for h in range(1, 25)}, "hour", "raw")
    value = F.coalesce(F.col("raw").cast("string").try_cast("double"), F.lit(0.0))
    return long.select(*ids, F.col("hour").cast("int").alias("hour"), value.alias("value"))


def point_stats(points: DataFrame, ids: Sequence[str]) -> DataFrame:
    return points.groupBy(*ids).agg(
        F.count("*").alias("points"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean")
    )


def interval_points(view: DataFrame, ids: Sequence[str], times: Column, values: Column) -> DataFrame:
    """Time/value pairs up to the first blank; ``Until:`` is dropped and pairs with an invalid time are skipped."""
    pairs = F.transform(F.arrays_zip(times.alias("t"), values.alias("v")), lambda p: F.struct(p["t"].alias("t"), p["v"].alias("v")))
    v = view.select(*ids, pairs.alias("p"))
    blank = lambda p: F.coalesce(F.trim(p["t"]) == "", F.lit(True)) | F.coalesce(F.trim(p["v"]) == "", F.lit(True))
    first = F.array_position(F.transform("p", lambda p: F.coalesce(blank(p), F.lit(True))), True)
    kept = F.when(first > 0, F.slice("p", F.lit(1), first.cast("int") - 1)).otherwise(F.col("p"))
    out = v.select(*ids, F.posexplode(kept).alias("seq", "p"))
    until = F.trim(F.regexp_replace("p.t", "(?i)until:", ""))
    out = out.select(*ids, "seq", minutes_of_day(until).alias("minute"), F.col("p.v").try_cast("double").alias("value"))
    return out.filter("minute is not null and value is not null")


def list_points(view: DataFrame, ids: Sequence[str], values: Column, minutes_per_item: Column | int = 60) -> DataFrame:
    """Value_i each ``minutes_per_item``; a step outside 1..1440 becomes 60."""
    step = minutes_per_item if isinstance(minutes_per_item, Column) else F.lit(minutes_per_item)
    step = F.when(step.between(1, 1440), step).otherwise(60)
    v = view.select(*ids, step.alias("step"), F.posexplode(values).alias("seq", "raw"))
    minute = F.col("seq") * F.col("step")
    return v.select(*ids, "seq", minute.cast("int").alias("minute"), clock(minute % 1440).alias("label"), F.coalesce(F.col("raw").cast("string").try_cast("double"), F.lit(0.0)).alias("value"))


def compact_points(fields: DataFrame, keys: Sequence[str], order: str = "field_idx", value: str = "value", width: int | None = None) -> DataFrame:
    """Through / For / Until / value fields to (period, day_type, until, value).

    ``Until: 8:00,0.0`` in one field counts as two.
    """
    f = fields.select(*keys, order, F.posexplode(F.split(F.col(value), ",")).alias("part", "raw")).withColumn("raw", F.trim("raw")).filter(F.col("raw") != "")
    raw = F.col("raw")
    through = F.when(raw.startswith("Through:"), F.trim(F.substring(raw, F.lit(9), F.length(raw))))
    days = F.when(raw.startswith("For:"), F.trim(F.substring(raw, F.lit(5), F.length(raw))))
    until = F.when(raw.startswith("Until:"), F.trim(F.substring(raw, F.lit(7), F.length(raw))))
    at = F.struct(order, "part")
    f = ordered.carry_forward(
        f, keys, order,
        {"period": through, "__p_at": F.when(through.isNotNull(), at), "day_type": days, "__d_at": F.when(days.isNotNull(), at)},
        ["part"], width,
    )
    f = f.withColumn("until", until)
    f = ordered.neighbours(f, keys, order, following={"__next": F.col("raw")}, ties=["part"], width=width)
    num = F.col("__next").try_cast("double")
    live = F.col("until").isNotNull() & F.col("period").isNotNull() & (F.col("__d_at") > F.col("__p_at")) & num.isNotNull()
    return f.filter(live).select(*keys, order, "period", "day_type", "until", minutes_of_day(F.col("until")).alias("minute"), num.alias("value"))


def constant_point(view: DataFrame, ids: Sequence[str], value: str) -> DataFrame:
    """One point for all hours; a missing or empty value is 0, one that is no number NULL."""
    text = F.coalesce(F.col(value).cast("string"), F.lit(""))
    return view.select(*ids, F.lit(0).alias("minute"), F.when(text == "", 0.0).otherwise(text.try_cast("double")).alias("value"))


def day_points(points: DataFrame, keys: Sequence[str], tie: str | None = None) -> DataFrame:
    """One value per minute of day: the last one by ``tie``."""
    pick = F.max_by("value", tie) if tie else F.max("value")
    return points.groupBy(*keys, "minute").agg(pick.alias("value"))


def as_array(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points of each day in order; at most 1441 after ``day_points``."""
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("minute", "value"))).alias("points"))


def _hour_values() -> Column:
    """(hour, value) of 24 hours from ``points``."""
    at_or_before = lambda h: F.filter("points", lambda p: p["minute"] <= h * 60)
    value = lambda h: F.coalesce(F.try_element_at(at_or_before(h), F.lit(-1))["value"], F.col("points")[0]["value"])
    return F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.struct(h.alias("hour"), value(h).alias("value")))


def expand_hours(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """24 values: the last point at or before each hour, the first value before that (an as-of join)."""
    return as_array(points, keys).select(*keys, F.inline(_hour_values()))


def rle_hours(hours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal consecutive hours as (until, value), starting with 00:00; 24 rows per key at most."""
    arr = hours.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hour", "value"))).alias("h"))
    change = F.filter(
        F.sequence(F.lit(1), F.lit(24)),
        lambda i: (i == 24) | ~F.get("h", i)["value"].eqNullSafe(F.get("h", i - 1)["value"]),
    )
    runs = F.transform(change, lambda i: F.struct((i * 60).alias("until"), F.get("h", i - 1)["value"].alias("value")))
    start = F.array(F.struct(F.lit(0).alias("until"), F.col("h")[0]["value"].alias("value")))
    return arr.select(*keys, F.posexplode(F.concat(start, runs)).alias("seq", "r")).select(*keys, "seq", clock(F.col("r.until")).alias("until"), "r.value")


def modify_points(points: DataFrame, keys: Sequence[str], op: str, start: int, end: int, value: float | None = None) -> DataFrame:
    """set / on / off / increase / decrease within [start, end); day types are ignored."""
    if op in ("increase", "decrease"):
        if value is None or value < 0:
            return points
        factor = 1 + value / 100 if op == "increase" else 1 - value / 100
        inside = (F.col("minute") >= start) & (F.col("minute") < end)
        return points.withColumn("value", F.when(inside, F.col("value") * factor).otherwise(F.col("value")))
    new = {"set": value, "on": 1.0, "off": 0.0}[op]
    outside = points.filter((F.col("minute") < start) | (F.col("minute") > end)) if end != 1440 else points.filter(F.col("minute") < start)
    per = points.groupBy(*keys).agg(F.max_by("value", F.when(F.col("minute") <= end, F.col("minute"))).alias("__back"))
    added = [F.struct(F.lit(start).cast("int").alias("minute"), F.lit(float(new)).alias("value"))]
    if end != 1440:
        added.append(F.struct(F.lit(end).cast("int").alias("minute"), F.coalesce("__back", F.lit(0.0)).alias("value")))
    return outside.select(*keys, "minute", "value").unionByName(per.select(*keys, F.inline(F.array(*added))))


def best_schedule_type(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    kind = (
        F.when(F.count_distinct("value") == 1, "Schedule:Constant").when(F.count("*") <= 4, "Schedule:Day:Interval").otherwise("Schedule:Day:Hourly")
    )
    return points.groupBy(*keys).agg(kind.alias("schedule_type"), F.count("*").alias("points"))


# Fixed value: pairs of an interval object.
INTERVAL_PAIRS = 25


def from_points(points: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Fields of the target schedule type as (field_idx, field_name, value).

    An interval object holds ``INTERVAL_PAIRS`` points. A day of more, once points that repeat the value before them are
    left out, becomes one row with field_idx -1 and field_name ``error``; it is never cut short.
    """
    return from_points_to(points, keys, {target: target}).drop("target")


def from_points_to(points: DataFrame, keys: Sequence[str], targets: Mapping[str, str]) -> DataFrame:
    """``from_points`` for several schedule types by the name that ``target`` gives them; a day's points are gathered once."""
    parts = F.array(*[F.struct(F.lit(name).alias("target"), _fields(kind).alias("fields")) for name, kind in targets.items()])
    rows = as_array(points, keys).select(*keys, F.inline(parts)).select(*keys, "target", F.inline("fields"))
    return rows.select(*keys, *FIELDS, "target")


FIELDS = ("field_idx", "field_name", "value")


def _field(at: Column, name: Column, value: Column) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip((at.cast("int"), name, value.cast("string")), FIELDS)])


def _fields(target: str) -> Column:
    """Array of the fields that the ``points`` of a day give."""
    numbered = lambda before, i, after="": F.concat(F.lit(before), i.cast("string"), F.lit(after))
    once = lambda x, of: F.get(F.transform(F.array(x), of), F.lit(0))  # noqa: E731  (not anew for each element of an array)
    points = F.col("points")
    if target == "Schedule:Constant":
        # of the values used most the smallest, from the lengths of equal runs; 0 added makes one zero of both
        starts = lambda values: F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == 0) | ~F.get(values, i).eqNullSafe(F.get(values, i - 1)))
        run = lambda values, at, s, i: F.struct(F.coalesce(F.get(at, i + 1), F.size(values)) - s, -F.get(values, s), F.get(values, s).alias("value"))
        runs = lambda values: once(starts(values), lambda at: F.transform(at, lambda s, i: run(values, at, s, i)))
        most = once(F.array_sort(F.transform(points, lambda p: p["value"] + F.lit(0))), lambda values: F.array_max(runs(values))["value"])
        return F.array(_field(F.lit(0), F.lit("Hourly_Value"), most))
    if target == "Schedule:Day:Hourly":
        return F.transform(_hour_values(), lambda h: _field(h["hour"], numbered("Hour_", h["hour"] + 1, "_Value"), h["value"]))
    if target == "Schedule:Day:Interval":
        last = F.size(points) - 1
        turns = F.filter(points, lambda p, i: (i == 0) | (i == last) | ~F.get(points, i + 1)["value"].eqNullSafe(p["value"]))
        kept = F.when(F.size(points) > INTERVAL_PAIRS, turns).otherwise(points)
        said = lambda kept: F.concat(F.size(kept).cast("string"), F.lit(f" points; the object holds {INTERVAL_PAIRS}"))
        pairs = lambda kept: F.transform(kept, lambda p, i: F.array(
            _field(i * 2 + 1, numbered("Time_", i + 1), clock(p["minute"])),
            _field(i * 2 + 2, numbered("Value_Until_Time_", i + 1), p["value"]),
        ))
        head = F.array(_field(F.lit(0), F.lit("Interpolate_to_Timestep"), F.lit("No")))
        error = lambda kept: F.array(_field(F.lit(-1), F.lit("error"), said(kept)))
        return once(kept, lambda kept: F.when(F.size(kept) > INTERVAL_PAIRS, error(kept)).otherwise(F.concat(head, F.flatten(pairs(kept)))))
    if target == "Schedule:Compact":
        until = F.transform(points, lambda p: F.concat(F.lit("Until: "), clock(p["minute"]), F.lit(","), p["value"].cast("string")))
        # fixed values: weekday pattern, weekend off
        head = F.array(F.lit("Through: 12/31"), F.lit("For: WeekDays SummerDesignDay CustomDay1 CustomDay2"))
        tail = F.array(F.lit("For: Weekends WinterDesignDay Holiday"), F.lit("Until: 24:00,0.0"))
        return F.transform(F.concat(head, until, tail), lambda v, i: _field(i, numbered("Field_", i + 1), v))
    raise ValueError(f"unsupported schedule type {target}")
