"""F15-F24: schedules from the event stream. A user's day is a schedule, each event a point."""

from pyspark.sql import functions as F

from ..operators import schedules as H
from .registry import query

KEYS = ["user_id", "day"]


def points(t):
    ts = F.col("ts").cast("timestamp")
    us = F.unix_micros(ts)
    minute = F.floor(us / 60_000_000) % 1440
    p = t.events.select("event_id", "user_id", F.floor(us / 86_400_000_000).alias("day"), minute.cast("int").alias("minute"), (F.floor("value") % 3).cast("double").alias("value"))
    return H.day_points(p.filter("value is not null"), KEYS, "event_id")


POINTS = """
with e as (select event_id, user_id, epoch_us(ts) // 86400000000 as day, cast(epoch_us(ts) // 60000000 % 1440 as int) as minute, cast(floor(value) % 3 as double) as value from events where value is not null),
p as (select user_id, day, minute, arg_max(value, event_id) as value from e group by all)
"""
HOURS = POINTS + """, k as (select user_id, day, arg_min(value, minute) as first_value_ from p group by all),
w as (select k.*, cast(hour as int) as hour, cast(hour * 60 as int) as at from k, range(0, 24) r(hour)),
h as materialized (select w.user_id, w.day, w.hour, coalesce(p.value, w.first_value_) as value
  from w asof left join p on p.user_id = w.user_id and p.day = w.day and w.at >= p.minute)
"""


@query("f15_hourly_points", """
select o_orderkey, cast(h as int) as hour, case when h % 5 = 0 then 0.0 else cast(o_custkey % 7 + h as double) end as value from orders, range(1, 25) r(h)""")
def _(t):
    cols = [(F.lit("n/a") if h % 5 == 0 else (F.col("o_custkey") % 7 + h).cast("string")).alias(f"Hour_{h}") for h in range(1, 25)]
    return H.hourly_points(t.orders.select("o_orderkey", *cols), ["o_orderkey"])


@query("f15_hourly_stats", """
with v as (select o_orderkey, case when h % 5 = 0 then 0.0 else o_custkey % 7 + h end as value from orders, range(1, 25) r(h))
select o_orderkey, cast(24 as bigint) as points, cast(min(value) as double) as low, cast(max(value) as double) as high, round(cast(sum(value) as double) / 24, 6) as mean from v group by o_orderkey""")
def _(t):
    cols = [(F.lit("n/a") if h % 5 == 0 else (F.col("o_custkey") % 7 + h).cast("string")).alias(f"Hour_{h}") for h in range(1, 25)]
    return H.point_stats(H.hourly_points(t.orders.select("o_orderkey", *cols), ["o_orderkey"]), ["o_orderkey"])


@query("f16_interval_points", """
with x as (select o_orderkey, o_custkey % 9 as a, i, case when i = 3 and o_custkey % 4 = 0 then '' when i = 1 and o_custkey % 4 = 1 then '99:00' else 'x' end as kind from orders, range(0, 5) r(i))
select o_orderkey, cast(i as int) as seq, cast((4 * i + 4) * 60 as int) as minute, cast(a + i as double) as value from x
where kind = 'x' and not (i > 3 and exists (select 1 from x y where y.o_orderkey = x.o_orderkey and y.kind = ''))""")
def _(t):
    n = F.col("o_custkey") % 4
    label = lambda i: F.lit(f"Until: {4 * i + 4}:00")
    times = [label(0), F.when(n == 1, "99:00").otherwise(label(1)), label(2), F.when(n == 0, "").otherwise(label(3)), label(4)]
    values = F.array(*[((F.col("o_custkey") % 9) + i).cast("string") for i in range(5)])
    v = t.orders.select("o_orderkey", F.array(*times).alias("times"), values.alias("vals"))
    return H.interval_points(v, ["o_orderkey"], F.col("times"), F.col("vals"))


@query("f17_list_points", """
with x as (select o_orderkey, case when o_custkey % 5 = 0 then 60 else cast(o_custkey % 5 * 15 as int) end as step, i, case when i = 2 then 0.0 else cast(o_custkey % 7 + i as double) end as value from orders, range(0, 6) r(i))
select o_orderkey, cast(i as int) as seq, cast(i * step as int) as minute, lpad(cast(i * step // 60 % 24 as varchar), 2, '0') || ':' || lpad(cast(i * step % 60 as varchar), 2, '0') as label, value from x""")
def _(t):
    vals = F.array(*[F.lit("bad") if i == 2 else ((F.col("o_custkey") % 7) + i).cast("string") for i in range(6)])
    v = t.orders.select("o_orderkey", (F.col("o_custkey") % 5 * 15).cast("int").alias("m"), vals.alias("vals"))
    return H.list_points(v, ["o_orderkey"], F.col("vals"), F.col("m"))


@query("f18_compact_points", """
with e as (select event_id, user_id, event_type, cast(event_id % 24 as int) as h, cast(floor(value) as bigint) as v from events),
x as (select *, max(case when event_type = 'purchase' then event_id end) over w as p_at, max(case when event_type = 'click' then event_id end) over w as d_at,
    last_value(case when event_type = 'purchase' then event_id % 12 + 1 || '/28' end ignore nulls) over w as period, last_value(case when event_type = 'click' then 'Day' || event_id % 7 end ignore nulls) over w as day_type
  from e window w as (partition by user_id order by event_id rows unbounded preceding))
select user_id, event_id as field_idx, period, day_type, h || ':00' as until, h * 60 as minute, cast(v as double) as value from x where event_type = 'view' and d_at > p_at and v is not null""")
def _(t):
    n = F.col("event_id")
    s = lambda c: c.cast("string")
    text = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("Through: "), s(n % 12 + 1), F.lit("/28")))
        .when(F.col("event_type") == "click", F.concat(F.lit("For: Day"), s(n % 7)))
        .when(F.col("event_type") == "view", F.concat(F.lit("Until: "), s(n % 24), F.lit(":00,"), F.coalesce(s(F.floor("value")), F.lit("none"))))
        .otherwise("note")
    )
    return H.compact_points(t.events.select("user_id", n.alias("field_idx"), text.alias("value")), ["user_id"])


@query("f18_constant_point", """
select o_orderkey, 0 as minute, case o_orderkey % 4 when 0 then 0.0 when 1 then 0.0 when 2 then null else cast(o_custkey as double) end as value from orders""")
def _(t):
    """Schedules of one value: missing, empty, no number, a number."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 1, "").when(k == 2, "on").when(k == 3, F.col("o_custkey").cast("string"))
    return H.constant_point(t.orders.select("o_orderkey", text.alias("value")), ["o_orderkey"], "value")


@query("f20_rle_hours", POINTS + """
, n as (select *, lead(minute) over (partition by user_id, day order by minute) as next_minute, row_number() over (partition by user_id, day order by minute) as k from p),
spans as (select user_id, day, value, case when k = 1 then 0 else cast(ceil(minute / 60.0) as int) end as first_hour, coalesce(cast(ceil(next_minute / 60.0) as int), 24) as end_hour from n),
s as (select * from spans where first_hour < end_hour),
c as (select *, case when value is distinct from lag(value) over w then 1 else 0 end as flag from s window w as (partition by user_id, day order by first_hour)),
r as (select *, sum(flag) over (partition by user_id, day order by first_hour) as run from c),
u as (select user_id, day, cast(run as int) as seq, max(end_hour) as until, min(value) as value from r group by user_id, day, run
  union all select user_id, day, 0, 0, value from s where first_hour = 0)
select user_id, day, seq, lpad(cast(until as varchar), 2, '0') || ':00' as until, value from u""")
def _(t):
    return H.rle_hours(H.expand_hours(points(t), KEYS), KEYS)


@query("f21_expand_hours", HOURS + "select * from h")
def _(t):
    return H.expand_hours(points(t), KEYS)


@query("f22_modify_points", POINTS + """
, s as (select user_id, day, minute, value from p where minute < 480 or minute > 1020
  union all select distinct user_id, day, 480, 9.0 from p
  union all select user_id, day, 1020, coalesce(arg_max(value, minute) filter (minute <= 1020), 0.0) from p group by user_id, day)
select 'set' as op, user_id, day, minute, value from s
union all select 'off', user_id, day, minute, value from p where minute < 720 union all select distinct 'off', user_id, day, 720, 0.0 from p
union all select 'increase', user_id, day, minute, case when minute >= 60 and minute < 600 then value * 1.5 else value end from p""")
def _(t):
    p = points(t)
    parts = [
        H.modify_points(p, KEYS, "set", 480, 1020, 9.0).withColumn("op", F.lit("set")),
        H.modify_points(p, KEYS, "off", 720, 1440).withColumn("op", F.lit("off")),
        H.modify_points(p, KEYS, "increase", 60, 600, 50.0).withColumn("op", F.lit("increase")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f23_best_schedule_type", POINTS + """
select user_id, day, case when count(distinct value) = 1 then 'Schedule:Constant' when count(*) <= 4 then 'Schedule:Day:Interval' else 'Schedule:Day:Hourly' end as schedule_type, cast(count(*) as bigint) as points
from p group by user_id, day""")
def _(t):
    return H.best_schedule_type(points(t), KEYS)


@query("f24_from_points", HOURS + """
, n as (select user_id, day, value, count(*) as n from p group by all), q as (select *, row_number() over (partition by user_id, day order by minute) - 1 as i from p)
select 'constant' as target, user_id, day, 0 as field_idx, 'Hourly_Value' as field_name, cast(arg_max(value, (n, -value)) as varchar) as value from n group by user_id, day
union all select 'hourly', user_id, day, hour, 'Hour_' || (hour + 1) || '_Value', cast(value as varchar) from h
union all select distinct 'interval', user_id, day, 0, 'Interpolate_to_Timestep', 'No' from p
union all select 'interval', user_id, day, 2 * i + 1, 'Time_' || (i + 1), lpad(cast(minute // 60 as varchar), 2, '0') || ':' || lpad(cast(minute % 60 as varchar), 2, '0') from q where i < 25
union all select 'interval', user_id, day, 2 * i + 2, 'Value_Until_Time_' || (i + 1), cast(value as varchar) from q where i < 25
union all select 'compact', user_id, day, i + 2, 'Field_' || (i + 3), 'Until: ' || lpad(cast(minute // 60 as varchar), 2, '0') || ':' || lpad(cast(minute % 60 as varchar), 2, '0') || ',' || cast(value as varchar) from q
union all select distinct 'compact', user_id, day, 0, 'Field_1', 'Through: 12/31' from p
union all select distinct 'compact', user_id, day, 1, 'Field_2', 'For: WeekDays SummerDesignDay CustomDay1 CustomDay2' from p
union all select 'compact', user_id, day, count(*) + 2, 'Field_' || (count(*) + 3), 'For: Weekends WinterDesignDay Holiday' from p group by user_id, day
union all select 'compact', user_id, day, count(*) + 3, 'Field_' || (count(*) + 4), 'Until: 24:00,0.0' from p group by user_id, day""")
def _(t):
    kinds = {"constant": "Schedule:Constant", "hourly": "Schedule:Day:Hourly", "interval": "Schedule:Day:Interval", "compact": "Schedule:Compact"}
    return H.from_points_to(points(t), KEYS, kinds).withColumn("field_idx", F.col("field_idx").cast("bigint"))
