"""R: the relational core reachable through the SQL entry point."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import TIME_WIDTH_US, count_in_range
from ..operators.sqlrun import sql, transform_sql
from .registry import query

MONEY = "cast(cast({} as decimal(18,2)) as {})"


def same(name: str, text: str, *tables: str, oracle: str | None = None):
    """One statement that both engines accept."""

    @query(name, oracle or text)
    def _(t):
        return sql(t.spark, text, **{n: getattr(t, n) for n in tables})


@query("e01_transform_sql", """
select l_returnflag as flag, cast(count(*) as bigint) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity
from lineitem group by l_returnflag union all select 'error', 1, null union all select 'rejected', 1, null""")
def _(t):
    good = transform_sql(
        t.spark,
        "select l_returnflag as flag, count(*) as n, sum(cast(l_quantity as bigint)) as quantity from evidence group by l_returnflag",
        {"evidence": t.lineitem},
    )
    bad = transform_sql(t.spark, "select no_such_column from evidence", {"evidence": t.lineitem})
    no = transform_sql(t.spark, "delete from evidence", {})
    notes = good.frame.limit(0)
    assert bad.error and no.error
    for label in ("error", "rejected"):
        notes = notes.union(t.spark.sql(f"select '{label}' as flag, 1L as n, cast(null as bigint) as quantity"))
    return good.frame.union(notes)


same("r01_projection", """
select l_orderkey, l_linenumber, cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as double) as net,
  case when l_quantity >= 40 then 'large' when l_quantity >= 20 then 'medium' else 'small' end as size
from lineitem where l_returnflag <> 'N' and l_discount between 0.02 and 0.08""", "lineitem")

same("r02_joins", """
select o.o_orderkey, c.c_name, n.n_name, r.r_name, o.o_orderstatus
from orders o join customer c on o.o_custkey = c.c_custkey
  left join nation n on n.n_nationkey = c.c_nationkey and n.n_regionkey <> 2
  left join region r on r.r_regionkey = n.n_regionkey""", "orders", "customer", "nation", "region")

same("r02_full_join", """
with c as (select c_nationkey as k, cast(count(*) as bigint) as customers from customer where c_acctbal < 0 group by c_nationkey),
  s as (select s_nationkey as k, cast(count(*) as bigint) as suppliers from supplier group by s_nationkey)
select coalesce(c.k, s.k) as nationkey, customers, suppliers from c full outer join s on c.k = s.k""", "customer", "supplier")

same("r03_semi_anti", """
select c_custkey, 'with' as kind from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')
union all
select c_custkey, 'without' as kind from customer where not exists (select 1 from orders where o_custkey = c_custkey)""", "customer", "orders")


@query("r04_range_join", """
select a.event_id, cast(count(b.event_id) as bigint) as clicks_before
from events a left join events b on b.user_id = a.user_id and b.event_type = 'click'
  and b.ts >= a.ts - interval 1 hour and b.ts < a.ts
where a.event_type = 'purchase' group by a.event_id""")
def _(t):
    """Range join as an equi join on (user, hour): a one-hour reach touches two hour buckets only."""
    hour = 3600 * 1_000_000
    e = t.events.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "us")
    probe = left.withColumn("h", F.explode(F.array(F.floor(F.col("us") / hour), F.floor(F.col("us") / hour) - 1)))
    right = e.filter("event_type = 'click'").select(
        F.col("user_id").alias("r_user"), F.col("us").alias("r_us"), F.floor(F.col("us") / hour).alias("r_h")
    )
    inside = (F.col("r_us") >= F.col("us") - hour) & (F.col("r_us") < F.col("us"))
    hits = probe.join(right, (F.col("user_id") == F.col("r_user")) & (F.col("h") == F.col("r_h")) & inside)
    counts = hits.groupBy("event_id").agg(F.count("*").alias("clicks_before"))
    return left.select("event_id").join(counts, "event_id", "left").fillna({"clicks_before": 0})


@query("r04_range_count", """
select a.event_id, cast(count(b.event_id) as bigint) as clicks_before
from events a left join events b on b.user_id = a.user_id and b.event_type = 'click'
  and b.ts >= a.ts - interval 1 hour and b.ts < a.ts
where a.event_type = 'purchase' group by a.event_id""")
def _(t):
    """The same answer from two running counts: no pairs, so a user with most events is no problem."""
    e = t.events.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return count_in_range(
        e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), ["user_id"], "us", "event_id", 3600 * 1_000_000, "clicks_before", TIME_WIDTH_US
    )


same("r05_aggregate", """
select l_returnflag, l_linestatus, cast(count(*) as bigint) as n, cast(count(distinct l_suppkey) as bigint) as suppliers,
  cast(sum(cast(l_quantity as bigint)) as bigint) as quantity, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as price
from lineitem where l_quantity > 5 group by l_returnflag, l_linestatus having count(*) > 10""", "lineitem")

same("r06_cube", """
select o_orderstatus, o_orderpriority, cast(grouping(o_orderstatus) as int) as all_status, cast(grouping(o_orderpriority) as int) as all_priority,
  cast(count(*) as bigint) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total
from orders group by cube(o_orderstatus, o_orderpriority)""", "orders")

same("r06_rollup", """
select n.n_regionkey, c.c_mktsegment, cast(count(*) as bigint) as n
from customer c join nation n on n.n_nationkey = c.c_nationkey group by rollup(n.n_regionkey, c.c_mktsegment)""", "customer", "nation")

same("r06_grouping_sets", """
select l_returnflag, l_linestatus, l_linenumber, cast(count(*) as bigint) as n from lineitem
group by grouping sets ((l_returnflag, l_linestatus), (l_linenumber), ())""", "lineitem")

same("r07_windows", """
select o_orderkey, row_number() over w as k, lag(o_totalprice) over w as previous,
  round(max(o_totalprice) over (partition by o_custkey), 2) as top,
  cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as double) as last3
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""", "orders",
     oracle="""
select o_orderkey, cast(row_number() over w as int) as k, lag(o_totalprice) over w as previous,
  round(max(o_totalprice) over (partition by o_custkey), 2) as top,
  cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as double) as last3
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")

same("r08_top_k", """
select l_returnflag, l_orderkey, l_linenumber, l_extendedprice from (
  select l_returnflag, l_orderkey, l_linenumber, l_extendedprice,
    row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber) as k
  from lineitem) where k <= 10""", "lineitem")

same("r08_sort_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25", "orders")

same("r09_set_operations", """
(select c_nationkey as k, 'both' as kind from customer intersect select s_nationkey, 'both' from supplier)
union all (select c_nationkey, 'customers only' from customer where c_acctbal < 0 except select s_nationkey, 'customers only' from supplier where s_acctbal < 1000)
union all (select k, 'all' from (select c_nationkey as k from customer union select s_nationkey from supplier) u)""", "customer", "supplier")

same("r10_subqueries", """
with spend as (select o_custkey, sum(cast(o_totalprice as decimal(18,2))) as total from orders group by o_custkey)
select c.c_custkey, cast(s.total as double) as total, (select count(*) from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P') as pending
from customer c join spend s on s.o_custkey = c.c_custkey where s.total > (select avg(total) from spend)""", "customer", "orders")

same("r11_functions", """
select p_partkey, upper(p_name) as name, length(p_type) as n, regexp_extract(p_brand, '#([0-9]+)', 1) as brand_no,
  replace(p_name, ' ', '_') as slug, round(sqrt(p_retailprice), 4) as root, p_partkey % 7 as m,
  case when p_type like 'ECON%' then 'cheap' else lower(p_type) end as kind, substring(p_name, 2, 3) as piece
from part""", "part", oracle="""
select p_partkey, upper(p_name) as name, cast(length(p_type) as int) as n, regexp_extract(p_brand, '#([0-9]+)', 1) as brand_no,
  replace(p_name, ' ', '_') as slug, round(sqrt(p_retailprice), 4) as root, p_partkey % 7 as m,
  case when p_type like 'ECON%' then 'cheap' else lower(p_type) end as kind, substring(p_name, 2, 3) as piece
from part""")

same("r11_dates", """
select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, quarter(o_orderdate) as q,
  datediff(date '2002-01-01', cast(o_orderdate as date)) as age, cast(date_trunc('month', o_orderdate) as date) as month_start
from orders""", "orders", oracle="""
select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(quarter(o_orderdate) as int) as q,
  cast(date_diff('day', cast(o_orderdate as date), date '2002-01-01') as int) as age, cast(date_trunc('month', o_orderdate) as date) as month_start
from orders""")

same("r12_json", """
select event_type, cast(sum(cast(get_json_object(props, '$.k') as bigint)) as bigint) as k_sum,
  cast(max(variant_get(parse_json(props), '$.k', 'int')) as int) as k_max from events group by event_type""", "events", oracle="""
select event_type, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k_sum,
  cast(max(cast(props->>'$.k' as int)) as int) as k_max from events group by event_type""")


@query("r13_user_functions", """
select c_custkey, c_acctbal > 5000 as keep, lower(c_mktsegment[1:4]) || '-' || cast(c_nationkey % 5 as varchar) as cluster
from customer where c_acctbal > 5000""")
def _(t):
    """User functions inside SQL: Arrow-batched, registered by name."""
    import pandas as pd

    @F.pandas_udf(T.BooleanType())
    def filter_by(row_id: pd.Series, balance: pd.Series) -> pd.Series:
        return balance > 5000

    @F.pandas_udf(T.StringType())
    def cluster_on(row_id: pd.Series, text: pd.Series) -> pd.Series:
        return text.str[:4].str.lower() + "-" + (row_id % 5).astype(str)

    t.spark.udf.register("filter_by", filter_by)
    t.spark.udf.register("cluster_on", cluster_on)
    return sql(
        t.spark,
        """select c_custkey, filter_by(c_custkey, c_acctbal) as keep, cluster_on(cast(c_nationkey as bigint), c_mktsegment) as cluster
           from customer where filter_by(c_custkey, c_acctbal)""",
        customer=t.customer,
    )
