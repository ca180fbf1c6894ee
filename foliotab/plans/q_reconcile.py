"""E: reconciliation."""

from pyspark.sql import functions as F

from ..operators import reconcile as R
from .registry import query

CENTS = "decimal(18,2)"


def orders(t):
    return t.orders.select(
        F.col("o_orderkey").alias("row_id"), "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_totalprice").cast(CENTS).alias("price"), (F.col("o_orderpriority") != "5-LOW").alias("explicit"),
    )


ORDERS = """
with o as (select o_orderkey as row_id, o_custkey, o_orderstatus, o_orderpriority, cast(o_totalprice as decimal(18,2)) as price,
  o_orderpriority <> '5-LOW' as explicit from orders)
"""
DIGITS = "length(ltrim(regexp_replace(cast({} as varchar), '[^0-9]', '', 'g'), '0'))"


@query("e02_clear_nan", """
select c_custkey, case when o_custkey is null then null else c_mktsegment end as segment, n from customer
left join (select o_custkey, cast(count(*) as bigint) as n from orders group by o_custkey) on o_custkey = c_custkey
where n is not null""")
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    j = j.select("c_custkey", F.when(F.col("n").isNotNull(), F.col("c_mktsegment")).otherwise("").alias("segment"), "n")
    return R.clear_nan(j, ["c_custkey"])


@query("e03_dedupe_best", ORDERS + f"""
select row_id, o_custkey, o_orderstatus, o_orderpriority, cast(price as double) as price, explicit from (
  select *, row_number() over (partition by o_custkey order by {DIGITS.format('price')} desc, explicit desc, row_id) as k from o) where k = 1""")
def _(t):
    return R.dedupe_best(orders(t), ["o_custkey"], "price", "explicit").withColumn("price", F.col("price").cast("double"))


@query("e04_dedupe_numeric", f"""
with l as (select l_suppkey, l_orderkey * 1000000000 + l_partkey * 100 + l_linenumber as row_id, cast(l_extendedprice as decimal(18,2)) as price, l_returnflag <> 'N' as quoted from lineitem),
g as (select *, case when price - lag(price) over w <= 20 then 0 else 1 end as jump from l window w as (partition by l_suppkey order by price, row_id)),
r as (select *, sum(jump) over (partition by l_suppkey order by price, row_id rows unbounded preceding) as run from g),
k as (select *, row_number() over (partition by l_suppkey, run order by {DIGITS.format('price')} desc, quoted desc, row_id) as k, count(*) over (partition by l_suppkey, run) as variants from r)
select l_suppkey, row_id, cast(price as double) as price, quoted, cast(variants as bigint) as variants from k where k = 1""")
def _(t):
    rid = F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 100 + F.col("l_linenumber")
    d = t.lineitem.select("l_suppkey", rid.alias("row_id"), F.col("l_extendedprice").cast(CENTS).alias("price"), (F.col("l_returnflag") != "N").alias("quoted"))
    out = R.dedupe_numeric(d, ["l_suppkey"], "price", 20, quoted=F.col("quoted"))
    return out.withColumn("price", F.col("price").cast("double"))


@query("e05_dedupe_text", """
with x as (select p_type, case when p_size > 25 then upper(p_name) || '!' when p_size > 10 then replace(p_name, ' ', '-') else p_name end as name from part),
k as (select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as canonical_key from x)
select p_type, canonical_key, arg_max(name, (length(name), name)) as name, cast(count(*) as bigint) as variants from k group by p_type, canonical_key""")
def _(t):
    name = F.when(F.col("p_size") > 25, F.concat(F.upper("p_name"), F.lit("!"))).when(F.col("p_size") > 10, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name"))
    return R.dedupe_text(t.part.select("p_type", name.alias("name")), ["p_type"], "name")


@query("e06_find_conflicts", """
select o_custkey, 'o_orderstatus' as "column", cast(count(distinct o_orderstatus) as bigint) as "values" from orders group by o_custkey having count(distinct o_orderstatus) > 1
union all select o_custkey, 'o_orderpriority', cast(count(distinct o_orderpriority) as bigint) from orders group by o_custkey having count(distinct o_orderpriority) > 1""")
def _(t):
    return R.find_conflicts(t.orders, ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


def ladder_cells(t):
    o = orders(t)
    pairs = F.array(
        F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("price").alias("field"), F.col("price").cast("string").alias("value")),
    )
    return o.select("o_custkey", "row_id", "explicit", "o_orderpriority", F.inline(pairs))


LADDER = ORDERS + """, c as (select o_custkey, row_id, explicit, o_orderpriority, field, case field when 'status' then o_orderstatus else cast(price as varchar) end as value
  from o, (values ('status'), ('price')) f(field))
"""


@query("e07_resolve_ladder", LADDER + f"""
select o_custkey, field, value, cast(n as bigint) as candidates from (select *, count(*) over (partition by o_custkey, field) as n,
  row_number() over (partition by o_custkey, field order by (o_orderpriority like '1%') desc, explicit desc, {DIGITS.format('value')} desc, length(value) desc, value desc) as k from c) where k = 1""")
def _(t):
    rungs = [F.col("o_orderpriority").startswith("1"), F.col("explicit"), F.length(F.regexp_replace(F.regexp_replace("value", "[^0-9]", ""), "^0+", "")), F.length("value")]
    return R.resolve_ladder(ladder_cells(t), ["o_custkey", "field"], rungs)


@query("e07_resolve_ladder_ties", LADDER + """
, r as (select distinct o_custkey, field, value, rank() over (partition by o_custkey, field order by (o_orderpriority like '1%') desc, explicit desc, length(value) desc) as k from c)
select o_custkey, field, string_agg(value, ' | ' order by value) as value, cast(count(*) as bigint) as tied from r where k = 1 group by o_custkey, field""")
def _(t):
    rungs = [F.col("o_orderpriority").startswith("1"), F.col("explicit"), F.length("value")]
    return R.resolve_ladder(ladder_cells(t), ["o_custkey", "field"], rungs, keep_ties=True)


@query("e08_coalesce_rows", """
with x as (select c_nationkey as k, c_custkey as row_id, c_name as name, cast(null as decimal(18,2)) as balance, c_mktsegment as segment from customer
  union all select s_nationkey, 1000000000 + s_suppkey, s_name || '.', cast(s_acctbal as decimal(18,2)), null from supplier)
select k, arg_max(name, (length(name), -row_id)) as name, cast(arg_max(balance, (length(ltrim(regexp_replace(cast(balance as varchar), '[^0-9]', '', 'g'), '0')), -row_id)) filter (balance is not null) as double) as balance,
  arg_max(segment, (length(segment), -row_id)) filter (segment is not null) as segment from x group by k""")
def _(t):
    c = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("row_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") + 1_000_000_000).alias("row_id"), F.concat("s_name", F.lit(".")).alias("name"), F.col("s_acctbal").cast(CENTS).alias("balance"))
    return R.coalesce_rows(c.unionByName(s, allowMissingColumns=True), ["k"]).withColumn("balance", F.col("balance").cast("double"))


@query("e09_aggregate_across", """
select l_suppkey, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity, string_agg(distinct l_returnflag, '; ' order by l_returnflag) as l_returnflag,
  string_agg(distinct l_linestatus, '; ' order by l_linestatus) as l_linestatus from lineitem group by l_suppkey""")
def _(t):
    d = t.lineitem.select("l_suppkey", F.col("l_quantity").cast("bigint").alias("quantity"), "l_returnflag", "l_linestatus")
    return R.aggregate_across(d, ["l_suppkey"], ["quantity"], ["l_returnflag", "l_linestatus"])


@query("e10_dedupe_subset", """
select min(o_orderkey) as row_id, o_custkey, o_orderstatus from orders where o_orderpriority <> '5-LOW' group by o_custkey, o_orderstatus
union all select o_orderkey, o_custkey, o_orderstatus from orders where o_orderpriority = '5-LOW'""")
def _(t):
    o = t.orders.withColumn("tag", F.array((F.col("o_orderpriority") == "5-LOW").cast("string")))
    d = o.select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_orderstatus", "tag")
    return R.dedupe_subset(d, F.col("tag")[0] == "false").drop("tag")


@query("e11_canonicalize", "select p_partkey, case when p_brand in ('Brand#1', 'Brand#2') then 'Brand#1/2' else p_brand end as p_brand from part")
def _(t):
    return R.canonicalize(t.part.select("p_partkey", "p_brand"), F.col("p_brand").isin("Brand#1", "Brand#2"), "p_brand", "Brand#1/2")


@query("e12_resolve_rows", """
select o_orderkey as row_id, o_custkey, o_orderstatus, null as note from orders where o_orderstatus <> 'P'
union all select min(o_orderkey), o_custkey, 'P', cast(count(*) as varchar) || ' pending' from orders where o_orderstatus = 'P' group by o_custkey""")
def _(t):
    d = t.orders.select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_orderstatus")
    p = F.col("o_orderstatus") == "P"
    note = F.concat(F.count("*").cast("string"), F.lit(" pending")).alias("note")
    fixed = d.filter(p).groupBy("o_custkey").agg(F.min("row_id").alias("row_id"), note).withColumn("o_orderstatus", F.lit("P"))
    return R.resolve_rows(d, p, fixed)


@query("e13_aggregate_subset", """
with l as (select l_orderkey * 1000000000 + l_partkey * 100 + l_linenumber as row_id, l_suppkey, l_returnflag, cast(l_quantity as bigint) as quantity from lineitem)
select row_id, l_suppkey, l_returnflag, quantity, null as quantity_quote, null as quantity_rationale from l where l_returnflag <> 'R'
union all select min(row_id), l_suppkey, 'R', cast(sum(quantity) as bigint), cast(max(quantity) as varchar), 'sum of ' || cast(count(*) as varchar) || ' rows' from l where l_returnflag = 'R' group by l_suppkey""")
def _(t):
    rid = F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 100 + F.col("l_linenumber")
    d = t.lineitem.select(rid.alias("row_id"), "l_suppkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("quantity"))
    return R.aggregate_subset(d, F.col("l_returnflag") == "R", ["l_suppkey", "l_returnflag"], ["quantity"])


@query("e14_resolve_entities", """
select c_custkey as row_id, case when c_nationkey = 3 then 'Entity of 3' else c_name end as name,
  case when c_nationkey in (3, 4) then 'SHARED' else c_mktsegment end as segment from customer""")
def _(t):
    d = t.customer.select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    ids = d.select(F.col("c_nationkey").alias("k"), F.array("row_id").alias("row_ids"))
    three = ids.filter("k = 3").select(F.lit(1).alias("seq"), "row_ids", F.lit("name").alias("column"), F.lit("Entity of 3").alias("value"))
    first = ids.filter("k in (3, 4)").select(F.lit(0).alias("seq"), "row_ids", F.lit("segment").alias("column"), F.lit("OLD").alias("value"))
    second = first.withColumns({"seq": F.lit(2), "value": F.lit("SHARED")})
    return R.resolve_entities(d.drop("c_nationkey"), three.union(first).union(second), ["name", "segment"]).frame


MERGE_SQL = """
with d as (select o_orderkey as row_id, o_custkey, o_orderstatus as status, o_orderpriority as status_quote, case when o_orderstatus = 'F' then null else 'why ' || o_orderstatus end as status_rationale from orders),
g as (select *, count(*) over (partition by o_custkey) as n from d)
select min(row_id) as row_id, o_custkey, {status} as status, string_agg(status_quote, ' | ' order by row_id) as status_quote,
  string_agg(status_rationale, ' | ' order by row_id) as status_rationale from g group by o_custkey"""


def merge_input(t):
    why = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("why "), "o_orderstatus"))
    d = t.orders.select(
        F.col("o_orderkey").alias("row_id"), "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("status_quote"), why.alias("status_rationale")
    )
    return d, d.select(F.col("o_custkey").alias("group"), "row_id")


@query("e15_merge_rows", MERGE_SQL.format(status="arg_min(status, row_id)"))
def _(t):
    return R.merge_rows(*merge_input(t))


@query("e16_resolve_with", MERGE_SQL.format(status="case when count(*) > 1 and o_custkey in (select c_custkey from customer where c_acctbal > 0) then 'fixed' else arg_min(status, row_id) end"))
def _(t):
    d, g = merge_input(t)
    fix = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("group"), F.lit("fixed").alias("status"))
    return R.merge_rows(d, g, fix)


@query("e17_attach_provenance", """
select o_orderkey as row_id, o_orderstatus as status, coalesce(q, o_orderpriority) as status_quote, cast(n as varchar) || ' lines' as status_rationale
from orders left join (select l_orderkey, min(l_returnflag) filter (l_linestatus = 'O') as q, count(*) as n from lineitem group by l_orderkey) on l_orderkey = o_orderkey""")
def _(t):
    d = t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("status_quote"))
    p = t.lineitem.groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.min(F.when(F.col("l_linestatus") == "O", F.col("l_returnflag"))).alias("status_quote"),
        F.concat(F.count("*").cast("string"), F.lit(" lines")).alias("status_rationale"),
    )
    return R.attach_provenance(d, p)


@query("e19_accept_if_reduced", """
select b > 0 and b < a as accepted, a as rows_in, b as rows_out, round((a - b) / a, 6) as reduction_ratio
from (select cast((select count(*) from orders) as bigint) as a, cast((select count(*) from (select distinct o_custkey, o_orderstatus from orders)) as bigint) as b)""")
def _(t):
    d = t.orders.select("o_custkey", "o_orderstatus")
    return R.accept_if_reduced(d, d.distinct())


@query("e20_quality_compare", """
with b as (select case when c_acctbal < 0 then null else c_name end as name, case when c_acctbal > 9000 then '' else c_mktsegment end as segment from customer),
a as (select * from b where name is not null),
qb as (select count(*) as n, count(name) as k1, count(nullif(segment, '')) as k2, count(distinct name) as d1, count(distinct nullif(segment, '')) as d2 from b),
qa as (select count(*) as n, count(name) as k1, count(nullif(segment, '')) as k2, count(distinct name) as d1, count(distinct nullif(segment, '')) as d2 from a)
select cast(qb.n as bigint) as rows_before, cast(2 * qb.n - qb.k1 - qb.k2 as bigint) as nulls_before, round((qb.d1 + qb.d2) / 2, 6) as mean_distinct_before, round((qb.k1 + qb.k2) / (2 * qb.n), 6) as completeness_before,
  cast(qa.n as bigint) as rows_after, cast(2 * qa.n - qa.k1 - qa.k2 as bigint) as nulls_after, round((qa.d1 + qa.d2) / 2, 6) as mean_distinct_after, round((qa.k1 + qa.k2) / (2 * qa.n), 6) as completeness_after,
  qa.n < qb.n as improved from qb, qa""")
def _(t):
    b = t.customer.select(
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"), F.when(F.col("c_acctbal") > 9000, "").otherwise(F.col("c_mktsegment")).alias("segment")
    )
    return R.quality_compare(b, b.filter("name is not null"), ["name", "segment"])


@query("e21_table_health", """
with e as (select distinct c_custkey from customer), r as (select distinct o_custkey from orders where o_orderstatus = 'P')
select cast(count(o_custkey) as bigint) as non_empty, cast(count(*) - count(o_custkey) as bigint) as empty, round(count(o_custkey) / count(*), 6) as completeness
from e left join r on o_custkey = c_custkey""")
def _(t):
    rows = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("table_name"))
    return R.table_health(rows, t.customer.select(F.col("c_custkey").alias("table_name")))


@query("e22_merge_report", """
with s as (select event_type, user_id + 10 as rows_in, user_id as rows_out, 1 + event_id % 3 as attempts, value > 5 as success from events)
select event_type, cast(sum(rows_in) as bigint) as rows_in, cast(sum(rows_out) as bigint) as rows_out, round((sum(rows_in) - sum(rows_out)) / sum(rows_in), 6) as reduction_ratio,
  cast(sum(attempts) as bigint) as attempts, cast(count(*) filter (success) as bigint) as succeeded, cast(count(*) filter (not coalesce(success, false)) as bigint) as failed,
  round(count(*) filter (success) / count(*), 6) as success_rate from s group by event_type""")
def _(t):
    s = t.events.select(
        "event_type", (F.col("user_id") + 10).alias("rows_in"), F.col("user_id").alias("rows_out"), (1 + F.col("event_id") % 3).alias("attempts"), (F.col("value") > 5).alias("success")
    )
    return R.merge_report(s, ["event_type"])


@query("e23_field_lineage", """
with c as (select distinct lower(p_type) || '_of_' || replace(p_name, ' ', '_') as "column" from part), f as (select distinct replace(p_name, ' ', '_') as field from part union select distinct lower(p_type) from part)
select "column", arg_max(field, (field = "column", length(field), field)) filter (contains("column", field)) as field from c, f group by "column" """)
def _(t):
    slug = F.replace("p_name", F.lit(" "), F.lit("_"))
    cols = t.part.select(F.concat(F.lower("p_type"), F.lit("_of_"), slug).alias("column"))
    fields = t.part.select(slug.alias("field")).union(t.part.select(F.lower("p_type")))
    return R.field_lineage(cols, fields)


@query("e24_run_plan", """
with d as (select distinct o_custkey, o_orderstatus, cast(o_totalprice as decimal(18,2)) as price from orders where o_custkey is not null or o_orderstatus <> '' or o_totalprice is not null),
x as (select o_custkey, o_orderstatus, cast(sum(price) as double) as price from d group by o_custkey, o_orderstatus)
select o_custkey, arg_max(o_orderstatus, (price, o_orderstatus)) as o_orderstatus, max(price) as price from x group by o_custkey""")
def _(t):
    d = t.orders.select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_orderstatus", F.col("o_totalprice").cast(CENTS).alias("price"))
    steps = {
        "clear_nan": R.clear_nan,
        "deduplication": lambda x: R.drop_full_duplicates(x),
        "aggregation": lambda x: x.groupBy("o_custkey", "o_orderstatus").agg(F.min("row_id").alias("row_id"), F.sum("price").alias("price")),
        "conflict_resolution": lambda x: x.groupBy("o_custkey").agg(
            F.max_by("o_orderstatus", F.struct("price", "o_orderstatus")).alias("o_orderstatus"), F.min("row_id").alias("row_id"), F.max("price").alias("price")
        ),
    }
    return R.run_plan(d, steps).frame.select("o_custkey", "o_orderstatus", F.col("price").cast("double").alias("price"))
