"""F25-F38: outputs, file finding and topology."""

from pyspark.sql import functions as F

from ..operators import model_objects as M
from ..operators import outputs as O
from ..operators import topology as T
from .registry import query


def case(rules, default="null"):
    text = "case " + " ".join(f"when {' or '.join(f'contains(n, {w!r})' for w in words)} then '{label}'" for label, words in rules)
    return f"{text} else {default} end"


NAMES = """with x as (select p_partkey, lower(p_type || ' ' || case p_size % 9 when 0 then 'Zone Temperature' when 1 then 'Electricity:Facility' when 2 then 'Water:Mains' when 3 then 'Fans:Flow'
  when 4 then 'HVAC Cooling' when 5 then 'Site CO2' when 6 then 'Surface Net' when 7 then 'InteriorLights:Building' else p_name end) as n from part)"""


def names(t):
    words = ["Zone Temperature", "Electricity:Facility", "Water:Mains", "Fans:Flow", "HVAC Cooling", "Site CO2", "Surface Net", "InteriorLights:Building"]
    w = F.coalesce(F.get(F.array(*[F.lit(x) for x in words]), (F.col("p_size") % 9).cast("int")), F.col("p_name"))
    return t.part.select("p_partkey", F.concat_ws(" ", "p_type", w).alias("name"))


@query("f25_categorize", NAMES + f"""
, r as (select case when contains(n, 'electricity') then 'Electricity' when contains(n, 'naturalgas') or contains(n, ':gas') then 'NaturalGas' when contains(n, 'water') then case when contains(n, 'mains') then 'MainsWater' else 'Water' end
    else {case(O.RESOURCE_RULES[2:], "'Other'")} end as category from x)
select 'variable' as scheme, {case(O.VARIABLE_RULES, "'Other'")} as category, cast(count(*) as bigint) as n from x group by all
union all select 'resource', category, cast(count(*) as bigint) from r group by all
union all select 'end_use', category, cast(count(*) as bigint) from (select {case(O.END_USE_RULES)} as category from x) where category is not null group by all""")
def _(t):
    n = names(t)
    return O.category_counts(n, "name", False).unionByName(O.category_counts(n, "name", True))


def requests(t):
    """Every part asks for a name of its type and brand; some are misspelt, some frequencies wrong."""
    k = F.col("p_partkey")
    name = F.concat_ws(" ", "p_name", F.when(k % 4 == 0, F.replace("p_brand", F.lit("Brand"), F.lit("Bramd"))).otherwise(F.col("p_brand")))
    freq = F.when(k % 6 == 0, "hurly").when(k % 6 == 1, "Daily").otherwise("hourly")
    listed = F.to_json(F.array(name, freq))
    keyed = F.to_json(F.struct(name.alias("name"), freq.alias("frequency"), F.when(k % 10 == 3, "Output:Thing").alias("meter_type")))
    spec = F.when(k % 3 == 0, listed).when(k % 3 == 1, keyed).otherwise(name)
    return O.normalize_requests(t.part.select("p_partkey", spec.alias("spec"))).drop("spec")


def catalog(t):
    return t.part.filter("p_size > 20").select(F.concat_ws(" ", "p_name", "p_brand").alias("name")).distinct()


REQ = """
with r as (select p_partkey, p_name || ' ' || case when p_partkey % 4 = 0 then replace(p_brand, 'Brand', 'Bramd') else p_brand end as name,
    case when p_partkey % 3 = 2 then 'hourly' when p_partkey % 6 = 0 then 'hurly' when p_partkey % 6 = 1 then 'Daily' else 'hourly' end as frequency,
    case when p_partkey % 3 = 1 and p_partkey % 10 = 3 then 'Output:Thing' else 'Output:Meter' end as kind from part),
cat as (select distinct p_name || ' ' || p_brand as name from part where p_size > 20),
v as (select r.*, lower(name) not in (select lower(name) from cat) as unknown,
    case when frequency = 'hurly' then 'invalid frequency' {kind} end as form from r),
w as (select p_partkey, name, frequency, kind, unknown, {error} as error, {warning} as warning from v),
o as (select *, case when error is null then 'valid' else 'invalid' end as verdict from w)
"""
VARS = REQ.format(kind="", error="coalesce(form, case when unknown then 'unknown name' end)", warning="cast(null as varchar)")
METERS = REQ.format(kind="when kind = 'Output:Thing' then 'invalid meter type'", error="form", warning="case when form is null and unknown then 'unknown name' end")


@query("f26_validate_variables", VARS + "select * from o")
def _(t):
    return O.validate_requests(requests(t), catalog(t)).withColumn("warning", F.col("warning").cast("string"))


@query("f26_validate_meters", METERS + "select * from o")
def _(t):
    return O.validate_requests(requests(t), catalog(t), meters=True)


@query("f26_suggestions", VARS + """
, u as (select distinct lower(name) as name from o where unknown), c as (select distinct lower(name) as name from cat),
s as (select u.name, c.name as suggestion, 1.0 - cast(levenshtein(u.name, c.name) as double) / greatest(length(u.name), length(c.name)) as sim from u, c),
k as (select *, row_number() over (partition by name order by round(sim, 9) desc, suggestion) as k from s where sim >= 0.6)
select name, suggestion, round(sim, 6) as similarity, cast(k as int) as rank from k where k <= 5""")
def _(t):
    bad = O.validate_requests(requests(t), catalog(t)).filter("unknown")
    return O.suggestions(bad, "name", catalog(t))


DUP = """
with n as (select o_orderkey, cast(o_custkey % 50 as varchar) as key, o_orderpriority as name, o_orderstatus as frequency from orders where year(o_orderdate) >= 1996),
e as (select distinct cast(o_custkey % 50 as varchar) as key, o_orderpriority as name, lower(o_orderstatus) as frequency from orders where year(o_orderdate) < 1996)
"""


def dup(t):
    key = (F.col("o_custkey") % 50).cast("string").alias("key")
    new = t.orders.filter(F.year("o_orderdate") >= 1996).select("o_orderkey", key, F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("frequency"))
    old = t.orders.filter(F.year("o_orderdate") < 1996).select(key, F.col("o_orderpriority").alias("name"), F.lower("o_orderstatus").alias("frequency"))
    return new, old


@query("f27_split_duplicates", DUP + """
select n.*, exists (select 1 from e where e.key = n.key and e.name = n.name and lower(e.frequency) = lower(n.frequency)) as duplicate from n""")
def _(t):
    s = O.split_duplicates(*dup(t), ["key", "name", "frequency"])
    return s.added.withColumn("duplicate", F.lit(False)).unionByName(s.duplicates.withColumn("duplicate", F.lit(True)))


def output_objects(t):
    k = F.when(F.col("event_type") == "view", "Output:Variable").when(F.col("event_type") == "click", "Output:Meter").when(F.col("event_type") == "purchase", "Output:Meter:Cumulative").otherwise("Other")
    e = t.events.withColumn("k", k)
    out = None
    for kind in ("Output:Variable", "Output:Meter", "Output:Meter:Cumulative"):
        f = {"Variable_Name" if kind == "Output:Variable" else "Key_Name": F.concat(F.lit("n"), (F.col("event_id") % 13).cast("string")), "Reporting_Frequency": F.when(F.col("value") > 5, "hourly")}
        o = M.objects_from(e.filter(F.col("k") == kind), F.col("user_id") % 20, kind, F.col("event_id"), f)
        out = o if out is None else out.union(o)
    return out


CONFIGURED = """
with c as (select cast(user_id % 20 as varchar) as model, case event_type when 'view' then 'Output:Variable' when 'click' then 'Output:Meter' when 'purchase' then 'Output:Meter:Cumulative' end as obj_type,
  event_id as obj_idx, '*' as key, 'n' || event_id % 13 as name, case when value > 5 then 'hourly' else 'Unknown' end as frequency from events where event_type in ('view', 'click', 'purchase'))
"""


@query("f28_configured_outputs", CONFIGURED + "select model, obj_type, cast(count(*) as bigint) as n, cast(count(distinct name) as bigint) as names, cast(count(*) filter (frequency = 'hourly') as bigint) as hourly from c group by model, obj_type")
def _(t):
    c = O.configured_outputs(output_objects(t))
    return c.groupBy("model", "obj_type").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.count_if(F.col("frequency") == "hourly").alias("hourly"))


@query("f28_append_outputs", CONFIGURED + """
, top as (select model, max(obj_idx) as top from c group by model), a as (select cast(p_size % 20 as varchar) as model, p_name as name, count(*) as n from part group by all)
select model, cast(count(*) as bigint) as added, cast(min(i) as bigint) as lowest, cast(max(i) as bigint) as highest from (
  select a.model, top + row_number() over (partition by a.model order by name) as i from a join top using (model)) group by model""")
def _(t):
    c = O.configured_outputs(output_objects(t))
    new = t.part.select((F.col("p_size") % 20).cast("string").alias("model"), F.col("p_name").alias("name")).distinct()
    new = new.withColumns({"obj_type": F.lit("Output:Variable"), "key": F.lit("*"), "frequency": F.lit("hourly")})
    out = O.append_outputs(c, new)
    top = c.groupBy("model").agg(F.max("obj_idx").alias("top"))
    added = out.join(top, "model").filter(F.col("obj_idx") > F.col("top"))
    return added.groupBy("model").agg(F.count("*").alias("added"), F.min("obj_idx").alias("lowest"), F.max("obj_idx").alias("highest"))


@query("f29_series_long", """
select l_orderkey, l_linenumber, l_partkey, s as series, case s when 'quantity' then l_quantity when 'price' then l_extendedprice else l_discount end as value
from lineitem, (values ('quantity'), ('price'), ('discount')) x(s)""")
def _(t):
    from ..sources.series import series_long

    wide = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), "l_returnflag")
    return series_long(wide, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("f35_fuzzy_files", """
with f as (select distinct regexp_extract(lower(url), '/([^/?#]*)[?#]?[^/]*$', 1) || '_' || page_id || '.html' as name from pages)
select name, round(1.0 - cast(levenshtein(name, '825_10.html') as double) / greatest(length(name), 11), 6) as similarity from f where 1.0 - cast(levenshtein(name, '825_10.html') as double) / greatest(length(name), 11) > 0.3
order by similarity desc, name limit 10""")
def _(t):
    f = t.pages.select(F.concat(F.regexp_extract(F.lower("url"), "/([^/?#]*)[?#]?[^/]*$", 1), F.lit("_"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"))
    return O.fuzzy_files(f, "name", "825_10.HTML")


@query("f36_find_by_words", """
select p_partkey, p_name, cast(length(p_name) as int) as rank_length from part where contains(lower(p_name), 'ring red') or (contains(lower(p_name), 'ring') and contains(lower(p_name), 'red'))""")
def _(t):
    return O.find_by_words(t.part.select("p_partkey", "p_name"), "p_name", "Ring red")


@query("f37_add_outputs", METERS + """
, e as (select distinct p_name || ' ' || p_brand as name from part where p_size > 40),
d as (select *, case when verdict = 'invalid' then 'invalid' when lower(name) in (select lower(name) from e) and lower(frequency) = 'hourly' then 'duplicate' else 'added' end as outcome from o)
select kind, cast(count(*) as bigint) as requested, cast(count(*) filter (verdict = 'valid') as bigint) as valid, cast(count(*) filter (outcome = 'invalid') as bigint) as invalid,
  cast(count(warning) as bigint) as warnings, cast(count(*) filter (outcome = 'duplicate') as bigint) as duplicates, cast(count(*) filter (outcome = 'added') as bigint) as added from d group by kind""")
def _(t):
    existing = t.part.filter("p_size > 40").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.lit("Hourly").alias("frequency"))
    out = O.add_outputs(requests(t), catalog(t), existing, ["name", "frequency"], meters=True)
    return O.add_report(out, ["kind"])


def plant(t):
    """Customers are branches, orders their components, nations loops, regions models."""
    z = t.nation.select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").cast("string").alias("model"), "n_name")
    side = lambda p: {f"{p}_Side_Branch_List_Name": F.concat(F.lit(p + " "), "n_name"), f"{p}_Side_Connector_List_Name": F.concat(F.lit(p + " c "), "n_name")}
    o = M.objects_from(z, F.col("model"), "PlantLoop", F.col("nk"), {"Name": F.col("n_name"), "Plant_Side_Inlet_Node_Name": F.concat("n_name", F.lit(" in")), **side("Plant"), **side("Demand")})
    c = t.customer.join(z, F.col("c_nationkey") == F.col("nk")).withColumn("p", F.when(F.col("c_acctbal") > 0, "Plant").otherwise("Demand"))
    field = lambda df, typ, idx, name, value: df.select("model", F.lit(typ).alias("obj_type"), idx.cast("bigint").alias("obj_idx"), F.lit(1).alias("field_idx"), name.alias("field_name"), value.cast("string").alias("value"))
    lists = c.select("model", "nk", "n_name", "p").distinct().withColumn("i", F.col("nk") * 2 + F.when(F.col("p") == "Plant", 0).otherwise(1))
    o = o.union(field(lists, "BranchList", F.col("i"), F.lit("Name"), F.concat_ws(" ", "p", "n_name")))
    c = c.withColumn("i", F.col("nk") * 2 + F.when(F.col("p") == "Plant", 0).otherwise(1))
    o = o.union(field(c, "BranchList", F.col("i"), F.concat(F.lit("Branch_"), (F.col("c_custkey") + 1).cast("string"), F.lit("_Name")), F.col("c_name")))
    o = o.union(field(c, "Branch", F.col("c_custkey"), F.lit("Name"), F.col("c_name")))
    # an order above 495000 has no name, which ends its branch there
    d = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"))
    comp = lambda part: F.concat(F.lit("Component_"), (F.col("o_orderkey") + 1).cast("string"), F.lit("_" + part))
    k = F.col("o_orderkey").cast("string")
    values = {"Object_Type": F.col("o_orderpriority"), "Name": F.when(F.col("o_totalprice") > 495000, "").otherwise(F.concat(F.lit("O"), k)), "Inlet_Node_Name": F.concat(F.lit("in"), k), "Outlet_Node_Name": F.concat(F.lit("out"), k)}
    fields = F.array(*[F.struct(comp(part).alias("field_name"), v.alias("value")) for part, v in values.items()])
    d = d.select("model", F.lit("Branch").alias("obj_type"), F.col("c_custkey").cast("bigint").alias("obj_idx"), F.lit(1).alias("field_idx"), F.inline(fields))
    return o.union(d)


PLANT = """
with z as (select n_nationkey as nk, cast(n_regionkey as varchar) as model, n_name from nation),
c as (select model, n_name, c_custkey, c_name as branch, case when c_acctbal > 0 then 'Plant' else 'Demand' end as p from customer join z on c_nationkey = nk),
cut as (select o_custkey, min(o_orderkey) as gap from orders where o_totalprice > 495000 group by o_custkey),
b as (select model, n_name, p || ' ' || n_name as list_name, case p when 'Plant' then 'supply' else 'demand' end as side, cast(c_custkey + 1 as int) as branch_seq, branch, cast(o.o_orderkey + 1 as int) as seq, o_orderpriority as type, 'O' || o_orderkey as name,
    'in' || o_orderkey as inlet, 'out' || o_orderkey as outlet
  from c left join (select orders.* from orders left join cut using (o_custkey) where gap is null or o_orderkey < gap) o on o.o_custkey = c_custkey)
"""


@query("f30_loops", """
select cast(n_regionkey as varchar) as model, 'PlantLoop' as loop_type, n_name as loop, n_name || ' in' as supply_inlet, 'Unknown' as supply_outlet, 'Unknown' as demand_inlet, 'Unknown' as demand_outlet from nation
union all select '0', 'AirLoopHVAC', s_name, 'Unknown', 'Unknown', 'd' || s_suppkey, 'Unknown' from supplier""")
def _(t):
    air = M.objects_from(t.supplier, F.lit("0"), "AirLoopHVAC", F.col("s_suppkey"), {"Name": F.col("s_name"), "Demand_Side_Inlet_Node_Names": F.concat(F.lit("d"), F.col("s_suppkey").cast("string"))})
    return T.loops(plant(t).union(air))


@query("f31_branches", PLANT + "select model, list_name, branch_seq, branch, seq, type, case when seq is not null then name end as name, case when seq is not null then inlet end as inlet, case when seq is not null then outlet end as outlet from b")
def _(t):
    return T.branches(plant(t))


def connector_objects(t):
    """Regions hold connector lists; each has a splitter to and a mixer from its nations."""
    r = t.region.select(F.col("r_regionkey").alias("rk"), F.col("r_regionkey").cast("string").alias("model"), "r_name")
    s, m = F.concat(F.lit("S "), "r_name"), F.concat(F.lit("M "), "r_name")
    o = M.objects_from(r, F.col("model"), "ConnectorList", F.col("rk"), {"Name": F.col("r_name"), "Connector_1_Object_Type": F.lit("Connector:Splitter"), "Connector_1_Name": s, "Connector_2_Object_Type": F.lit("Connector:Mixer"), "Connector_2_Name": m})
    o = o.union(M.objects_from(r, F.col("model"), "Connector:Splitter", F.col("rk"), {"Name": s, "Inlet_Branch_Name": F.lit("inlet")}))
    o = o.union(M.objects_from(r, F.col("model"), "Connector:Mixer", F.col("rk"), {"Name": m, "Outlet_Branch_Name": F.lit("outlet")}))
    n = t.nation.join(r, F.col("n_regionkey") == F.col("rk"))
    one = lambda typ, w: n.select("model", F.lit(typ).alias("obj_type"), F.col("rk").cast("bigint").alias("obj_idx"), F.lit(5).alias("field_idx"), F.concat(F.lit(w + "_Branch_"), (F.col("n_nationkey") + 1).cast("string"), F.lit("_Name")).alias("field_name"), F.col("n_name").alias("value"))
    return o.union(one("Connector:Splitter", "Outlet")).union(one("Connector:Mixer", "Inlet"))


@query("f32_connectors", """
select cast(r_regionkey as varchar) as model, r_name as list_name, 'Connector:Splitter' as type, 'S ' || r_name as name, 'inlet' as source, n_name as target from region join nation on n_regionkey = r_regionkey
union all select cast(r_regionkey as varchar), r_name, 'Connector:Mixer', 'M ' || r_name, n_name, 'outlet' from region join nation on n_regionkey = r_regionkey""")
def _(t):
    return T.connectors(connector_objects(t))


@query("f33_plant_topology", PLANT + """
select model, n_name as loop, side, cast(count(*) as bigint) as rows, cast(count(distinct branch) as bigint) as branches, cast(count(seq) as bigint) as components, min(seq) as first_seq, max(case when seq is not null then inlet end) as last_inlet from b group by model, n_name, side""")
def _(t):
    comp, _ = T.plant_topology(plant(t))
    return comp.groupBy("model", "loop", "side").agg(
        F.count("*").alias("rows"), F.count_distinct("branch").alias("branches"), F.count("seq").alias("components"), F.min("seq").alias("first_seq"), F.max("inlet").alias("last_inlet")
    )


def plant_connectors(t):
    """Each side of a plant loop has a connector list with a splitter to its branches and a mixer from them."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("p", F.when(F.col("c_acctbal") > 0, "Plant").otherwise("Demand"))
    c = c.select(F.col("n_regionkey").cast("string").alias("model"), (F.col("n_nationkey") * 2 + F.when(F.col("p") == "Plant", 0).otherwise(1)).alias("i"), F.concat_ws(" ", "p", "n_name").alias("side"), F.concat_ws(" c ", "p", "n_name").alias("list"), "c_custkey", "c_name")
    s, m = F.concat(F.lit("S "), "side"), F.concat(F.lit("M "), "side")
    one = c.select("model", "i", "side", "list").distinct()
    o = M.objects_from(one, F.col("model"), "ConnectorList", F.col("i"), {"Name": F.col("list"), "Connector_1_Object_Type": F.lit("Connector:Splitter"), "Connector_1_Name": s, "Connector_2_Object_Type": F.lit("Connector:Mixer"), "Connector_2_Name": m})
    o = o.union(M.objects_from(one, F.col("model"), "Connector:Splitter", F.col("i"), {"Name": s, "Inlet_Branch_Name": F.concat(F.lit("from "), "side")}))
    o = o.union(M.objects_from(one, F.col("model"), "Connector:Mixer", F.col("i"), {"Name": m, "Outlet_Branch_Name": F.concat(F.lit("to "), "side")}))
    many = lambda typ, w: c.select("model", F.lit(typ).alias("obj_type"), F.col("i").cast("bigint").alias("obj_idx"), F.lit(5).alias("field_idx"), F.concat(F.lit(w + "_Branch_"), (F.col("c_custkey") + 1).cast("string"), F.lit("_Name")).alias("field_name"), F.col("c_name").alias("value"))
    return o.union(many("Connector:Splitter", "Outlet")).union(many("Connector:Mixer", "Inlet"))


@query("f33_plant_edges", """
with c as (select cast(n_regionkey as varchar) as model, n_name as loop, case when c_acctbal > 0 then 'supply' else 'demand' end as side, case when c_acctbal > 0 then 'Plant' else 'Demand' end as p, n_name, c_name from customer join nation on c_nationkey = n_nationkey)
select model, loop, side, p || ' c ' || n_name as connector_list, 'Connector:Splitter' as type, 'S ' || p || ' ' || n_name as name, 'from ' || p || ' ' || n_name as source, c_name as target from c
union all select model, loop, side, p || ' c ' || n_name, 'Connector:Mixer', 'M ' || p || ' ' || n_name, c_name, 'to ' || p || ' ' || n_name from c""")
def _(t):
    return T.plant_topology(plant(t).union(plant_connectors(t)))[1]


@query("f33_nested_components", PLANT + """
select model, n_name as loop, side, cast(count(seq) as bigint) as components, cast(max(length(name)) filter (seq is not null) as int) as longest_name, min(case when seq is not null then branch || ':' || seq end) as first_item from b group by model, n_name, side having count(seq) > 0""")
def _(t):
    comp, _ = T.plant_topology(plant(t))
    n = T.nested(comp.filter("seq is not null"), ["model", "loop", "side"])
    item = F.transform("components", lambda x: F.concat_ws(":", x["branch"], x["seq"].cast("string")))
    return n.select("model", "loop", "side", F.size("components").cast("bigint").alias("components"), F.array_max(F.transform("components", lambda x: F.length(x["name"]))).alias("longest_name"), F.array_min(item).alias("first_item"))


#: More than there are part keys, so that an object has a number of its own: supplier key * PARTS + part key.
PARTS = 1 << 32


def air(t):
    """Suppliers are air loops, their parts of line items the splitter outlets, orders the terminals."""
    k = F.col("s_suppkey").cast("string")
    c = lambda p: F.concat(F.lit(p), k)
    m = F.lit("m")
    s = t.supplier
    o = M.objects_from(s, m, "AirLoopHVAC", F.col("s_suppkey"), {"Name": F.col("s_name"), "Demand_Side_Inlet_Node_Names": c("di"), "Demand_Side_Outlet_Node_Name": c("do"), "Branch_List_Name": F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(c("bl")), "Supply_Side_Branch_List_Name": c("bl")})
    o = o.union(M.objects_from(s, m, "AirLoopHVAC:SupplyPath", F.col("s_suppkey"), {"Name": c("sp"), "Supply_Air_Path_Inlet_Node_Name": c("di"), "Component_1_Object_Type": F.lit("AirLoopHVAC:ZoneSplitter"), "Component_1_Name": c("zs")}))
    o = o.union(M.objects_from(s, m, "AirLoopHVAC:ReturnPath", F.col("s_suppkey"), {"Name": c("rp"), "Return_Air_Path_Outlet_Node_Name": c("do"), "Component_1_Object_Type": F.lit("AirLoopHVAC:ZoneMixer"), "Component_1_Name": c("zm"), "Component_2_Object_Type": F.lit("AirLoopHVAC:ReturnPlenum"), "Component_2_Name": c("pl")}))
    o = o.union(M.objects_from(s, m, "AirLoopHVAC:ReturnPlenum", F.col("s_suppkey"), {"Zone_Name": c("zn"), "Outlet_Node_Name": c("po"), "Induced_Air_Outlet_Node_or_NodeList_Name": F.lit("")}))
    o = o.union(M.objects_from(s, m, "BranchList", F.col("s_suppkey"), {"Name": c("bl")}))
    for typ, p in (("AirLoopHVAC:ZoneSplitter", "zs"), ("AirLoopHVAC:ZoneMixer", "zm"), ("AirLoopHVAC:ReturnPlenum", "pl")):
        o = o.union(M.objects_from(s, m, typ, F.col("s_suppkey"), {"Name": c(p)}))
    li = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    port = lambda typ, w: li.select(m.alias("model"), F.lit(typ).alias("obj_type"), F.col("l_suppkey").alias("obj_idx"), F.lit(9).alias("field_idx"), F.concat(F.lit(w + "_"), (F.col("l_partkey") + 1).cast("string"), F.lit("_Node_Name")).alias("field_name"), F.concat(F.lit(w), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("value"))
    o = o.union(port("AirLoopHVAC:ZoneSplitter", "Outlet")).union(port("AirLoopHVAC:ZoneMixer", "Inlet"))
    o = o.union(port("AirLoopHVAC:ReturnPlenum", "Inlet").filter("value like '%7'"))
    # every fifth part is a branch of a coil and a fan; the name of the fan is blank in every second one
    br = li.filter("l_partkey % 5 = 0")
    named = lambda w: F.concat(F.lit(w), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"))
    o = o.union(br.select(m.alias("model"), F.lit("BranchList").alias("obj_type"), F.col("l_suppkey").alias("obj_idx"), F.lit(9).alias("field_idx"), F.concat(F.lit("Branch_"), (F.col("l_partkey") + 1).cast("string"), F.lit("_Name")).alias("field_name"), named("br").alias("value")))
    o = o.union(M.objects_from(br, m, "Branch", F.col("l_suppkey") * PARTS + F.col("l_partkey"), {"Name": named("br"), "Component_1_Object_Type": F.lit("Coil"), "Component_1_Name": named("coil"), "Component_2_Object_Type": F.lit("Fan"), "Component_2_Name": F.when(F.col("l_partkey") % 10 == 0, "").otherwise(named("fan"))}))
    term = li.filter("l_partkey % 2 = 0")
    e = M.objects_from(term, m, "AirTerminal:SingleDuct:VAV:Reheat", F.col("l_suppkey") * PARTS + F.col("l_partkey"), {"Name": F.concat(F.lit("vav"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")), "Air_Inlet_Node_Name": F.concat(F.lit("Outlet"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"))})
    return o.union(e)


@query("f34_air_topology", """
with s as (select s_suppkey as k, s_name as loop from supplier), li as (select distinct l_suppkey as k, l_partkey as p from lineitem), j as (select s.k, loop, p from s join li using (k))
select 'm' as model, loop, 'supply_path' as relation, 'di' || k as source, 'sp' || k as target from s
union all select 'm', loop, 'return_path', 'rp' || k, 'do' || k from s
union all select 'm', loop, 'supply_component', 'sp' || k, 'zs' || k from s
union all select 'm', loop, 'return_component', 'zm' || k, 'rp' || k from s
union all select 'm', loop, 'return_component', 'pl' || k, 'rp' || k from s
union all select 'm', loop, 'splitter', 'zs' || k, 'Outlet' || k || '-' || p from j
union all select 'm', loop, 'mixer', 'Inlet' || k || '-' || p, 'zm' || k from j
union all select 'm', loop, 'plenum', 'Inlet' || k || '-' || p, 'pl' || k from j where p % 10 = 7
union all select 'm', loop, 'plenum_zone', 'pl' || k, 'zn' || k from s
union all select 'm', loop, 'plenum_outlet', 'pl' || k, 'po' || k from s
union all select 'm', loop, 'equipment', 'Outlet' || k || '-' || p, 'vav' || k || '-' || p from j where p % 2 = 0
union all select 'm', loop, 'supply_branch', loop, 'br' || k || '-' || p from j where p % 5 = 0
union all select 'm', loop, 'branch_component', 'br' || k || '-' || p, 'coil' || k || '-' || p from j where p % 5 = 0
union all select 'm', loop, 'branch_component', 'br' || k || '-' || p, 'fan' || k || '-' || p from j where p % 10 = 5""")
def _(t):
    return T.air_topology(air(t))


@query("f38_count_components", PLANT + """
select n_name as loop, side, cast(count(distinct (type, name)) filter (seq is not null) as bigint) as components from b group by n_name, side""")
def _(t):
    comp, _ = T.plant_topology(plant(t))
    return T.count_components(comp)
