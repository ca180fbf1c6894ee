"""F1-F14: model objects and schedule inventory. Driver tables play the model:

regions are models, nations zones, customers surfaces, suppliers constructions and materials, line items loads.
"""

from pyspark.sql import functions as F

from ..operators import model_objects as M
from ..operators import schedules as H
from .registry import query


def zones(t):
    return t.nation.select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").cast("string").alias("model"), "n_name")


def model(t):
    z = zones(t)
    area = F.when(F.col("nk") % 5 == 0, "autocalculate").otherwise((F.col("nk") * 10).cast("string"))
    o = M.objects_from(z, F.col("model"), "Zone", F.col("nk"), {"Name": F.col("n_name"), "Floor_Area": area})
    c = t.customer.join(z, F.col("c_nationkey") == F.col("nk"))
    kind = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Wall").otherwise("roof")
    place = F.when(F.col("c_acctbal") > 0, "Outdoors").otherwise("Ground")
    o = o.union(
        M.objects_from(
            c.filter("nk <> 7"), F.col("model"), "BuildingSurface:Detailed", F.col("c_custkey"),
            {"Name": F.col("c_name"), "Surface_Type": kind, "Construction_Name": F.concat(F.lit("C"), (F.col("c_custkey") % 50).cast("string")), "Zone_Name": F.col("n_name"), "Outside_Boundary_Condition": place},
        )
    )
    s = t.supplier.join(z, F.col("s_nationkey") == F.col("nk"))
    k = F.col("s_suppkey")
    layer = lambda m: F.concat(F.lit("M"), (k % m).cast("string"))
    o = o.union(M.objects_from(s, F.col("model"), "Construction", k, {"Name": F.concat(F.lit("C"), (k % 50).cast("string")), "Outside_Layer": layer(17), "Layer_2": F.when(F.col("s_acctbal") > 5000, layer(23))}))
    o = o.union(M.objects_from(s.filter("s_acctbal > 0"), F.col("model"), "Material", k, {"Name": F.concat(F.lit("M"), (k % 40).cast("string")), "Solar_Absorptance": F.lit("0.7")}))
    r = t.region.filter("r_regionkey <> 4")
    o = o.union(M.objects_from(r, F.col("r_regionkey"), "Building", F.col("r_regionkey"), {"Name": F.col("r_name")}))
    return o.union(M.objects_from(r.filter("r_regionkey = 1"), F.col("r_regionkey"), "Building", F.lit(99), {"Name": F.lit("second")}))


MODEL = """
with z as (select n_nationkey as nk, cast(n_regionkey as varchar) as model, n_name from nation),
surf as (select z.model, c_custkey as i, c_name as name, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'Wall' else 'roof' end as kind, 'C' || c_custkey % 50 as cons, n_name as zone, c_acctbal > 0 as outdoors
  from customer join z on c_nationkey = nk where nk <> 7),
cons as (select z.model, s_suppkey as i, 'C' || s_suppkey % 50 as name, 'M' || s_suppkey % 17 as l1, case when s_acctbal > 5000 then 'M' || s_suppkey % 23 end as l2 from supplier join z on s_nationkey = nk),
mat as (select z.model, s_suppkey as i, 'M' || s_suppkey % 40 as name from supplier join z on s_nationkey = nk where s_acctbal > 0),
bld as (select cast(r_regionkey as varchar) as model, r_regionkey as i, r_name as name from region where r_regionkey <> 4 union all select '1', 99, 'second'),
"""
COUNTS = MODEL + """m as (select cast(r_regionkey as varchar) as model from region),
counts as (select model, cast((select count(*) from bld b where b.model = m.model) as bigint) as building_count, cast((select count(*) from z where z.model = m.model) as bigint) as zone_count,
  cast((select count(*) from surf s where s.model = m.model) as bigint) as surface_count, cast((select count(*) from mat s where s.model = m.model) as bigint) as material_count,
  cast((select count(*) from cons s where s.model = m.model) as bigint) as construction_count from m),
issues as (
  select model, 'error' as severity, 'missing_type' as code, 'Building' as subject, null as detail from counts where building_count = 0
  union all select model, 'error', 'missing_type', 'SimulationControl', null from counts
  union all select model, 'warning', 'multiple', 'Building', cast(building_count as varchar) from counts where building_count > 1
  union all select model, 'warning', 'zone_without_surface', n_name, null from z where not exists (select 1 from surf s where s.model = z.model and s.zone = z.n_name)
  union all select model, 'error', 'undefined_material', name, l1 from cons c where not exists (select 1 from mat m where m.model = c.model and m.name = c.l1)
  union all select model, 'error', 'undefined_material', name, l2 from cons c where l2 is not null and not exists (select 1 from mat m where m.model = c.model and m.name = c.l2))
"""


@query("f01_object_counts", COUNTS + "select *, building_count + zone_count + surface_count + material_count + construction_count as objects from counts")
def _(t):
    return M.object_counts(model(t)).drop("chars")


@query("f02_objects_of", MODEL + """
x as (select model, i, kind, cons, 'BuildingSurface:Detailed' as obj_type, null as floor from surf
  union all select model, nk, 'none', 'none', 'Zone', case when nk % 5 = 0 then 'autocalculate' else cast(nk * 10 as varchar) end from z)
select model, obj_type, cast(i as bigint) as obj_idx, kind as "Surface_Type", cons as "Construction_Name", coalesce(floor, 'none') as "Floor_Area", row_number() over (partition by model, obj_type order by i) as "index" from x""")
def _(t):
    v = M.objects_of(model(t), ["BuildingSurface:Detailed", "Zone"], ["Surface_Type", "Construction_Name", "Floor_Area"], "none")
    return M.numbered(v)


@query("f03_validate_model", COUNTS + "select * from issues")
def _(t):
    return M.validate_model(model(t))


@query("f03_validity", COUNTS + """
select c.*, c.building_count + zone_count + surface_count + material_count + construction_count as objects,
  cast(count(*) filter (severity = 'error') as bigint) as errors, cast(count(*) filter (severity = 'warning') as bigint) as warnings, count(*) filter (severity = 'error') = 0 as is_valid
from counts c left join issues i using (model) group by all""")
def _(t):
    o = model(t)
    return M.validity(o, M.validate_model(o)).drop("chars")


def loads(t, methods, columns):
    pick = F.lit(None).cast("string")
    for i, m in enumerate(methods):
        pick = F.when(F.col("l_linenumber") % (len(methods) + 1) == i, F.lit(m)).otherwise(pick)
    vals = {c: F.when(F.col("l_quantity") > 3 + i, (F.col("l_quantity") + i).cast("string")).otherwise("") for i, c in enumerate(columns)}
    return t.lineitem.select(
        F.col("l_returnflag").alias("model"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("zone"), pick.alias("method"), "l_orderkey", "l_linenumber", *[c.alias(n) for n, c in vals.items()]
    )


def zone_areas(t):
    flags = F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("model")
    area = F.when(F.col("s_suppkey") % 4 == 0, "autocalculate").otherwise((F.col("s_suppkey") + 0.5).cast("string"))
    return t.supplier.filter("s_suppkey % 9 <> 0").select(flags, F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("zone"), area.alias("floor_area"))


LOADS = """
with l as (select l_returnflag as model, l_suppkey, l_linenumber % 4 as m, l_quantity as q from lineitem),
d as (select model, case m {names} end as method, case m {values} end as design
  from l left join (select s_suppkey, case when s_suppkey % 4 <> 0 then s_suppkey + 0.5 end as area from supplier where s_suppkey % 9 <> 0) on s_suppkey = l_suppkey)
select model, method, cast(count(*) as bigint) as objects, cast(count(design) as bigint) as known, round(cast(sum(cast(design as decimal(30,10))) as double), 2) as total from d group by model, method
"""


def summary(t, rules, columns, names):
    d = M.design_values(loads(t, names, columns), zone_areas(t), rules)
    return M.load_summary(d.withColumn("design", F.col("design").cast("decimal(30,10)")), ["model", "method"]).withColumn("total", F.round(F.col("total").cast("double"), 2))


@query("f04_people", LOADS.format(
    names="when 0 then 'people' when 1 then 'People/Area' when 2 then 'Area/Person'",
    values="when 0 then case when q > 3 then q end when 1 then case when q > 4 then (q + 1) * area end when 2 then case when q > 5 then area / (q + 2) end",
))
def _(t):
    return summary(t, M.PEOPLE, ["number_of_people", "people_per_area", "area_per_person"], ["people", "People/Area", "Area/Person"])


WATTS = "when 0 then case when q > 3 then q end when 1 then case when q > 4 then (q + 1) * area end when 2 then case when q > 5 then q + 2 end"


@query("f05_lights", LOADS.format(names="when 0 then 'LightingLevel' when 1 then 'Watts/Area' when 2 then 'Watts/Person'", values=WATTS))
def _(t):
    return summary(t, M.LIGHTS, ["lighting_level", "watts_per_area", "watts_per_person"], ["LightingLevel", "Watts/Area", "Watts/Person"])


@query("f06_equipment", LOADS.format(names="when 0 then 'EquipmentLevel' when 1 then 'Watts/Area' when 2 then 'Watts/Person'", values=WATTS))
def _(t):
    return summary(t, M.EQUIPMENT, ["design_level", "watts_per_area", "watts_per_person"], ["EquipmentLevel", "Watts/Area", "Watts/Person"])


OVERVIEW = """
with l as (select l_returnflag as model, 'S' || l_suppkey as zone, l_suppkey, l_linenumber % 4 as m, l_quantity as q from lineitem),
d as (select model, zone, case m {names} end as method, cast(case m {values} end as decimal(30,10)) as design
  from l left join (select s_suppkey, case when s_suppkey % 4 <> 0 then s_suppkey + 0.5 end as area from supplier where s_suppkey % 9 <> 0) on s_suppkey = l_suppkey),
g as (select model, 'method' as scope, method as key, design from d where method is not null union all select model, 'zone', zone, design from d union all select model, 'all', null, design from d)
select model, scope, key, cast(count(*) as bigint) as objects, cast(count(design) as bigint) as known, round(cast(sum(design) as double), 2) as total from g group by model, scope, key
"""


def overview(t, rules, columns, names):
    d = M.design_values(loads(t, names, columns), zone_areas(t), rules).withColumn("design", F.col("design").cast("decimal(30,10)"))
    return M.load_overview(d).withColumn("total", F.round(F.col("total").cast("double"), 2))


LEVELS = ["lighting_level", "watts_per_area", "watts_per_person"]


@query("f04_people_overview", OVERVIEW.format(
    names="when 0 then 'People' when 1 then 'People/Area' when 2 then 'Area/Person'",
    values="when 0 then case when q > 3 then q end when 1 then case when q > 4 then (q + 1) * area end when 2 then case when q > 5 then area / (q + 2) end",
))
def _(t):
    return overview(t, M.PEOPLE, ["number_of_people", "people_per_area", "area_per_person"], ["People", "People/Area", "Area/Person"])


@query("f05_lights_overview", OVERVIEW.format(names="when 0 then 'LightingLevel' when 1 then 'Watts/Area' when 2 then 'Watts/Person'", values=WATTS))
def _(t):
    return overview(t, M.LIGHTS, LEVELS, ["LightingLevel", "Watts/Area", "Watts/Person"])


@query("f06_equipment_overview", OVERVIEW.format(names="when 0 then 'EquipmentLevel' when 1 then 'Watts/Area' when 2 then 'Watts/Person'", values=WATTS))
def _(t):
    return overview(t, M.EQUIPMENT, ["design_level", "watts_per_area", "watts_per_person"], ["EquipmentLevel", "Watts/Area", "Watts/Person"])


@query("f05_lights_by_zone", """
select l_returnflag as model, 'S' || l_suppkey as zone, l_orderkey, l_linenumber, row_number() over (partition by l_returnflag, l_suppkey order by l_orderkey, l_linenumber) as seq from lineitem""")
def _(t):
    d = M.design_values(loads(t, ["LightingLevel", "Watts/Area", "Watts/Person"], LEVELS), zone_areas(t), M.LIGHTS)
    return M.loads_by_zone(d, "l_orderkey", ["l_linenumber"]).select("model", "zone", "l_orderkey", "l_linenumber", "seq")


def lights(t):
    o = t.customer.join(zones(t), F.col("c_nationkey") == F.col("nk"))
    return M.objects_from(
        o, F.col("model"), "Lights", F.col("c_custkey"),
        {"Name": F.col("c_name"), M.LIGHTS_RULES.zone_field: F.col("n_name"), "Lighting_Level": F.col("c_acctbal").cast("decimal(18,2)"), "Fraction_Radiant": F.lit("0.4")},
    )


def light_specs(t):
    """Requests from the nation and supplier tables: per zone, by name, on all."""
    one = lambda f, v: F.create_map(F.lit(f), v)
    zone = t.nation.filter("n_nationkey < 12").select(F.col("n_nationkey").cast("bigint").alias("seq"), F.concat(F.lit("zone: "), F.lower("n_name")).alias("target"), one("Lighting_Level", (F.col("n_nationkey") * 2 - 4).cast("string")).alias("updates"))
    name = t.supplier.select((F.col("s_suppkey") + 1000).alias("seq"), F.concat(F.lit("name:Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("target"), one("Fraction_Radiant", (F.col("s_suppkey") / 64).cast("string")).alias("updates"))
    every = t.region.select((F.col("r_regionkey") + 100).cast("bigint").alias("seq"), F.lit("all").alias("target"), one("Schedule_Name", F.col("r_name")).alias("updates"))
    return zone.union(name).union(every)


LIGHT_SQL = """
with z as (select n_nationkey as nk, cast(n_regionkey as varchar) as model, n_name from nation),
c as (select model, c_custkey as i, c_name as name, nk, cast(cast(c_acctbal as decimal(18,2)) as varchar) as level from customer join z on c_nationkey = nk),
hits as (
  select model, i, name, nk as seq, 'Lighting_Level' as field_name, level as old, cast(nk * 2 - 4 as varchar) as new_value from c where nk < 12 and nk >= 2
  union all select model, i, name, s_suppkey + 1000, 'Fraction_Radiant', '0.4', cast(s_suppkey / 64 as varchar) from c join supplier on s_suppkey = i where s_suppkey <= 64
  union all select model, i, name, 100 + r_regionkey, 'Schedule_Name', coalesce(lag(r_name) over (partition by model, i order by r_regionkey), ''), r_name from c, region)
"""


@query("f07_apply_updates_audit", LIGHT_SQL + "select model, 'Lights' as obj_type, i as obj_idx, name as object_name, cast(seq as bigint) as seq, field_name, old as old_value, new_value from hits")
def _(t):
    return M.apply_updates(lights(t), light_specs(t), M.LIGHTS_RULES).audit


@query("f07_apply_updates_objects", LIGHT_SQL + """
select model, i as obj_idx, f as field_name, coalesce((select arg_max(new_value, seq) from hits h where h.model = c.model and h.i = c.i and h.field_name = f),
  case f when 'Lighting_Level' then level when 'Fraction_Radiant' then '0.4' end) as value from c, (values ('Lighting_Level'), ('Fraction_Radiant'), ('Schedule_Name')) x(f)""")
def _(t):
    o = M.apply_updates(lights(t), light_specs(t), M.LIGHTS_RULES).objects
    return o.filter(~F.col("field_name").isin("Name", M.LIGHTS_RULES.zone_field)).select("model", "obj_idx", "field_name", "value")


@query("f07_apply_updates_errors", """
select cast(n_nationkey as bigint) as seq, 'Not a number >= 0: Lighting_Level' as error from nation where n_nationkey < 2
union all select s_suppkey + 1000, 'Not between 0 and 1: Fraction_Radiant' from supplier where s_suppkey > 64""")
def _(t):
    return M.apply_updates(lights(t), light_specs(t), M.LIGHTS_RULES).errors


@query("f08_validate_specs", """
select o_orderkey as seq, 'error' as severity, 'Missing target' as message from orders where o_orderpriority = '1-URGENT'
union all select o_orderkey, 'error', 'Invalid target format: ' || o_orderpriority from orders where o_orderpriority in ('2-HIGH', '3-MEDIUM')
union all select o_orderkey, 'error', 'Invalid field name: Colour' from orders where o_orderstatus = 'P'
union all select o_orderkey, 'warning', 'Method LightingLevel set together with other values' from orders where o_orderstatus = 'F'""")
def _(t):
    target = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None)).when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), F.col("o_orderpriority")).otherwise("all")
    f = F.when(F.col("o_orderstatus") == "P", "Colour").otherwise("Watts_per_Floor_Area")
    method = F.when(F.col("o_orderstatus") == "F", "LightingLevel").otherwise("Watts/Area")
    specs = t.orders.select(F.col("o_orderkey").alias("seq"), target.alias("target"), F.create_map(f, F.lit("3"), F.lit("Design_Level_Calculation_Method"), method).alias("updates"))
    return M.validate_specs(specs, M.LIGHTS_RULES)


@query("f09_set_settings", """
with z as (select n_nationkey as nk, cast(n_regionkey as varchar) as model from nation), s as (select z.model, s_suppkey as i, s_name from supplier join z on s_nationkey = nk),
k as (select *, row_number() over (partition by model order by i) as k from s)
select model, i as obj_idx, f as field_name, case f when 'Name' then case when k = 2 then 'second' else s_name end when 'Begin_Month' then '1' else '7' end as value
from k, (values ('Name'), ('Begin_Month'), ('End_Month')) x(f) where f <> 'End_Month' or k = 2""")
def _(t):
    s = t.supplier.join(zones(t), F.col("s_nationkey") == F.col("nk"))
    o = M.objects_from(s, F.col("model"), "RunPeriod", F.col("s_suppkey"), {"Name": F.col("s_name"), "Begin_Month": F.lit("1")})
    out = M.set_settings(o, "RunPeriod", 1, {"Name": "second", "End_Month": "7", "Colour": "red"}, ["Name", "Begin_Month", "End_Month"])
    return out.objects.select("model", "obj_idx", "field_name", "value")


@query("f10_coat_exterior", MODEL + """
c as (select distinct cons.model, l1 from cons join surf on surf.model = cons.model and surf.cons = cons.name where outdoors and kind = 'Wall')
select m.model, 'Material' as obj_type, m.i as obj_idx, m.name as object_name, f as field_name, case when f like 'Solar%' then '0.7' else '' end as old_value, v as new_value
from mat m join c on c.model = m.model and c.l1 = m.name, (values ('Solar_Absorptance', '0.4'), ('Thermal_Absorptance', '0.9')) x(f, v)""")
def _(t):
    return M.coat_exterior(model(t), "wall", 0.4, 0.9).audit


def windowed(t):
    o = model(t)
    p = t.supplier.join(zones(t), F.col("s_nationkey") == F.col("nk"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "Door").otherwise("WINDOW")
    host = F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0"))
    return o.union(M.objects_from(p, F.col("model"), "FenestrationSurface:Detailed", F.col("s_suppkey"), {"Name": F.col("s_name"), "Surface_Type": kind, "Building_Surface_Name": host, "Construction_Name": F.lit("glass")}))


@query("f11_film_windows", MODEL + """
w as (select z.model, s_suppkey as i, s_name as name, 'Customer#' || lpad(cast(s_suppkey * 3 as varchar), 9, '0') as host from supplier join z on s_nationkey = nk where s_suppkey % 3 <> 0)
select w.model, 'FenestrationSurface:Detailed' as obj_type, w.i as obj_idx, w.name as object_name, 'Construction_Name' as field_name, 'glass' as old_value,
  'cons_outside_window_film_' || substring(md5(w.model || '|4.94|0.45|0.66'), 1, 10) as new_value from w join surf s on s.model = w.model and s.name = w.host where outdoors""")
def _(t):
    return M.film_windows(windowed(t), 4.94, 0.45, 0.66).audit


@query("f12_scale_by_method", """
with l as (select l_orderkey, l_linenumber, l_partkey, case l_linenumber % 4 when 0 then 'flow/zone' when 1 then 'Flow/Area' when 2 then 'AirChanges/Hour' else 'Unknown' end as method, l_quantity as q from lineitem)
select l_orderkey, l_linenumber, l_partkey, method, case method when 'flow/zone' then 'Design_Flow_Rate' when 'Flow/Area' then 'Flow_Rate_per_Floor_Area' else 'Air_Changes_per_Hour' end as field_name,
  round(q * 0.9, 4) as new_value, null as error from l where method <> 'Unknown' and not (method = 'Flow/Area' and q > 40)
union all select l_orderkey, l_linenumber, l_partkey, method, null, null, case when method = 'Unknown' then 'unknown method: Unknown' else 'no value to scale' end from l where method = 'Unknown' or (method = 'Flow/Area' and q > 40)""")
def _(t):
    m = F.col("l_linenumber") % 4
    method = F.when(m == 0, "flow/zone").when(m == 1, "Flow/Area").when(m == 2, "AirChanges/Hour").otherwise("Unknown")
    v = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", method.alias("method"), F.col("l_quantity").alias("Design_Flow_Rate"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("Flow_Rate_per_Floor_Area"), F.col("l_quantity").alias("Air_Changes_per_Hour")
    )
    audit, errors = M.scale_by_method(v, 0.9)
    audit = audit.withColumn("new_value", F.round("new_value", 4)).drop("old_value")
    return audit.unionByName(errors, allowMissingColumns=True)


def schedule_objects(t):
    kinds = F.array(*[F.lit(k) for k in (*H.SCHEDULE_GROUPS, "Version")])
    kind = F.get(kinds, (F.col("o_custkey") % 12).cast("int"))
    return t.orders.select(F.col("o_orderpriority").alias("model"), kind.alias("obj_type"), F.col("o_orderkey").alias("obj_idx"), F.lit(0).alias("field_idx"), F.lit("Name").alias("field_name"), F.col("o_orderstatus").alias("value"))


@query("f13_schedule_inventory", """
with k as (select o_orderpriority as model, o_custkey % 12 as c from orders),
g as (select model, case when c = 0 then 'schedule_type_limits' when c < 4 then 'day_schedules' when c < 6 then 'week_schedules' when c < 10 then 'annual_schedules' else 'other_schedules' end as schedule_group,
  list_extract(['ScheduleTypeLimits', 'Schedule:Day:Hourly', 'Schedule:Day:Interval', 'Schedule:Day:List', 'Schedule:Week:Daily', 'Schedule:Week:Compact', 'Schedule:Year', 'Schedule:Compact', 'Schedule:Constant', 'Schedule:File', 'Schedule:File:Shading'], c + 1) as kind from k where c < 11)
select model, schedule_group, cast(count(*) as bigint) as objects, string_agg(distinct kind, ',' order by kind) as types from g group by model, schedule_group""")
def _(t):
    return H.schedule_inventory(schedule_objects(t))


def detailed_objects(t):
    """Every schedule has the same fields, whether its type reads them or not."""
    kinds = F.array(*[F.lit(k) for k in (*H.SCHEDULE_GROUPS, "Version")])
    k = F.col("o_orderkey").cast("string")
    fields = {
        "Name": F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("s"), k)), "Schedule_Type_Limits_Name": F.when(F.col("o_custkey") % 7 > 0, F.col("o_orderstatus")), "Lower_Limit_Value": F.lit("0"),
        "Interpolate_to_Timestep": F.when(F.col("o_custkey") % 5 > 0, "Average"), "Hour_1": k, "Hour_2": F.lit(""), "Value_1": k, "Hourly_Value": F.when(F.col("o_orderkey") % 2 == 0, "4.5"), "File_Name": F.lit("f"),
    }
    return M.objects_from(t.orders, F.col("o_orderpriority"), "?", F.col("o_orderkey"), fields).drop("obj_type").join(t.orders.select(F.col("o_orderkey").alias("obj_idx"), F.get(kinds, (F.col("o_custkey") % 12).cast("int")).alias("obj_type")), "obj_idx").select(*M.OBJECT)


DETAIL_SQL = """
with k as (select o_orderpriority as model, cast(o_orderkey as bigint) as obj_idx, o_custkey % 12 as c, o_custkey as ck, o_orderstatus as st from orders where o_custkey % 12 < 11),
d as (select model, list_extract(['ScheduleTypeLimits', 'Schedule:Day:Hourly', 'Schedule:Day:Interval', 'Schedule:Day:List', 'Schedule:Week:Daily', 'Schedule:Week:Compact', 'Schedule:Year', 'Schedule:Compact', 'Schedule:Constant', 'Schedule:File', 'Schedule:File:Shading'], c + 1) as obj_type,
  obj_idx, case when c = 0 then 'schedule_type_limits' when c < 4 then 'day_schedules' when c < 6 then 'week_schedules' when c < 10 then 'annual_schedules' else 'other_schedules' end as schedule_group,
  case when obj_idx % 3 > 0 then 's' || obj_idx else 'Unknown' end as name, case when c in (1, 2, 3, 6, 7, 8, 9) then case when ck % 7 > 0 then st else 'Not specified' end end as type_limits,
  case when c = 0 then '0' end as lower_limit, case when c = 0 then 'Not specified' end as upper_limit, case when c in (2, 3) then case when ck % 5 > 0 then 'Average' else 'No' end end as interpolate,
  case when c = 8 then case when obj_idx % 2 = 0 then '4.5' else 'Not specified' end end as hourly_value, case when c in (9, 10) then 'f' end as file_name, case when c = 1 then '24 hourly values' end as profile,
  cast(case c when 1 then 2 when 3 then 1 when 8 then 1 - obj_idx % 2 else 0 end as bigint) as points, cast(case c when 1 then 0 when 3 then obj_idx when 8 then case when obj_idx % 2 = 0 then 4.5 end end as double) as low,
  cast(case c when 1 then obj_idx when 3 then obj_idx when 8 then case when obj_idx % 2 = 0 then 4.5 end end as double) as high,
  case when c in (9, 10) then 'skipped' when c in (1, 3) or c = 8 and obj_idx % 2 = 0 then 'values' when c in (2, 7, 8) then 'no values' end as status from k)
"""


@query("f13_schedule_details", DETAIL_SQL + "select * from d")
def _(t):
    return H.schedule_details(detailed_objects(t)).drop("numeric_type", "unit_type", "minutes_per_item", "column_number", "number_of_hours")


@query("f13_value_summary", DETAIL_SQL + """
select model, cast(count(*) as bigint) as schedules, cast(count(*) filter (status = 'values') as bigint) as with_values, cast(count(*) filter (status = 'no values') as bigint) as without_values, cast(count(*) filter (status = 'skipped') as bigint) as skipped_files from d group by model""")
def _(t):
    return H.value_summary(H.schedule_details(detailed_objects(t)))


@query("f14_week_refs", """
select o_orderkey, d as day_type, o_orderstatus || '-' || d as schedule from orders,
  (values ('Sunday'), ('Monday'), ('Tuesday'), ('Wednesday'), ('Thursday'), ('Friday'), ('Saturday'), ('Holiday'), ('SummerDesignDay'), ('WinterDesignDay'), ('CustomDay1'), ('CustomDay2')) x(d)""")
def _(t):
    cols = [F.concat("o_orderstatus", F.lit("-" + d)).alias(f"{d}_ScheduleDay_Name") for d in H.DAY_TYPES]
    return H.week_refs(t.orders.select("o_orderkey", *cols), ["o_orderkey"])
