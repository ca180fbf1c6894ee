"""Building-model objects as a long table: list, validate, modify with an audit trail.

Canonical columns: model, obj_type, obj_idx, field_idx, field_name, value (STRING).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered

OBJ = ["model", "obj_type", "obj_idx"]
OBJECT = [*OBJ, "field_idx", "field_name", "value"]


def objects_from(df: DataFrame, model: Column, obj_type: str, obj_idx: Column, fields: Mapping[str, Column]) -> DataFrame:
    """Wide rows as objects; NULL fields are absent."""
    pairs = F.array(
        *[F.struct(F.lit(i).alias("field_idx"), F.lit(n).alias("field_name"), c.cast("string").alias("value")) for i, (n, c) in enumerate(fields.items())]
    )
    out = df.select(model.cast("string").alias("model"), F.lit(obj_type).alias("obj_type"), obj_idx.cast("bigint").alias("obj_idx"), F.inline(pairs))
    return out.filter(F.col("value").isNotNull())


def objects_of(objects: DataFrame, types: Sequence[str], fields: Sequence[str], default: str | None = None) -> DataFrame:
    """Wide view of the given types; absent fields take ``default``."""
    o = objects.filter(F.col("obj_type").isin(list(types)) & F.col("field_name").isin(list(fields)))
    picks = [F.max(F.when(F.col("field_name") == f, F.col("value"))) for f in fields]
    wide = o.groupBy(*OBJ).agg(*[F.coalesce(p, F.lit(default)).alias(f) for f, p in zip(fields, picks)])
    return wide


def numbered(view: DataFrame, name: str = "index", keys: Sequence[str] = ("model", "obj_type")) -> DataFrame:
    """1-based index inside a model and type."""
    return ordered.position(view, list(keys), "obj_idx", name)


def objects(objects_: DataFrame) -> DataFrame:
    return objects_.select(*OBJ).distinct()


# Object types of the model summary.
COUNTED = {
    "building": ["Building"],
    "zone": ["Zone"],
    "surface": ["BuildingSurface:Detailed"],
    "material": ["Material", "Material:NoMass"],
    "construction": ["Construction"],
}


def object_counts(objects_: DataFrame, counted: Mapping[str, Sequence[str]] = COUNTED) -> DataFrame:
    """Objects per kind and model, and the size of their values."""
    per = objects_.groupBy(*OBJ).agg(F.sum(F.length("value")).alias("chars"))
    aggs = [F.count_if(F.col("obj_type").isin(list(types))).alias(f"{n}_count") for n, types in counted.items()]
    return per.groupBy("model").agg(*aggs, F.count("*").alias("objects"), F.sum("chars").alias("chars"))


# Object types every model needs, those allowed once, and the field names of construction layers.
REQUIRED = ("Building", "Zone", "SimulationControl")
SINGLE = ("Building", "SimulationControl")
LAYERS = ("Outside_Layer", *[f"Layer_{i}" for i in range(2, 11)])


def validate_model(objects_: DataFrame, material_types: Sequence[str] = ("Material", "Material:NoMass")) -> DataFrame:
    """Issues, one row each: (model, severity, code, subject, detail)."""
    models = objects_.select("model").distinct()
    n = objects_.select(*OBJ).distinct().groupBy("model", "obj_type").agg(F.count("*").alias("n"))
    need = models.select("model", F.explode(F.array(*[F.lit(r) for r in REQUIRED])).alias("obj_type"))
    have = need.join(n, ["model", "obj_type"], "left")

    def issue(df, severity, code, subject, detail):
        return df.select("model", F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.alias("subject"), detail.alias("detail"))

    none = F.lit(None).cast("string")
    missing = issue(have.filter("n is null"), "error", "missing_type", F.col("obj_type"), none)
    many = issue(have.filter((F.col("n") > 1) & F.col("obj_type").isin(list(SINGLE))), "warning", "multiple", F.col("obj_type"), F.col("n").cast("string"))
    field = lambda t, f: objects_.filter((F.col("obj_type") == t) & (F.col("field_name") == f))
    zones = field("Zone", "Name").select("model", F.col("value").alias("zone"))
    used = field("BuildingSurface:Detailed", "Zone_Name").select("model", F.col("value").alias("zone")).distinct()
    bare = issue(zones.join(used, ["model", "zone"], "left_anti").distinct(), "warning", "zone_without_surface", F.col("zone"), none)
    names = objects_.filter(F.col("obj_type").isin(list(material_types)) & (F.col("field_name") == "Name"))
    names = names.select("model", F.col("value").alias("layer")).distinct()
    layers = objects_.filter((F.col("obj_type") == "Construction") & F.col("field_name").isin(list(LAYERS)) & (F.col("value") != ""))
    layers = layers.select("model", "obj_idx", F.col("value").alias("layer"))
    own = field("Construction", "Name").select("model", "obj_idx", F.col("value").alias("construction"))
    lost = layers.join(names, ["model", "layer"], "left_anti").join(own, ["model", "obj_idx"], "left")
    undefined = issue(lost, "error", "undefined_material", F.coalesce("construction", F.lit("Unknown")), F.col("layer"))
    return missing.union(many).union(bare).union(undefined)


def validity(objects_: DataFrame, issues: DataFrame) -> DataFrame:
    """Per model: totals and is_valid."""
    n = issues.groupBy("model").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = object_counts(objects_).join(n, "model", "left").fillna({"errors": 0, "warnings": 0})
    return out.withColumn("is_valid", F.col("errors") == 0)


@dataclass(frozen=True)
class LoadRules:
    """How a calculation method turns into a design value: method -> (value column, kind)."""

    methods: Mapping[str, tuple[str, str]]


# Calculation methods of internal loads.
PEOPLE = LoadRules({"People": ("number_of_people", "direct"), "People/Area": ("people_per_area", "times_area"), "Area/Person": ("area_per_person", "area_over")})
LIGHTS = LoadRules({"LightingLevel": ("lighting_level", "direct"), "Watts/Area": ("watts_per_area", "times_area"), "Watts/Person": ("watts_per_person", "direct")})
EQUIPMENT = LoadRules({"EquipmentLevel": ("design_level", "direct"), "Watts/Area": ("watts_per_area", "times_area"), "Watts/Person": ("watts_per_person", "direct")})


def design_values(loads: DataFrame, zones: DataFrame, rules: LoadRules, strict: bool = False) -> DataFrame:
    """``design`` per load; zone areas by (model, zone). ``strict`` compares methods in exact case."""
    j = loads.join(zones.select("model", "zone", "floor_area"), ["model", "zone"], "left")
    area = F.col("floor_area").cast("string").try_cast("double")
    method = F.col("method") if strict else F.lower("method")
    out = F.lit(None).cast("double")
    for name, (column, kind) in rules.methods.items():
        v = F.col(column).cast("string").try_cast("double")
        value = {"direct": v, "times_area": v * area, "area_over": F.when(v > 0, area / v)}[kind]
        out = F.when(method == (name if strict else name.lower()), value).otherwise(out)
    return j.withColumn("design", out)


def load_summary(designed: DataFrame, by: Sequence[str]) -> DataFrame:
    return designed.groupBy(*by).agg(F.count("*").alias("objects"), F.count("design").alias("known"), F.round(F.sum("design"), 2).alias("total"))


def load_overview(designed: DataFrame) -> DataFrame:
    """Objects, known designs and their sum by method, by zone and in all: (model, scope, key, objects, known, total).

    Loads without a method (zone) are in no row of that scope. One pass: a load is counted before rows are shuffled.
    """
    method, zone = (F.nullif(F.col(c), F.lit("")).alias(c) for c in ("method", "zone"))
    d = designed.select("model", method, zone, "design")
    grid = d.groupingSets([["model", "method"], ["model", "zone"], ["model"]], "model", "method", "zone")
    out = grid.agg(F.grouping("method").alias("__m"), F.grouping("zone").alias("__z"), F.count(F.lit(1)).alias("objects"), F.count("design").alias("known"), F.sum("design").alias("total"))
    scope = F.when(F.col("__m") == 0, "method").when(F.col("__z") == 0, "zone").otherwise("all")
    out = out.select("model", scope.alias("scope"), F.coalesce("method", "zone").alias("key"), "objects", "known", "total")
    return out.filter("scope = 'all' or key is not null")


def loads_by_zone(designed: DataFrame, order: str, ties: Sequence[str] = ()) -> DataFrame:
    """The list of loads of each zone, in order, as rows with their place ``seq`` in it; a hot zone is many tasks."""
    return ordered.position(designed.filter("zone <> ''"), ["model", "zone"], order, "seq", ties=ties)


# Fields that may be changed, and the checks on their new values.
PEOPLE_FIELDS = {
    "Number_of_People_Schedule_Name": "text",
    "Number_of_People_Calculation_Method": "method",
    "Number_of_People": "text",
    "People_per_Floor_Area": "text",
    "Floor_Area_per_Person": "text",
    "Fraction_Radiant": "text",
    "Sensible_Heat_Fraction": "text",
    "Activity_Level_Schedule_Name": "text",
    "Carbon_Dioxide_Generation_Rate": "text",
    "Enable_ASHRAE_55_Comfort_Warnings": "text",
    "Mean_Radiant_Temperature_Calculation_Type": "text",
    "Surface_Name_or_Angle_Factor_List_Name": "text",
    "Work_Efficiency_Schedule_Name": "text",
    "Clothing_Insulation_Schedule_Name": "text",
    "Air_Velocity_Schedule_Name": "text",
    "Thermal_Comfort_Model_1_Type": "text",
    "Thermal_Comfort_Model_2_Type": "text",
}
LIGHTS_FIELDS = {
    "Schedule_Name": "text",
    "Design_Level_Calculation_Method": "method",
    "Lighting_Level": "positive",
    "Watts_per_Floor_Area": "positive",
    "Watts_per_Person": "positive",
    "Return_Air_Fraction": "fraction",
    "Fraction_Radiant": "fraction",
    "Fraction_Visible": "fraction",
    "Fraction_Replaceable": "fraction",
    "EndUse_Subcategory": "text",
    "Return_Air_Fraction_Calculated_from_Plenum_Temperature": "yes_no",
    "Return_Air_Fraction_Function_of_Plenum_Temperature_Coefficient_1": "positive",
    "Return_Air_Fraction_Function_of_Plenum_Temperature_Coefficient_2": "positive",
    "Return_Air_Heat_Gain_Node_Name": "text",
    "Exhaust_Air_Heat_Gain_Node_Name": "text",
}
EQUIPMENT_FIELDS = {
    "Schedule_Name": "text",
    "Design_Level_Calculation_Method": "method",
    "Design_Level": "positive",
    "Watts_per_Floor_Area": "positive",
    "Watts_per_Person": "positive",
    "Fraction_Latent": "fraction",
    "Fraction_Radiant": "fraction",
    "Fraction_Lost": "fraction",
    "EndUse_Subcategory": "text",
}


@dataclass(frozen=True)
class UpdateRules:
    """``fields``: allowed field -> check (text, method, positive, fraction, yes_no)."""

    obj_type: str
    fields: Mapping[str, str]
    methods: Sequence[str]
    zone_field: str
    method_field: str = ""
    name_field: str = "Name"
    clashes: Mapping[str, Sequence[str]] | None = None


PEOPLE_RULES = UpdateRules("People", PEOPLE_FIELDS, list(PEOPLE.methods), "Zone_or_ZoneList_Name", "Number_of_People_Calculation_Method")
LIGHTS_RULES = UpdateRules(
    "Lights", LIGHTS_FIELDS, list(LIGHTS.methods), "Zone_or_ZoneList_or_Space_or_SpaceList_Name", "Design_Level_Calculation_Method",
    clashes={"LightingLevel": ["Watts_per_Floor_Area"], "Watts/Area": ["Lighting_Level"], "Watts/Person": ["Lighting_Level", "Watts_per_Floor_Area"]},
)
EQUIPMENT_RULES = UpdateRules(
    "ElectricEquipment", EQUIPMENT_FIELDS, list(EQUIPMENT.methods), "Zone_or_ZoneList_or_Space_or_SpaceList_Name", "Design_Level_Calculation_Method",
    clashes={"EquipmentLevel": ["Watts_per_Floor_Area"], "Watts/Area": ["Design_Level"], "Watts/Person": ["Design_Level", "Watts_per_Floor_Area"]},
)


def validate_specs(specs: DataFrame, rules: UpdateRules | None = None) -> DataFrame:
    """Issues of update requests ``(seq, target, updates MAP)``: (seq, severity, message)."""
    target = F.col("target")
    fine = (target == "all") | target.startswith("zone:") | target.startswith("name:")
    checks = [
        (target.isNull(), "error", F.lit("Missing target")),
        (F.col("updates").isNull(), "error", F.lit("Missing updates")),
        (target.isNotNull() & (target != "") & ~fine, "error", F.concat(F.lit("Invalid target format: "), target)),
    ]
    if rules is not None and rules.clashes:
        for method, fields in rules.clashes.items():
            both = F.arrays_overlap(F.map_keys("updates"), F.array(*[F.lit(f) for f in fields]))
            checks.append(((F.col("updates")[rules.method_field] == method) & both, "warning", F.lit(f"Method {method} set together with other values")))
    rows = F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), m.alias("message"))) for c, s, m in checks])
    out = specs.select("seq", F.inline(F.array_compact(rows)))
    if rules is None:
        return out
    unknown = specs.select("seq", F.explode(F.map_keys("updates")).alias("f")).filter(~F.col("f").isin(list(rules.fields)))
    return out.union(unknown.select("seq", F.lit("error").alias("severity"), F.concat(F.lit("Invalid field name: "), "f").alias("message")))


@dataclass(frozen=True)
class Updated:
    objects: DataFrame
    audit: DataFrame
    errors: DataFrame


def _check(rules: UpdateRules) -> Column:
    """Reason to reject a new value, NULL if it is fine."""
    of = lambda kind: [f for f, k in rules.fields.items() if k == kind]
    f, v = F.col("field_name"), F.col("new_value")
    num = v.try_cast("double")
    return (
        F.when(~f.isin(list(rules.fields)), F.concat(F.lit("Invalid field: "), f))
        .when(f.isin(of("method")) & ~v.isin(list(rules.methods)), F.concat(F.lit("Invalid calculation method: "), v))
        .when(f.isin(of("fraction")) & (num.isNull() | (num < 0) | (num > 1)), F.concat(F.lit("Not between 0 and 1: "), f))
        .when(f.isin(of("positive")) & (num.isNull() | (num < 0)), F.concat(F.lit("Not a number >= 0: "), f))
        .when(f.isin(of("yes_no")) & ~F.lower(v).isin("yes", "no"), F.concat(F.lit("Neither yes nor no: "), f))
    )


def apply_updates(objects_: DataFrame, specs: DataFrame, rules: UpdateRules, strict: bool = False) -> Updated:
    """Apply ``(seq, target, updates)`` to objects of one type; later requests win.

    A structural error in any request stops all of them; a value that fails its check becomes an error row.
    """
    broken = validate_specs(specs).filter("severity = 'error'").select("seq", F.col("message").alias("error"))
    stop = broken.agg((F.count("*") > 0).alias("__stop"))  # one row
    flat = specs.select("seq", F.trim("target").alias("target"), F.explode("updates").alias("field_name", "new_value"))
    flat = flat.withColumn("error", _check(rules))
    errors = broken.unionByName(flat.filter("error is not null").select("seq", "error"))
    good = flat.filter("error is null").drop("error").join(F.broadcast(stop)).filter("not __stop").drop("__stop")

    fold = (lambda c: c) if strict else F.lower
    view = objects_of(objects_, [rules.obj_type], [rules.name_field, rules.zone_field])
    view = view.select(*OBJ, F.col(rules.name_field).alias("object_name"), fold(F.col(rules.name_field)).alias("__n"), fold(F.col(rules.zone_field)).alias("__z"))
    rest = fold(F.trim(F.substring("target", F.lit(6), F.length("target"))))
    # fields are whitelisted, so one row holds all requests on every object
    every = good.filter("target = 'all'").groupBy("field_name").agg(F.array_sort(F.collect_list(F.struct("seq", "new_value"))).alias("u"))
    every = every.agg(F.collect_list(F.struct("field_name", "u")).alias("all"))
    to_all = view.join(F.broadcast(every)).select(*OBJ, "object_name", F.inline("all")).select(*OBJ, "object_name", "field_name", F.inline("u"))
    zone = good.filter(F.col("target").startswith("zone:")).withColumn("__z", rest)
    to_zone = view.join(zone, "__z").select(*OBJ, "object_name", "field_name", "seq", "new_value")
    first = view.groupBy("model", "__n").agg(F.min(F.struct("obj_idx", "obj_type", "object_name")).alias("o"))
    first = first.select("model", "o.obj_type", "o.obj_idx", "o.object_name", "__n")
    name = good.filter(F.col("target").startswith("name:")).withColumn("__n", rest)
    to_name = first.join(name, "__n").select(*OBJ, "object_name", "field_name", "seq", "new_value")
    hits = to_all.unionByName(to_zone).unionByName(to_name)

    old = objects_.filter(F.col("obj_type") == rules.obj_type).select(*OBJ, "field_name", F.col("value").alias("__old"))
    # one partition per object field: as many rows as requests name it
    w = Window.partitionBy(*OBJ, "field_name").orderBy("seq")
    audit = hits.join(old, [*OBJ, "field_name"], "left").withColumn("old_value", F.coalesce(F.lag("new_value").over(w), F.col("__old"), F.lit("")))
    audit = audit.select(*OBJ, "object_name", "seq", "field_name", "old_value", "new_value")
    return Updated(_write(objects_, hits.groupBy(*OBJ, "field_name").agg(F.max_by("new_value", "seq").alias("new_value"))), audit, errors)


def _write(objects_: DataFrame, new: DataFrame) -> DataFrame:
    """Replace values by (object, field); fields an object lacked are added."""
    out = objects_.join(new, [*OBJ, "field_name"], "full_outer")
    return out.select(*OBJ, "field_idx", "field_name", F.coalesce("new_value", "value").alias("value"))


def set_settings(objects_: DataFrame, obj_type: str, index: int, updates: Mapping[str, str], known: Sequence[str]) -> Updated:
    """Update the ``index``-th (0-based) object of a type in every model; unknown fields only warn."""
    view = objects_.filter(F.col("obj_type") == obj_type).select(*OBJ).distinct()
    pick = ordered.top_per_group(view, ["model"], [F.col("obj_idx")], index + 1).filter(F.col("rank") == index + 1).drop("rank")
    good = {k: v for k, v in updates.items() if k in known}
    spark = objects_.sparkSession
    warn = spark.createDataFrame([(f"Unknown field ignored: {k}",) for k in updates if k not in known], "error string")
    if not good:
        return Updated(objects_, pick.limit(0).select(*OBJ), warn)
    pairs = F.array(*[F.struct(F.lit(k).alias("field_name"), F.lit(v).alias("new_value")) for k, v in good.items()])
    new = pick.select(*OBJ, F.inline(pairs))
    old = objects_.select(*OBJ, "field_name", F.col("value").alias("old_value"))
    audit = new.join(old, [*OBJ, "field_name"], "left").fillna({"old_value": ""})
    return Updated(_write(objects_, new), audit, warn)


def coat_exterior(objects_: DataFrame, location: str, solar: float, thermal: float) -> Updated:
    """Set the absorptances of the outside layers of all exterior surfaces of a kind (wall or roof)."""
    kind = location.lower()
    s = objects_of(objects_, ["BuildingSurface:Detailed", "Wall:Detailed" if kind == "wall" else "Roof"], ["Surface_Type", "Outside_Boundary_Condition", "Construction_Name"])
    outer = s.filter((F.lower("Surface_Type") == kind) & (F.lower("Outside_Boundary_Condition") == "outdoors")).select("model", "Construction_Name")
    if kind == "wall":
        outer = outer.union(objects_of(objects_, ["Wall:Exterior"], ["Construction_Name"]).select("model", "Construction_Name"))
    c = objects_of(objects_, ["Construction"], ["Name", "Outside_Layer"])
    c = c.join(outer.distinct().withColumnRenamed("Construction_Name", "Name"), ["model", "Name"], "left_semi")
    layers = c.select("model", F.col("Outside_Layer").alias("Name")).distinct()
    m = objects_of(objects_, ["Material", "Material:NoMass"], ["Name"]).join(layers, ["model", "Name"], "left_semi")
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(str(v)).alias("new_value")) for f, v in (("Solar_Absorptance", solar), ("Thermal_Absorptance", thermal))])
    new = m.select(*OBJ, F.col("Name").alias("object_name"), F.inline(pairs))
    old = objects_.select(*OBJ, "field_name", F.col("value").alias("old_value"))
    audit = new.join(old, [*OBJ, "field_name"], "left").fillna({"old_value": ""})
    return Updated(_write(objects_, new.drop("object_name")), audit, audit.limit(0).select(F.lit("").alias("error")))


def film_windows(objects_: DataFrame, u: float, shgc: float, vt: float) -> Updated:
    """Windows on outdoor surfaces get a film construction; its two objects are added per model."""
    win = objects_of(objects_, ["FenestrationSurface:Detailed", "Window"], ["Name", "Surface_Type", "Building_Surface_Name", "Construction_Name"])
    win = win.filter((F.col("obj_type") == "Window") | (F.lower("Surface_Type") == "window"))
    wall = objects_of(objects_, ["BuildingSurface:Detailed"], ["Name", "Outside_Boundary_Condition"])
    wall = wall.filter(F.lower("Outside_Boundary_Condition") == "outdoors").select("model", F.col("Name").alias("Building_Surface_Name")).distinct()
    hit = win.join(wall, ["model", "Building_Surface_Name"], "left_semi")
    film = F.concat(F.lit("outside_window_film_"), F.substring(F.md5(F.concat_ws("|", "model", F.lit(f"{u}|{shgc}|{vt}"))), 1, 10))
    cons = F.concat(F.lit("cons_"), film)
    new = hit.select(*OBJ, F.lit("Construction_Name").alias("field_name"), cons.alias("new_value"))
    audit = hit.select(*OBJ, F.col("Name").alias("object_name"), F.lit("Construction_Name").alias("field_name"), F.col("Construction_Name").alias("old_value"), cons.alias("new_value"))
    top = objects_.groupBy("model").agg(F.max("obj_idx").alias("__top"))
    added = objects_from(top, F.col("model"), "WindowMaterial:SimpleGlazingSystem", F.col("__top") + 1, {"Name": film, "UFactor": F.lit(u), "Solar_Heat_Gain_Coefficient": F.lit(shgc), "Visible_Transmittance": F.lit(vt)})
    added = added.union(objects_from(top, F.col("model"), "Construction", F.col("__top") + 2, {"Name": cons, "Outside_Layer": film}))
    return Updated(_write(objects_, new).unionByName(added), audit, audit.limit(0).select(F.lit("").alias("error")))


# Which field holds the flow of each infiltration method.
FLOW_FIELDS = {
    "Flow/ExteriorArea": "Flow_Rate_per_Exterior_Surface_Area",
    "Flow/Area": "Flow_Rate_per_Floor_Area",
    "Flow/Zone": "Design_Flow_Rate",
    "Flow/ExteriorWallArea": "Flow_Rate_per_Exterior_Surface_Area",
    "AirChanges/Hour": "Air_Changes_per_Hour",
}


def scale_by_method(view: DataFrame, mult: float, method: str = "method", fields: Mapping[str, str] = FLOW_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Multiply the field that each row's method points at. Returns audit rows and error rows (unknown method)."""
    name = F.lit(None).cast("string")
    old = F.lit(None).cast("double")
    for m, f in fields.items():
        hit = F.lower(method) == m.lower()
        name = F.when(hit, F.lit(f)).otherwise(name)
        if f in view.columns:
            old = F.when(hit, F.col(f).cast("string").try_cast("double")).otherwise(old)
    v = view.withColumns({"field_name": name, "old_value": old})
    keys = [c for c in view.columns if c not in set(fields.values())]
    audit = v.filter("field_name is not null and old_value is not null").select(*keys, "field_name", "old_value", (F.col("old_value") * mult).alias("new_value"))
    errors = v.filter("field_name is null or old_value is null").select(
        *keys, F.when(F.col("field_name").isNull(), F.concat(F.lit("unknown method: "), F.coalesce(F.col(method), F.lit("NULL")))).otherwise("no value to scale").alias("error")
    )
    return audit, errors
