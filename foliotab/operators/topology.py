"""Loop topology as component and edge tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .model_objects import objects_of

# Loop types with their end-node and branch-list fields, and equipment served by a splitter outlet.
LOOP_TYPES = {
    "PlantLoop": ("Plant_Side_Inlet_Node_Name", "Plant_Side_Outlet_Node_Name", "Demand_Side_Inlet_Node_Name", "Demand_Side_Outlet_Node_Name"),
    "CondenserLoop": ("Condenser_Side_Inlet_Node_Name", "Condenser_Side_Outlet_Node_Name", "Demand_Side_Inlet_Node_Name", "Demand_Side_Outlet_Node_Name"),
    "AirLoopHVAC": ("Supply_Side_Inlet_Node_Name", "Supply_Side_Outlet_Node_Names", "Demand_Side_Inlet_Node_Names", "Demand_Side_Outlet_Node_Name"),
}
EQUIPMENT_TYPES = [
    "AirTerminal:SingleDuct:Uncontrolled",
    "AirTerminal:SingleDuct:VAV:Reheat",
    "AirTerminal:SingleDuct:VAV:NoReheat",
    "AirTerminal:SingleDuct:ConstantVolume:Reheat",
    "AirTerminal:SingleDuct:ConstantVolume:NoReheat",
    "AirTerminal:DualDuct:VAV",
    "AirTerminal:DualDuct:ConstantVolume",
    "ZoneHVAC:Baseboard:Convective:Electric",
    "ZoneHVAC:Baseboard:Convective:Water",
    "ZoneHVAC:PackagedTerminalAirConditioner",
    "ZoneHVAC:PackagedTerminalHeatPump",
    "ZoneHVAC:WindowAirConditioner",
    "ZoneHVAC:UnitHeater",
    "ZoneHVAC:UnitVentilator",
    "ZoneHVAC:EnergyRecoveryVentilator",
    "ZoneHVAC:FourPipeFanCoil",
    "ZoneHVAC:IdealLoadsAirSystem",
]


def loops(objects: DataFrame, types: Mapping[str, Sequence[str]] = LOOP_TYPES) -> DataFrame:
    """(model, loop_type, loop, supply_inlet, supply_outlet, demand_inlet, demand_outlet)."""
    out = None
    for kind, (si, so, di, do) in types.items():
        v = objects_of(objects, [kind], ["Name", si, so, di, do], "Unknown")
        v = v.select("model", F.lit(kind).alias("loop_type"), F.col("Name").alias("loop"), F.col(si).alias("supply_inlet"), F.col(so).alias("supply_outlet"), F.col(di).alias("demand_inlet"), F.col(do).alias("demand_outlet"))
        out = v if out is None else out.unionByName(v)
    return out


def numbered_items(objects: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Numbered fields of objects of the given types up to the first blank: (model, obj_type, name, seq, item)."""
    n = F.lit(None).cast("int")
    for kind, pattern in patterns.items():
        n = F.when(F.col("obj_type") == kind, F.regexp_extract("field_name", pattern, 1).try_cast("int")).otherwise(n)
    key = ["obj_idx", "model", "obj_type"]
    o = objects.filter(F.col("obj_type").isin(list(patterns))).select(*key, n.alias("seq"), "field_name", "value")
    heads = o.groupBy(*key).agg(F.max(F.when(F.col("field_name") == "Name", F.col("value"))).alias("name"), F.min(F.when(F.trim("value") == "", F.col("seq"))).alias("__gap"))
    items = o.filter("seq is not null").join(heads.filter("name is not null"), key)
    items = items.filter(F.col("__gap").isNull() | (F.col("seq") < F.col("__gap")))
    return items.select("model", "obj_type", "name", "seq", F.col("value").alias("item"))


def list_items(objects: DataFrame, list_type: str, pattern: str) -> DataFrame:
    """Numbered fields of list objects up to the first blank: (model, list_name, seq, item)."""
    return numbered_items(objects, {list_type: pattern}).select("model", F.col("name").alias("list_name"), "seq", "item")


def components(objects: DataFrame, owner_type: str | Sequence[str], stop_at_blank: bool = True) -> DataFrame:
    """Component_i_* fields of branches and paths: (model, owner_type, owner, seq, type, name, inlet, outlet).

    Fields are spread to rows once, so an object may have any number of components. They are sorted where they meet, not
    before they are shuffled; the components are written once, for the objects' names and ends and for the result.
    """
    kinds = [owner_type] if isinstance(owner_type, str) else list(owner_type)
    key = ["obj_idx", "model", "obj_type"]  # sorts compare the numbers first
    lead = F.substring_index("field_name", "_", 2)
    number, part = F.substring(lead, 11, 100), F.substr("field_name", F.length(lead) + 2)
    numbered = F.col("field_name").startswith("Component_") & (F.translate(number, "0123456789", "") == "") & (part != "")
    o = objects.filter(F.col("obj_type").isin(kinds))
    o = o.select(*key, F.when(numbered, number.try_cast("int")).alias("seq"), F.when(numbered, part).otherwise(F.col("field_name")).alias("part"), "value")
    pick = lambda p: F.max(F.when(F.col("part") == p, F.col("value")))
    named = F.col("seq").isNull() & (F.col("part") == "Name")
    used = o.filter(named | (F.col("seq").isNotNull() & F.col("part").isin("Object_Type", "Name", "Inlet_Node_Name", "Outlet_Node_Name")))
    c = used.repartition(*key, "seq").groupBy(*key, "seq").agg(
        pick("Object_Type").alias("type"), pick("Name").alias("name"), pick("Inlet_Node_Name").alias("inlet"), pick("Outlet_Node_Name").alias("outlet"),
        F.max(F.when(named, F.col("value"))).alias("own"),
    )
    c = cut_lineage(c)
    blank = F.col("seq").isNotNull() & ((F.coalesce("type", F.lit("")) == "") | (F.coalesce("name", F.lit("")) == ""))
    heads = c.groupBy(*key).agg(F.max("own").alias("owner"), F.min(F.when(blank, F.col("seq"))).alias("__gap")).filter("owner is not null")
    c = c.filter("seq is not null").join(heads, key)
    if stop_at_blank:
        c = c.filter(F.col("__gap").isNull() | (F.col("seq") < F.col("__gap")))
    return c.select("model", F.col("obj_type").alias("owner_type"), "owner", "seq", "type", "name", "inlet", "outlet")


def branches(objects: DataFrame, held: DataFrame | None = None, owners: DataFrame | None = None) -> DataFrame:
    """Branch lists to components in order: (model, list_name, branch_seq, branch, seq, type, name, inlet, outlet).

    Branches are among the objects, or in a table ``held`` of their own. ``owners(model, list_name, ...)`` are joined to the
    lists, which are few rows, before the components are.
    """
    b = list_items(objects, "BranchList", r"^Branch_(\d+)_Name$").withColumnsRenamed({"seq": "branch_seq", "item": "branch"})
    if owners is not None:
        b = owners.join(b, ["model", "list_name"])
    c = components(objects if held is None else held, "Branch").drop("owner_type").withColumnRenamed("owner", "branch")
    own = [x for x in b.columns if x not in ("model", "list_name", "branch_seq", "branch")]
    return b.join(c, ["model", "branch"], "left").select("model", "list_name", *own, "branch_seq", "branch", "seq", "type", "name", "inlet", "outlet")


def connectors(objects: DataFrame) -> DataFrame:
    """Connector lists to edges: a splitter has one source and n targets, a mixer n sources and one target."""
    o = objects.filter(F.col("obj_type") == "ConnectorList")
    name = o.filter("field_name = 'Name'").select("model", "obj_idx", F.col("value").alias("list_name"))
    f = o.select("model", "obj_idx", F.regexp_extract("field_name", r"^Connector_(\d+)_", 1).try_cast("int").alias("seq"), F.regexp_extract("field_name", r"^Connector_\d+_(.+)$", 1).alias("part"), "value")
    pick = lambda p: F.max(F.when(F.col("part") == p, F.col("value")))
    c = f.filter("seq is not null").groupBy("model", "obj_idx", "seq").agg(pick("Object_Type").alias("type"), pick("Name").alias("name")).join(name, ["model", "obj_idx"])
    ends = []
    for kind, one, many in (("Connector:Splitter", "Inlet_Branch_Name", r"^Outlet_Branch_(\d+)_Name$"), ("Connector:Mixer", "Outlet_Branch_Name", r"^Inlet_Branch_(\d+)_Name$")):
        single = objects_of(objects, [kind], ["Name", one]).select("model", F.col("Name").alias("name"), F.col(one).alias("one"))
        rest = list_items(objects, kind, many).select("model", F.col("list_name").alias("name"), F.col("item").alias("many"))
        e = c.filter(F.col("type") == kind).join(single, ["model", "name"]).join(rest, ["model", "name"])
        src, dst = ("one", "many") if kind.endswith("Splitter") else ("many", "one")
        ends.append(e.select("model", "list_name", "type", "name", F.col(src).alias("source"), F.col(dst).alias("target")))
    return ends[0].unionByName(ends[1])


# Branch and connector list fields of the two sides of a plant loop.
PLANT_SIDES = {
    "supply": ("Plant_Side_Branch_List_Name", "Plant_Side_Connector_List_Name"),
    "demand": ("Demand_Side_Branch_List_Name", "Demand_Side_Connector_List_Name"),
}


# The objects that list branches and connectors.
PLANT_PARTS = ("BranchList", "ConnectorList", "Connector:Splitter", "Connector:Mixer")


def plant_topology(objects: DataFrame, loop_type: str = "PlantLoop", sides: Mapping[str, tuple[str, str]] = PLANT_SIDES) -> tuple[DataFrame, DataFrame]:
    """Components and connector edges of every loop by side. Lists and connectors are written once and read from there; the
    branches, by far the most, are read once and need not be.
    """
    all_objects, objects = objects, cut_lineage(objects.filter(F.col("obj_type").isin([loop_type, *PLANT_PARTS])))
    fields = [f for pair in sides.values() for f in pair]
    v = objects_of(objects, [loop_type], ["Name", *fields])
    pairs = F.array(*[F.struct(F.lit(s).alias("side"), F.col(b).alias("branch_list"), F.col(c).alias("connector_list")) for s, (b, c) in sides.items()])
    v = v.select("model", F.col("Name").alias("loop"), F.inline(pairs))
    comp = branches(objects, all_objects, v.withColumnRenamed("branch_list", "list_name")).withColumnRenamed("list_name", "branch_list")
    edge = v.join(connectors(objects).withColumnRenamed("list_name", "connector_list"), ["model", "connector_list"])
    return comp.drop("connector_list"), edge.drop("branch_list")


def nested(components_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components of each loop side as one ordered array; the only place where rows are gathered."""
    item = F.struct("branch_seq", "seq", "branch", "type", "name", "inlet", "outlet")
    return components_.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("components"))


# Fields that name the supply branches of an air loop, first filled one; numbered node fields; plenum fields.
AIR_BRANCH_LISTS = ("Branch_List_Name", "Supply_Side_Branch_List_Name", "Supply_Branch_List_Name")
SUPPLY_PATH, RETURN_PATH = "AirLoopHVAC:SupplyPath", "AirLoopHVAC:ReturnPath"
SPLITTER, MIXER, PLENUM = "AirLoopHVAC:ZoneSplitter", "AirLoopHVAC:ZoneMixer", "AirLoopHVAC:ReturnPlenum"
NODE_FIELDS = {SPLITTER: r"^Outlet_(\d+)_Node_Name$", MIXER: r"^Inlet_(\d+)_Node_Name$", PLENUM: r"^Inlet_(\d+)_Node_Name$"}
PLENUM_FIELDS = {"plenum_zone": "Zone_Name", "plenum_zone_node": "Zone_Node_Name", "plenum_outlet": "Outlet_Node_Name", "plenum_induced": "Induced_Air_Outlet_Node_or_NodeList_Name"}


def air_topology(objects: DataFrame) -> DataFrame:
    """Both sides of the air loops as edges: (model, loop, relation, source, target).

    Supply side: branches of the loop's branch list in ``supply_branch``, their components up to the first blank in
    ``branch_component``. Demand side: supply paths are found by the loop's demand inlet node, return paths by its outlet
    node; splitters, mixers and plenums by name, the filled fields of plenums as ``plenum_*``; equipment by the splitter's
    outlet nodes. Every step is an equi join on a name. The objects needed are written once, and one pass each over that
    table gives heads, components, nodes and equipment of all types.
    """
    heads_of = ["AirLoopHVAC", SUPPLY_PATH, RETURN_PATH, PLENUM]
    objects = cut_lineage(objects.filter(F.col("obj_type").isin([*heads_of, SPLITTER, MIXER, "BranchList", "Branch", *EQUIPMENT_TYPES])))
    _, _, inlet, outlet = LOOP_TYPES["AirLoopHVAC"]
    path_in, path_out = "Supply_Air_Path_Inlet_Node_Name", "Return_Air_Path_Outlet_Node_Name"
    heads = cut_lineage(objects_of(objects, heads_of, ["Name", inlet, outlet, path_in, path_out, *AIR_BRANCH_LISTS, *PLENUM_FIELDS.values()]))
    air = heads.filter("obj_type = 'AirLoopHVAC'").select("model", F.col("Name").alias("loop"), F.col(inlet).alias("demand_inlet"), F.col(outlet).alias("demand_outlet"), F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in AIR_BRANCH_LISTS]).alias("list_name"))
    edge = lambda df, rel, s, t: df.select("model", "loop", F.lit(rel).alias("relation"), F.col(s).alias("source"), F.col(t).alias("target"))

    def paths(kind, field, node):
        p = heads.filter(F.col("obj_type") == kind).select("model", F.col("Name").alias("path"), F.col(field).alias("node"), F.col("obj_type").alias("owner_type"))
        return air.select("model", "loop", F.col(node).alias("node")).join(p, ["model", "node"])

    sup, ret = paths(SUPPLY_PATH, path_in, "demand_inlet"), paths(RETURN_PATH, path_out, "demand_outlet")
    parts = components(objects, [SUPPLY_PATH, RETURN_PATH]).select("model", "owner_type", F.col("owner").alias("path"), "type", "name")
    parts = cut_lineage(sup.unionByName(ret).join(parts, ["model", "owner_type", "path"]))
    sup_c, ret_c = parts.filter(F.col("owner_type") == SUPPLY_PATH), parts.filter(F.col("owner_type") == RETURN_PATH)

    used = parts.filter(((F.col("owner_type") == SUPPLY_PATH) & (F.col("type") == SPLITTER)) | ((F.col("owner_type") == RETURN_PATH) & F.col("type").isin(MIXER, PLENUM)))
    nodes = numbered_items(objects, NODE_FIELDS).select("model", F.col("obj_type").alias("type"), "name", F.col("item").alias("port"))
    nodes = cut_lineage(used.select("model", "loop", "type", "name").join(nodes, ["model", "type", "name"]))
    split = nodes.filter(F.col("type") == SPLITTER)
    into = F.when(F.col("type") == MIXER, "mixer").otherwise("plenum")
    mixed = nodes.filter(F.col("type") != SPLITTER).select("model", "loop", into.alias("relation"), F.col("port").alias("source"), F.col("name").alias("target"))
    fields = F.array(*[F.struct(F.lit(r).alias("relation"), F.col(c).alias("target")) for r, c in PLENUM_FIELDS.items()])
    plenums = heads.filter(F.col("obj_type") == PLENUM).select("model", F.col("Name").alias("name"), F.inline(fields)).filter("target <> ''")
    plenums = ret_c.filter(F.col("type") == PLENUM).select("model", "loop", "name").join(plenums, ["model", "name"])
    inlets = ["Air_Inlet_Node_Name", "Supply_Air_Inlet_Node_Name", "Zone_Supply_Air_Node_Name"]
    eq = objects_of(objects, EQUIPMENT_TYPES, ["Name", *inlets]).select("model", F.col("Name").alias("equipment"), F.coalesce(*inlets).alias("port"))
    served = split.select("model", "loop", "port").distinct().join(eq, ["model", "port"])
    listed = air.select("model", "loop", "list_name").join(list_items(objects, "BranchList", r"^Branch_(\d+)_Name$"), ["model", "list_name"]).withColumnRenamed("item", "branch")
    listed = cut_lineage(listed.select("model", "loop", "branch"))
    held = listed.join(components(objects, "Branch").select("model", F.col("owner").alias("branch"), "name"), ["model", "branch"])
    return (
        edge(sup, "supply_path", "node", "path")
        .unionByName(edge(ret, "return_path", "path", "node"))
        .unionByName(edge(sup_c, "supply_component", "path", "name"))
        .unionByName(edge(ret_c, "return_component", "name", "path"))
        .unionByName(edge(split, "splitter", "name", "port"))
        .unionByName(mixed)
        .unionByName(plenums.select("model", "loop", "relation", F.col("name").alias("source"), "target"))
        .unionByName(edge(served, "equipment", "port", "equipment"))
        .unionByName(edge(listed, "supply_branch", "loop", "branch"))
        .unionByName(edge(held, "branch_component", "branch", "name"))
    )


def count_components(components_: DataFrame, keys: Sequence[str] = ("loop", "side")) -> DataFrame:
    """Distinct components per loop and side."""
    return components_.groupBy(*keys).agg(F.count_distinct("type", "name").alias("components"))
