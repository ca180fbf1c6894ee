"""Output variables and meters: catalog categories, request validation, duplicates, file finding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.matching import nearest_names
from ..functions.text import edit_ratio, first_match

# Ordered keyword rules, reporting frequencies and meter types.
VARIABLE_RULES = [
    ("Temperature", ["temperature"]),
    ("Energy", ["energy", "electricity", "gas"]),
    ("Flow/Mass", ["flow", "mass"]),
    ("Humidity", ["humidity", "moisture"]),
    ("Zone", ["zone"]),
    ("HVAC System", ["system", "hvac"]),
    ("Surface", ["surface"]),
    ("Site/Outdoor", ["site", "outdoor"]),
]
RESOURCE_RULES = [
    ("Electricity", ["electricity"]),
    ("NaturalGas", ["naturalgas", ":gas"]),
    ("Steam", ["steam"]),
    ("EnergyTransfer", ["energytransfer", "energy transfer"]),
    ("Carbon Equivalent", ["carbon", "co2"]),
    ("ElectricityPurchased", ["purchased"]),
    ("ElectricitySurplusSold", ["surplus"]),
    ("ElectricityNet", ["net"]),
]
END_USE_RULES = [
    ("Facility Total", ["facility"]),
    ("Building Total", ["building"]),
    ("HVAC Systems", ["hvac"]),
    ("Lighting", ["lighting", "lights"]),
    ("Heating", ["heating"]),
    ("Cooling", ["cooling"]),
    ("Zone-Specific", ["zone:"]),
    ("Fans", ["fans"]),
    ("Pumps", ["pumps"]),
    ("Plant Equipment", ["plant"]),
    ("Cogeneration", ["cogeneration"]),
    ("Environmental", ["carbon", "co2", "emissions"]),
]
FREQUENCIES = ["detailed", "timestep", "hourly", "daily", "monthly", "runperiod", "environment", "annual"]
METER_TYPES = ["Output:Meter", "Output:Meter:MeterFileOnly", "Output:Meter:Cumulative", "Output:Meter:Cumulative:MeterFileOnly"]


def variable_category(name: Column) -> Column:
    return first_match(name, VARIABLE_RULES, "Other")


def resource_type(name: Column) -> Column:
    low = F.lower(name)
    head, tail = RESOURCE_RULES[:2], RESOURCE_RULES[2:]
    water = F.when(low.contains("mains"), "MainsWater").otherwise("Water")
    return F.coalesce(first_match(name, head, None), F.when(low.contains("water"), water), first_match(name, tail, "Other"))


def end_use(name: Column) -> Column:
    return first_match(name, END_USE_RULES, None)


def category_counts(names: DataFrame, col: str, meters: bool) -> DataFrame:
    """Counts per category; meters count once by resource and once by end use."""
    if not meters:
        return names.groupBy(F.lit("variable").alias("scheme"), variable_category(F.col(col)).alias("category")).agg(F.count("*").alias("n"))
    pairs = F.array(
        F.struct(F.lit("resource").alias("scheme"), resource_type(F.col(col)).alias("category")), F.struct(F.lit("end_use").alias("scheme"), end_use(F.col(col)).alias("category"))
    )
    return names.select(F.inline(pairs)).filter("category is not null").groupBy("scheme", "category").agg(F.count("*").alias("n"))


def normalize_requests(raw: DataFrame, spec: str = "spec") -> DataFrame:
    """``name``, ``[name, freq(, type)]`` or an object, as JSON text, to (name, frequency, kind)."""
    text = F.trim(spec)
    arr = F.from_json(text, "array<string>")
    obj = F.from_json(text, "struct<name:string, meter_name:string, variable_name:string, frequency:string, meter_type:string>")
    is_list, is_obj = text.startswith("["), text.startswith("{")
    name = F.when(is_list, F.get(arr, F.lit(0))).when(is_obj, F.coalesce(obj["name"], obj["meter_name"], obj["variable_name"], F.lit(""))).otherwise(text)
    freq = F.coalesce(F.when(is_list, F.get(arr, F.lit(1))).when(is_obj, obj["frequency"]), F.lit("hourly"))
    kind = F.coalesce(F.when(is_list, F.get(arr, F.lit(2))).when(is_obj, obj["meter_type"]), F.lit("Output:Meter"))
    return raw.withColumns({"name": name, "frequency": freq, "kind": kind})


def validate_requests(requests: DataFrame, catalog: DataFrame, level: str = "moderate", meters: bool = False) -> DataFrame:
    """``verdict`` valid / invalid with error and warning per (name, frequency, kind) request.

    lenient: only the form is checked. moderate: an unknown variable is invalid, an unknown meter a warning.
    strict: anything unknown is invalid.
    """
    known = catalog.select(F.lower("name").alias("__k")).distinct().withColumn("__known", F.lit(True))
    r = requests.withColumn("__k", F.lower("name")).join(known, "__k", "left").drop("__k")
    freq = F.lower(F.trim("frequency"))
    bad_freq = ~F.coalesce(freq.isin(FREQUENCIES), F.lit(False))
    bad_kind = ~F.coalesce(F.col("kind").isin(METER_TYPES), F.lit(False)) if meters else F.lit(False)
    unknown = F.col("__known").isNull() & F.lit(level != "lenient")
    soft = unknown & F.lit(meters and level == "moderate")
    hard = unknown & ~soft
    empty = F.coalesce(F.col("name"), F.lit("")) == ""
    error = F.when(empty, "empty name").when(bad_freq, "invalid frequency").when(bad_kind, "invalid meter type").when(hard, "unknown name")
    out = r.withColumns({"error": error, "warning": F.when(error.isNull() & soft, "unknown name"), "unknown": F.col("__known").isNull() & ~empty})
    return out.withColumn("verdict", F.when(F.col("error").isNull(), "valid").otherwise("invalid")).drop("__known")


def suggestions(names: DataFrame, col: str, catalog: DataFrame, cut: float = 0.6, k: int = 5) -> DataFrame:
    """Up to k catalog names per distinct name, by edit ratio.

    Names meet on shared grams at falling ratios, whatever the size of the catalog; the result is exact.
    """
    top = nearest_names(names, col, catalog, "name", cut, k)
    return top.select(F.col("left_name").alias("name"), F.col("right_name").alias("suggestion"), F.round("similarity", 6).alias("similarity"), "rank")


@dataclass(frozen=True)
class Split:
    added: DataFrame
    duplicates: DataFrame


def split_duplicates(requests: DataFrame, existing: DataFrame, keys: list[str], allow: bool = False, strict: bool = False) -> Split:
    """New and duplicate requests on (key, name, frequency); duplicates are also added if allowed."""
    fold = (lambda c: F.col(c)) if strict else (lambda c: F.lower(F.col(c).cast("string")))
    e = existing.select(*[fold(k).alias(f"__{k}") for k in keys]).distinct()
    r = requests.withColumns({f"__{k}": fold(k) for k in keys})
    on = [f"__{k}" for k in keys]
    dup, new = r.join(e, on, "left_semi").drop(*on), r.join(e, on, "left_anti").drop(*on)
    return Split(requests if allow else new, dup)


def configured_outputs(objects: DataFrame) -> DataFrame:
    """Configured variables and meters of each model with their frequency."""
    from .model_objects import objects_of

    v = objects_of(objects, ["Output:Variable", *METER_TYPES], ["Key_Value", "Key_Name", "Variable_Name", "Reporting_Frequency"])
    name = F.coalesce("Variable_Name", "Key_Name", F.lit("Unknown"))
    return v.select("model", "obj_type", "obj_idx", F.coalesce("Key_Value", F.lit("*")).alias("key"), name.alias("name"), F.coalesce("Reporting_Frequency", F.lit("Unknown")).alias("frequency"))


def append_outputs(configured: DataFrame, added: DataFrame) -> DataFrame:
    """New outputs after the last object of their model."""
    last = configured.groupBy("model").agg(F.max("obj_idx").alias("__top"))
    keyed = ordered.position(added.withColumn("__h", F.xxhash64("key", "name", "frequency")), ["model"], "__h", "__i", ties=["name", "frequency", "key"], width=1 << 60)
    new = keyed.join(last, "model", "left").withColumn("obj_idx", F.coalesce("__top", F.lit(-1)) + F.col("__i"))
    return configured.unionByName(new.select(*configured.columns))


def add_outputs(requests: DataFrame, catalog: DataFrame, existing: DataFrame, keys: list[str], level: str = "moderate", allow: bool = False, meters: bool = False) -> DataFrame:
    """Validation, duplicate check and addition in one flow: each request with its outcome."""
    v = validate_requests(requests, catalog, level, meters)
    ok = v.filter("verdict = 'valid'")
    s = split_duplicates(ok, existing, keys, allow)
    outcome = lambda df, name: df.withColumn("outcome", F.lit(name))
    dup = outcome(s.duplicates, "duplicate_added" if allow else "duplicate")
    new = split_duplicates(ok, existing, keys).added if allow else s.added
    return outcome(v.filter("verdict = 'invalid'"), "invalid").unionByName(dup).unionByName(outcome(new, "added"))


def add_report(outcomes: DataFrame, by: list[str]) -> DataFrame:
    n = lambda c: F.count_if(c)
    o = F.col("outcome")
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("requested"),
        n(F.col("verdict") == "valid").alias("valid"),
        n(o == "invalid").alias("invalid"),
        n(F.col("warning").isNotNull()).alias("warnings"),
        n(o.startswith("duplicate")).alias("duplicates"),
        n(o.isin("added", "duplicate_added")).alias("added"),
    )


def fuzzy_files(files: DataFrame, col: str, name: str, cut: float = 0.3, k: int = 10) -> DataFrame:
    """Files whose lower-cased name is similar to ``name``: one scan and a distributed top k."""
    r = edit_ratio(F.lower(F.col(col)), F.lit(name.lower()))
    return files.select(F.col(col), F.round(r, 6).alias("similarity")).filter(r > cut).orderBy(F.col("similarity").desc(), col).limit(k)


def find_by_words(files: DataFrame, col: str, text: str) -> DataFrame:
    """Name contains the text or all of its words; shortest first by ``rank_length``."""
    low = F.lower(F.col(col))
    words = F.lit(True)
    for w in text.lower().split():
        words = words & low.contains(w)
    return files.filter(low.contains(text.lower()) | words).withColumn("rank_length", F.length(col)).orderBy("rank_length", col)
