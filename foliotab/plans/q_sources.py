"""A: sources and sinks."""

from pyspark.sql import functions as F

from ..functions.text import minutes_of_day
from ..session import scratch_path
from ..sources import model_files as M
from ..sources import readers as S
from ..sources import series, writers
from .registry import query

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


@query("a01_read_dataset", """
select f as format, o_orderstatus, cast(count(*) as bigint) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders, (values ('jsonl'), ('json'), ('csv')) x(f) group by f, o_orderstatus""")
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    out = None
    for fmt in ("jsonl", "json", "csv"):
        path = scratch_path(t.spark, f"orders.{fmt}")
        if fmt == "csv":
            o.write.option("header", True).csv(path)
        elif fmt == "jsonl":
            o.write.json(path)
        else:
            # each file is one JSON list of a bounded number of rows
            rows = o.groupBy(F.floor(F.col("o_orderkey") / 1000)).agg(F.to_json(F.collect_list(F.struct(*o.columns))).alias("value"))
            rows.select("value").write.option("maxRecordsPerFile", 1).text(path)
        d = S.read_dataset(t.spark, path, ORDERS).withColumn("format", F.lit(fmt))
        out = d if out is None else out.unionByName(d)
    return out.groupBy("format", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("a02_read_json_or_lines", "select event_id, user_id, event_type from events")
def _(t):
    path = scratch_path(t.spark, "events")
    t.events.select("event_id", "user_id", "event_type").write.json(path)
    return S.read_json_or_lines(t.spark, path, "event_id bigint, user_id bigint, event_type string")


def event_lines(t):
    """A log per event type; an error's line is cut off in the middle."""
    k = F.col("event_id").cast("string")
    good = F.concat(F.lit('{"event": "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    text = F.when(F.col("event_type") == "error", F.concat(F.lit('{"event": "error", "id": '), k)).otherwise(good)
    return t.events.select(F.col("event_type").alias("file"), F.col("event_id").alias("line"), text.alias("text"))


@query("a03_parse_event_lines", """
select event_type as file, event_id as __line_number, case when event_type = 'error' then 'parse_error' else event_type end as event, case when event_type <> 'error' then cast(props->>'$.k' as bigint) end as k,
  case when event_type = 'error' then 'invalid JSON' end as error_text, case when event_type = 'error' then '{"event": "error", "id": ' || event_id end as raw from events""")
def _(t):
    return S.parse_event_lines(event_lines(t), "event string, k bigint")


@query("a03_read_events_numbered", """
select event_type, cast(count(*) as bigint) as n, cast(sum(line) as bigint) as lines from (select event_type, row_number() over (partition by event_type order by event_id) as line from events) group by event_type""")
def _(t):
    """Written as text and read back: line numbers per file are 1..n of that file, whatever the split."""
    path = scratch_path(t.spark, "log")
    t.events.select("event_type", F.to_json(F.struct(F.col("event_type").alias("event"), "event_id")).alias("value")).write.partitionBy("event_type").text(path)
    r = S.read_events(t.spark, path, "event string, event_id bigint")
    per = r.groupBy("event", "file").agg(F.count("*").alias("n"), F.max("__line_number").alias("top"), F.count_distinct("__line_number").alias("d"))
    ok = per.withColumn("n", F.when((F.col("n") == F.col("top")) & (F.col("n") == F.col("d")), F.col("n")).otherwise(-1))
    g = ok.groupBy(F.col("event").alias("event_type")).agg(F.sum("n").alias("n"))
    return g.withColumn("lines", (F.col("n") * (F.col("n") + 1) / 2).cast("bigint"))


@query("a04_multiline_log", """
select event_type as file, 2 * event_id as start_line, 2 * event_id + 1 as end_line, 'user ' || user_id as level, 'he said ''' || event_type || '''' || chr(10) || 'id ' || event_id as message, cast(null as varchar) as error from events where event_type <> 'error'
union all select event_type, 2 * event_id, 2 * event_id + 1, null, null, 'invalid JSON' from events where event_type = 'error'""")
def _(t):
    k = F.col("event_id")
    bad = F.when(F.col("event_type") == "error", "{").otherwise("")
    one = F.concat(bad, F.lit('{"level": "user '), F.col("user_id").cast("string"), F.lit('", "message": "he said "'), "event_type", F.lit('"'))
    two = F.concat(F.lit("id "), k.cast("string"), F.lit('"}'))
    lines = t.events.select(F.col("event_type").alias("file"), F.inline(F.array(F.struct((k * 2).alias("line"), one.alias("text")), F.struct((k * 2 + 1).alias("line"), two.alias("text")))))
    rows, errors = S.parse_multiline_log(lines, "level string, message string")
    return rows.unionByName(errors.drop("preview"), allowMissingColumns=True)


@query("a05_read_results", """
select turn as run, conv_id as question_id, role as gold, case when turn % 3 <> 1 then 'm' || turn end as level from conversations""")
def _(t):
    r = F.to_json(F.struct(F.col("conv_id").alias("question_id"), F.col("role").alias("gold"), "turn"))
    m = F.to_json(F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("level")))
    wrap = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    text = F.when(F.col("turn") % 3 == 0, wrap("[[", r, "],[", m, "]]")).when(F.col("turn") % 3 == 1, wrap("[", r, "]")).otherwise(wrap('{"results":[', r, '],"all_metadata":[', m, "]}"))
    files = t.conversations.select(F.col("turn").alias("file"), text.alias("text"))
    out = S.parse_results(files, "struct<question_id: bigint, gold: string, turn: bigint>", "struct<level: string>")
    return out.select(F.col("file").alias("run"), "question_id", "gold", F.col("metadata.level").alias("level"))


@query("a06_read_documents", """
select lang, cast(sum(len(string_split(text, chr(10)))) as bigint) as lines, cast(sum(length(text) + 1) as bigint) as chars from documents group by lang""")
def _(t):
    path = scratch_path(t.spark, "docs")
    t.documents.select("lang", F.col("text").alias("value")).write.option("maxRecordsPerFile", 500).partitionBy("lang").text(path)
    d = S.read_documents(t.spark, path)
    lang = F.regexp_extract("file_path", "lang=([^/]+)/", 1)
    return d.groupBy(lang.alias("lang")).agg(F.sum(F.size(F.split("content", "\n", -1)) - 1).alias("lines"), F.sum(F.length("content")).cast("bigint").alias("chars"))


@query("a07_explode_document_map", """
select doc_id, 'a' as document_name, md5(case when doc_id % 2 = 0 then text else text || lang end) as content from documents
union all select doc_id, 'b', md5(source) from documents""")
def _(t):
    d = t.documents.withColumn("none", F.lit(None).cast("string"))
    doc = lambda c, r: F.struct(F.col(c).alias("content"), F.col(r).alias("result"))
    text = F.to_json(F.create_map(F.lit("a"), doc("text", "lang"), F.lit("b"), doc("source", "none")))
    e = S.explode_document_map(d.select("doc_id", text.alias("json")), "json", ["doc_id"], F.col("doc_id") % 2 == 0)
    return e.withColumn("content", F.md5("content"))


@query("a08_resolve_documents", """
with f as (select case when doc_id % 5 = 0 then 'x-' else '2024-' end || lang || '_' || doc_id || case when doc_id % 7 = 0 then '.md' else '_rep.txt' end as file from documents), q as (select item_id as question_id, unnest(['en_' || item_id, 'fr_' || (item_id * 3), 'none' || item_id]) as wanted from benchmark),
h as (select wanted, min(file) as file from q join f on contains(file, wanted) and file like '%.txt' group by wanted)
select question_id, wanted, file, case when file is null then 'no file for ' || wanted end as error from q left join h using (wanted)""")
def _(t):
    k = F.col("doc_id").cast("string")
    name = F.concat(F.when(F.col("doc_id") % 5 == 0, "x-").otherwise("2024-"), "lang", F.lit("_"), k, F.when(F.col("doc_id") % 7 == 0, ".md").otherwise("_rep.txt"))
    i = F.col("item_id")
    q = t.benchmark.select(i.alias("question_id"), F.array(F.concat(F.lit("en_"), i.cast("string")), F.concat(F.lit("fr_"), (i * 3).cast("string")), F.concat(F.lit("none"), i.cast("string"))).alias("doc"))
    found, missing = S.resolve_documents(q, t.documents.select(name.alias("name")))
    return found.unionByName(missing, allowMissingColumns=True)


@query("a09_backfill_ids", """
select event_id, case when event_type = 'view' then event_type || event_id else cast(row_number() over (order by event_id) - 1 as varchar) end as id from events""")
def _(t):
    e = t.events.select("event_id", F.when(F.col("event_type") == "view", F.concat("event_type", F.col("event_id").cast("string"))).alias("id"))
    return S.backfill_ids(e, "id", ["event_id"])


@query("a10_inline_documents", """
select conv_id * 1000 + turn as key, 0 as pos, 'role' as name, md5(role) as text, null as error from conversations where turn % 4 = 0
union all select conv_id * 1000 + turn, p, case p when 0 then 'n' else 'document_2' end, md5(case p when 0 then text else role end), null from conversations, (values (0), (1)) x(p) where turn % 4 = 1
union all select conv_id * 1000 + turn, 0, 'context', md5(text), null from conversations where turn % 4 = 2
union all select conv_id * 1000 + turn, null, null, null, 'no documents' from conversations where turn % 4 = 3""")
def _(t):
    m = F.col("turn") % 4
    docs = F.when(m == 0, F.to_json(F.struct("role"))).when(m == 1, F.concat(F.lit("["), F.to_json(F.struct(F.lit("n").alias("name"), "text")), F.lit(',"'), "role", F.lit('"]')))
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), docs.alias("documents"), F.when(m == 2, F.col("text")).alias("context"))
    out, errors = S.inline_documents(rows, "key")
    return out.withColumn("text", F.md5("text")).unionByName(errors, allowMissingColumns=True)


def model_lines(t):
    """A part is three lines of a model file; brands are the files."""
    k = F.col("p_partkey")
    a = F.concat(F.lit("Material, ! "), "p_type")
    b = F.concat(F.lit("  "), "p_name", F.lit(",   !- Name"))
    c = F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit(", , "), k.cast("string"), F.lit(";  !- Thermal Conductivity {W/m-K}"))
    rows = F.array(*[F.struct((k * 3 + i).alias("line"), x.alias("text")) for i, x in enumerate((a, b, c))])
    return t.part.select(F.col("p_brand").alias("model"), F.inline(rows))


@query("a11_model_objects", """
select p_brand as model, 'Material' as obj_type, dense_rank() over (partition by p_brand order by p_partkey) - 1 as obj_idx, cast(i as int) as field_idx, ['Name', 'Field_2', 'Field_3', 'Thermal_Conductivity'][i + 1] as field_name,
  [p_name, cast(p_size as varchar), '', cast(p_partkey as varchar)][i + 1] as value from part, range(0, 4) r(i)""")
def _(t):
    return M.parse_model_lines(model_lines(t))


def dictionary(t, objects, csv):
    k = F.col("p_size") % 10
    name = F.concat("p_name", F.lit(":"), "p_type")
    line = F.when(F.col("p_brand") < "Brand#2", objects(name, k)).otherwise(csv(name, k))
    head = t.part.select(F.col("p_brand").alias("file")).distinct().select("file", F.lit(-1).cast("bigint").alias("line"), F.lit("Var Type (reported time step),Var Report Type,Variable Name [Units]").alias("text"))
    return t.part.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), line.alias("text")).union(head)


@query("a12_meter_dictionary", """
with p as (select p_brand as file, p_partkey as line, p_name || ':' || p_type as name, p_size % 10 as k from part),
r as (select *, case when file < 'Brand#2' then 'J' || k else 'kJ' || k end as unit, case when file < 'Brand#2' then 'daily' else 'hourly' end as frequency from p where (file < 'Brand#2' and k <> 3) or (file >= 'Brand#2' and k <> 4))
select file, name, arg_min(unit, line) as unit, 'Zone' as var_type, any_value(frequency) as frequency, case when contains(lower(name), 'net') then 'ElectricityNet' else 'Other' end as resource_type from r group by file, name""")
def _(t):
    o = lambda n, k: F.concat(F.when(k == 3, "Output:Meter:Cumulative,").otherwise("Output:Meter,"), n, F.lit(",daily; !- [J"), k.cast("string"), F.lit("]"))
    c = lambda n, k: F.concat(F.lit("Zone,"), F.when(k == 4, "Average,").otherwise("Meter,"), n, F.lit(" [kJ"), k.cast("string"), F.lit("]"))
    return M.parse_meter_dictionary(dictionary(t, o, c))


@query("a13_variable_dictionary", """
with p as (select p_brand as file, p_partkey as line, p_name || ':' || p_type as name, p_size % 10 as k from part)
select file, name, arg_min(case when file < 'Brand#2' then 'C' || k else 'K' || k end, line) as unit, case when file < 'Brand#2' then 'Zone' else 'HVAC' end as var_type, case when file < 'Brand#2' then 'daily' else 'hourly' end as frequency
from p where file < 'Brand#2' or k <> 4 group by file, name""")
def _(t):
    o = lambda n, k: F.concat(F.lit("Output:Variable,*,"), n, F.lit(",daily; !- Zone Average [C"), k.cast("string"), F.lit("]"))
    c = lambda n, k: F.concat(F.lit("HVAC,"), F.when(k == 4, "Meter,").otherwise("Average,"), n, F.lit(" [K"), k.cast("string"), F.lit("]"))
    return M.parse_variable_dictionary(dictionary(t, o, c))


@query("a14_parse_time", """
select l_orderkey, l_linenumber, l_partkey, case l_linenumber % 4 when 0 then strftime(make_timestamp(2000, month(l_shipdate), day(l_shipdate), 0, 0, 0) + interval 1 day, '%Y-%m-%d %H:%M:%S')
  when 1 then strftime(make_timestamp(2000, month(l_shipdate), day(l_shipdate), l_linenumber, 30, 0), '%Y-%m-%d %H:%M:%S') when 2 then '2000-' || lpad(cast(month(l_shipdate) as varchar), 2, '0') || '-01 00:00:00' end as time from lineitem""")
def _(t):
    d = F.date_format("l_shipdate", "MM/dd")
    n = F.col("l_linenumber")
    text = F.when(n % 4 == 0, F.concat(d, F.lit("  24:00:00"))).when(n % 4 == 1, F.concat(F.lit(" "), d, F.lit("  0"), n.cast("string"), F.lit(":30:00"))).when(n % 4 == 2, F.date_format("l_shipdate", "MMMM")).otherwise("Coinc Peak")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.date_format(series.parse_time(text), "yyyy-MM-dd HH:mm:ss").alias("time"))


@query("a14_read_series", """
with o as (select o_orderkey as k, o_custkey as c, o_totalprice as p, o_custkey % 32 as part, row_number() over (partition by o_orderkey % 2, o_custkey % 32 order by o_orderkey) - 1 as row from orders),
r as (select k % 2 as kind, part, row, k, c, p from o)
select kind, part, row, 'North, upper:Load' as series, 'W' as unit, c::double as value from r where kind = 0
union all select kind, part, row, 'Cost', 'EUR', p from r union all select kind, part, row, 'Key', '', k::double from r where kind = 1""")
def _(t):
    """Files of two kinds with different columns, 32 of each; one header cell is quoted and holds a comma, some cells are quoted."""
    path = scratch_path(t.spark, "series")
    kind, part = (F.col("o_orderkey") % 2).alias("kind"), (F.col("o_custkey") % 32).alias("part")
    price = F.col("o_totalprice").cast("string")
    zone = F.concat(F.lit("01/02 03:00:00,"), F.lit('"'), F.col("o_custkey").cast("string"), F.lit('",'), price)
    key = F.concat(price, F.lit(",01/02 03:00:00,"), F.col("o_orderkey").cast("string"))
    body = t.orders.select(kind, part, F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, zone).otherwise(key).alias("value"))
    head = F.when(F.col("kind") == 0, 'Time,"North, upper:Load [W](Hourly)",Cost [EUR]').otherwise("Cost [EUR],Date/Time,Key")
    heads = body.select("kind", "part").distinct().select("kind", "part", F.lit(-1).cast("long").alias("k"), head.alias("value"))
    files = body.unionByName(heads).repartition("kind", "part").sortWithinPartitions("kind", "part", "k")
    files.select("kind", "part", "value").write.partitionBy("kind", "part").text(path)
    s = series.read_series(t.spark, f"{path}/*/*")
    number = lambda name: F.regexp_extract("file", f"/{name}=([0-9]+)/", 1).cast("bigint").alias(name)
    return s.select(number("kind"), number("part"), "row", "series", "unit", "value")


@query("a14_minutes_of_day", """
select event_id, case when h < 24 or (h = 24 and m = 0) then cast(h * 60 + m as int) end as minute from (select event_id, event_id % 26 as h, event_id % 60 as m from events)""")
def _(t):
    h, m = F.col("event_id") % 26, F.col("event_id") % 60
    return t.events.select("event_id", minutes_of_day(F.concat(h.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"))).alias("minute"))


@query("a15_classify_outputs", """
with f as (select page_id, 'out' || page_id || ['Table.html', '.csv', '.err', '.zip', 'Summary.csv', '.ERR'][page_id % 6 + 1] as name, length(html) as size from pages)
select case when name like '%Table.html' or name like '%Summary.csv' then 'summary_reports' when name like '%.csv' then 'time_series_outputs' when name like '%.err' then 'error_files' else 'other_files' end as category,
  '.' || lower(split_part(name, '.', 2)) as extension, cast(count(*) as bigint) as files, cast(sum(size) as bigint) as bytes from f group by 1, 2""")
def _(t):
    ext = F.get(F.array(*[F.lit(x) for x in ("Table.html", ".csv", ".err", ".zip", "Summary.csv", ".ERR")]), (F.col("page_id") % 6).cast("int"))
    f = t.pages.select(F.concat(F.lit("out"), F.col("page_id").cast("string"), ext).alias("name"), F.length("html").alias("size"))
    return S.classify_outputs(f).groupBy("category", "extension").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("a15_list_files", "select o_orderstatus as folder, true as sized from orders group by o_orderstatus")
def _(t):
    path = scratch_path(t.spark, "files")
    t.orders.select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    f = S.list_files(t.spark, path).filter(F.col("name").endswith(".parquet"))
    return f.groupBy(F.regexp_extract("path", "o_orderstatus=([^/]+)/", 1).alias("folder")).agg((F.min("size_bytes") > 0).alias("sized"))


@query("a16_tail", """
select 'all' as kind, event_id, event_type, (select cast(count(*) as bigint) from events) as total, cast(50 as bigint) as shown from (select * from events order by event_id desc limit 50)
union all select 'errors', event_id, event_type, (select cast(count(*) as bigint) from events where event_type = 'error'), cast(50 as bigint) from (select * from events where event_type = 'error' order by event_id desc limit 50)""")
def _(t):
    e = t.events.select("event_id", "event_type")
    return S.tail(e, "event_id", 50).withColumn("kind", F.lit("all")).unionByName(S.tail(e, "event_id", 50, F.col("event_type") == "error").withColumn("kind", F.lit("errors")))


@query("a17_write_results", "select o_orderstatus as experiment_id, cast(count(*) as bigint) as n, cast(sum(o_custkey) as bigint) as keys from orders group by o_orderstatus")
def _(t):
    path = scratch_path(t.spark, "results")
    writers.write_results(t.orders.select(F.col("o_orderstatus").alias("experiment_id"), "o_orderkey", "o_custkey"), path)
    r = t.spark.read.schema("o_orderkey bigint, o_custkey bigint, experiment_id string").json(path)
    return r.groupBy("experiment_id").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@query("a18_append_events", "select event_type, cast(count(*) as bigint) as n, cast(sum(event_id) as bigint) as ids from events group by event_type")
def _(t):
    path = scratch_path(t.spark, "appended")
    e = t.events.select("event_id", "event_type")
    writers.append_events(e.filter("event_type in ('view', 'click')"), path)
    writers.append_events(e.filter("event_type not in ('view', 'click')"), path)
    r = t.spark.read.schema("event_id bigint, event_type string").json(path)
    return r.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
