"""C1-C17 and C26: chunking, pages, context, tables in text."""

from pyspark.sql import functions as F

from ..operators import documents as D
from .registry import query


def with_tables(t):
    """Documents with a pipe table after their first line and one at the end."""
    k = F.col("doc_id").cast("string")
    first, rest = F.substring_index("text", "\n", 1), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 1)")
    one = F.concat(F.lit("\nsee | a | b |\n| --- | --- |\n| "), k, F.lit(" | "), F.col("lang"), F.lit(" |\n"))
    two = F.concat(F.lit("\n| c | d |\n| "), F.col("n_chars").cast("string"), F.lit(" | x |\n"))
    clean = lambda c: F.replace(c, F.lit("|"), F.lit("/"))
    return t.documents.select("doc_id", F.concat(clean(first), one, clean(rest), two).alias("text"))


TABLES = """
with d as (select doc_id, lang, n_chars, replace(split_part(text, chr(10), 1), '|', '/') as first, replace(substring(text, length(split_part(text, chr(10), 1)) + 1), '|', '/') as rest from documents),
g as (select doc_id, first || chr(10) || 'see <table id=''0''>' || chr(10) || rest || chr(10) || '<table id=''1''>' || chr(10) as tagged,
  '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | ' || lang || ' |' || chr(10) as t0, '| c | d |' || chr(10) || '| ' || n_chars || ' | x |' || chr(10) as t1,
  first || chr(10) || 'see | a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | ' || lang || ' |' || chr(10) || rest || chr(10) || '| c | d |' || chr(10) || '| ' || n_chars || ' | x |' || chr(10) as text from d)
"""


@query("c01_tag_tables", TABLES + "select doc_id, md5(tagged) as tagged, t0, t1, cast(2 as int) as n from g")
def _(t):
    g = D.tag_tables(with_tables(t))
    return g.select("doc_id", F.md5("tagged").alias("tagged"), F.col("tables")[0]["table_text"].alias("t0"), F.col("tables")[1]["table_text"].alias("t1"), F.size("tables").alias("n"))


LINES = """
with l as (select doc_id, string_split(text, chr(10)) as ls from documents), r as (select doc_id, ls, len(ls) as n, case when doc_id % 3 = 0 then 'see' end as notes from l)
"""


@query("c02_tag_line_ranges", LINES + """
select doc_id, md5(case when n >= 4 then array_to_string(list_concat(list_concat(list_concat(ls[1:1], ['<table id=''1''>']), ls[4:n-1]), ['<table id=''2''>']), chr(10)) else array_to_string(ls, chr(10)) end) as tagged,
  case when n >= 4 then md5(case when notes is not null then 'Table 2 NOTE: see' || chr(10) || chr(10) || array_to_string(ls[2:3], chr(10)) || chr(10) || chr(10) else array_to_string(ls[2:3], chr(10)) end) end as t1,
  case when n >= 4 then md5(ls[n]) end as t2 from r""")
def _(t):
    d = t.documents.select("doc_id", "text")
    n = F.size(F.split("text", "\n", -1))
    spec = lambda i, a, b, notes: F.struct(F.lit(i).alias("idx"), a.cast("int").alias("first"), b.cast("int").alias("last"), notes.cast("string").alias("notes"))
    none = F.lit(None)
    r = d.filter(n >= 4).select("doc_id", F.inline(F.array(spec(0, F.lit(1), none, none), spec(1, F.lit(1), F.lit(2), F.when(F.col("doc_id") % 3 == 0, "see")), spec(2, n - 1, n - 1, none))))
    g = D.tag_line_ranges(d, r)
    pick = lambda i: F.md5(F.get(F.filter("tables", lambda x: x["table_idx"] == i), F.lit(0))["table_text"])
    return g.select("doc_id", F.md5("tagged").alias("tagged"), pick(1).alias("t1"), pick(2).alias("t2"))


@query("c03_clean_table_ranges", """
with recursive s as (select l_orderkey, cast(l_quantity as bigint) - 3 as first, cast(l_quantity as bigint) + l_linenumber * 3 as last, row_number() over (partition by l_orderkey order by l_quantity, l_linenumber, l_partkey, l_suppkey) as i from lineitem where cast(l_quantity as bigint) - 3 >= 1),
v as (select l_orderkey, first, last, row_number() over (partition by l_orderkey order by i) as i from s),
f as (select l_orderkey, i, first, last, true as keep, last - 1 as kept_end from v where i = 1
  union all select v.l_orderkey, v.i, v.first, v.last, f.kept_end <= v.first, case when f.kept_end <= v.first then v.last - 1 else f.kept_end end from f join v on v.l_orderkey = f.l_orderkey and v.i = f.i + 1)
select l_orderkey, first - 1 as first, last - 1 as last from f where keep""")
def _(t):
    q = F.col("l_quantity").cast("bigint")
    spec = F.struct("l_quantity", "l_linenumber", "l_partkey", "l_suppkey", (q - 3).alias("first"), (q + F.col("l_linenumber") * 3).alias("last"))
    s = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(spec)).alias("ranges"))
    return D.clean_table_ranges(s).select("l_orderkey", F.inline("ranges"))


@query("c04_untag", TABLES + "select doc_id, md5(text) as content, true as restored from g")
def _(t):
    g = D.tag_tables(with_tables(t)).withColumn("text", F.md5("text"))
    g = g.withColumn("tables", F.transform("tables", lambda x: F.struct(F.concat(x["tag"], F.lit("\n")).alias("tag"), x["table_text"].alias("table_text"))))
    u = D.untag(g, "tagged")
    return u.select("doc_id", F.md5("tagged").alias("content"), (F.md5("tagged") == F.col("text")).alias("restored"))


HEADERS = """
with d as (select doc_id, lang, source, text, split_part(text, chr(10), 1) as first, substring(text, length(split_part(text, chr(10), 1)) + 1) as rest from documents)
"""


def with_headers(t):
    first, rest = F.substring_index("text", "\n", 1), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 1)")
    mark = lambda h, c: F.concat(F.lit(h + " "), c, F.lit("\n"))
    clean = lambda c: F.replace(c, F.lit("#"), F.lit("+"))
    return t.documents.select(
        "doc_id",
        F.concat(F.lit("intro\n"), mark("#", F.col("lang")), F.lit("top\n"), mark("##", F.col("source")), clean(first), F.lit("\n"), mark("###", F.lit("deep")), F.lit("x\n"), mark("##", F.lit("next")), F.lit("y\n"), mark("#", F.lit("last")), F.lit("z"), clean(rest)).alias("text"),
    )


@query("c05_split_headers", HEADERS + """
select doc_id, cast(s as int) as section, md5(case s when 0 then 'intro' when 1 then '# ' || lang || chr(10) || 'top' when 2 then '## ' || source || chr(10) || replace(first, '#', '+')
    when 3 then '### deep' || chr(10) || 'x' when 4 then '## next' || chr(10) || 'y' else '# last' || chr(10) || 'z' || replace(rest, '#', '+') end) as content,
  case s when 0 then null when 5 then 'last' else lang end as h1, case when s in (2, 3) then source when s = 4 then 'next' end as h2, case s when 3 then 'deep' end as h3
from d, range(0, 6) x(s)""")
def _(t):
    s = D.split_headers(with_headers(t))
    h = lambda k: F.try_element_at("metadata", F.lit(f"Header {k}"))
    return s.select("doc_id", "section", F.md5("content").alias("content"), h(1).alias("h1"), h(2).alias("h2"), h(3).alias("h3"))


@query("c06_split_recursive", """
with recursive p as (select doc_id, unnest(ps) as t, generate_subscripts(ps, 1) as i, len(ps) as n from (
    select doc_id, list_filter(string_split(replace(text, '.' || chr(10), chr(1) || '.' || chr(10)), chr(1)), lambda x: x <> '') as ps from documents where length(text) >= 600)),
q as (select *, length(t) as len from p),
f as (select doc_id, i, len, n, cast(0 as bigint) as chunk, cast(len as bigint) as total from q where i = 1
  union all select q.doc_id, q.i, q.len, q.n, case when f.len < 600 and q.len < 600 and f.total + q.len <= 600 then f.chunk else f.chunk + 1 end,
    case when f.len < 600 and q.len < 600 and f.total + q.len <= 600 then f.total + q.len else q.len end from f join q on q.doc_id = f.doc_id and q.i = f.i + 1),
c as (select doc_id, chunk, string_agg(t, '' order by i) as s, max(q.len) as longest from f join q using (doc_id, i) group by doc_id, chunk),
w as (select doc_id, chunk, case when longest >= 600 then s else regexp_replace(s, '^\\s+|\\s+$', '', 'g') end as s from c union all select doc_id, 0, regexp_replace(text, '^\\s+|\\s+$', '', 'g') from documents where length(text) < 600)
select doc_id, cast(row_number() over (partition by doc_id order by chunk) - 1 as int) as chunk_id, md5(s) as content, cast(length(s) as int) as size from w where s <> ''""")
def _(t):
    c = D.split_recursive(t.documents.select("doc_id", "text"), "text", 600)
    return c.select("doc_id", "chunk_id", F.md5("content").alias("content"), F.length("content").alias("size"))


def line_chunks(t):
    head = F.when(F.col("i") % 3 == 0, F.create_map(F.lit("Header 1"), F.array(F.concat(F.lit("L"), F.col("i").cast("string"))))).otherwise(F.create_map().cast("map<string,array<string>>"))
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "content")).select("doc_id", F.col("i").alias("chunk_id"), "content", head.alias("metadata"))


@query("c07_merge_adjacent", """
with recursive q as (select doc_id, unnest(ps) as t, generate_subscripts(ps, 1) - 1 as i from (select doc_id, string_split(text, chr(10)) as ps from documents)),
f as (select doc_id, i, cast(0 as bigint) as chunk, cast(length(t) as bigint) as total from q where i = 0
  union all select q.doc_id, q.i, case when f.total + length(q.t) <= 500 then f.chunk else f.chunk + 1 end, case when f.total + length(q.t) <= 500 then f.total + 2 + length(q.t) else length(q.t) end
    from f join q on q.doc_id = f.doc_id and q.i = f.i + 1)
select doc_id, cast(chunk as int) as chunk_id, md5(string_agg(t, chr(10) || chr(10) order by i)) as content, string_agg('L' || i, '>' order by i) filter (i % 3 = 0) as heads from f join q using (doc_id, i) group by doc_id, chunk""")
def _(t):
    m = D.merge_adjacent(line_chunks(t), 500)
    return m.select("doc_id", "chunk_id", F.md5("content").alias("content"), F.array_join(F.try_element_at("metadata", F.lit("Header 1")), ">").alias("heads"))


@query("c08_breadcrumbs", HEADERS + """
select doc_id, cast(s as int) as section, md5(case s when 0 then chr(10) || '...' || chr(10) || 'intro' when 1 then '# ' || lang || chr(10) || 'top'
    when 2 then '# ' || lang || chr(10) || '...' || chr(10) || '## ' || source || chr(10) || replace(first, '#', '+')
    when 3 then '# ' || lang || chr(10) || '...' || chr(10) || '## ' || source || chr(10) || '...' || chr(10) || '### deep' || chr(10) || 'x'
    when 4 then '# ' || lang || chr(10) || '...' || chr(10) || '## next' || chr(10) || 'y' else '# last' || chr(10) || 'z' || replace(rest, '#', '+') end) as content
from d, range(0, 6) x(s)""")
def _(t):
    s = D.split_headers(with_headers(t)).withColumn("metadata", F.transform_values("metadata", lambda k, v: F.array(v)))
    return D.breadcrumbs(s).select("doc_id", "section", F.md5("content").alias("content"))


@query("c09_paginate", """
select doc_id, cast(p as int) as page, cast(p * 400 as int) as start, md5(substring(text, cast(p * 400 + 1 as int), 400)) as content from (select doc_id, text, unnest(range(0, greatest(1, cast(ceil(length(text) / 400) as bigint)))) as p from documents)""")
def _(t):
    return D.paginate(t.documents.select("doc_id", "text"), "text", 100).withColumn("content", F.md5("content"))


@query("c10_number_lines", """
with l as (select doc_id, case when text like '%' || chr(10) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end as ls, text like '%' || chr(10) as tail from documents)
select doc_id, md5(array_to_string(list_transform(ls, lambda s, i: case when rtrim(s) = '' then i || s else i || ' ' || s end), chr(10)) || case when tail then chr(10) else '' end) as numbered from l""")
def _(t):
    return t.documents.select("doc_id", F.md5(D.number_lines(F.col("text"))).alias("numbered"))


@query("c11_doc_title", """
select doc_id, case when doc_id % 2 = 0 then lang || ' ' || source else 'doc' || doc_id || '.md' end as title from documents""")
def _(t):
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n\n## "), "lang", F.lit(" "), "source", F.lit("\n"))).otherwise("\n\n\n\n\n# late\n")
    return t.documents.select("doc_id", D.doc_title(F.concat(head, "text"), F.concat(F.lit("a/b/doc"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("title"))


@query("c12_with_context", """
with c as (select conv_id, turn, coalesce(lag(text) over w, '') as p, coalesce(lead(text) over w, '') as n from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, md5(case when length(p) > 100 then substring(p, 1, cast(floor(length(p) * 0.5) as int)) else p end) as previous_context, md5(case when length(n) > 100 then substring(n, 1, cast(floor(length(n) * 0.5) as int)) else n end) as next_context from c""")
def _(t):
    c = D.with_context(t.conversations.select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", 200, 0.5)
    return c.select("conv_id", "turn", F.md5("previous_context").alias("previous_context"), F.md5("next_context").alias("next_context"))


@query("c13_running_context", """
with s as (select conv_id, turn, role || ' ' || length(text) as summary from conversations)
select conv_id, turn, string_agg(summary, chr(10)) over (partition by conv_id order by turn rows between unbounded preceding and current row) as forward_context,
  string_agg(summary, chr(10)) over (partition by conv_id order by turn rows between current row and unbounded following) as backward_context from s""")
def _(t):
    c = t.conversations.select("conv_id", "turn", F.concat_ws(" ", "role", F.length("text").cast("string")).alias("summary"))
    return D.running_context(c, ["conv_id"], "turn", "summary")


@query("c16_index_chunks", """
select lang as doc, doc_id // 2 as chunk, lang || '__chunk_' || (doc_id // 2) as id, max(doc_id) as version, cast(arg_max(n_chars, doc_id) as bigint) as n_chars, cast(count(*) over (partition by lang) as bigint) as total from documents group by lang, doc_id // 2""")
def _(t):
    c = t.documents.select(F.col("lang").alias("doc"), F.floor(F.col("doc_id") / 2).alias("chunk"), F.col("doc_id").alias("version"), "n_chars")
    return D.index_chunks(c, "doc", "chunk", "version")


@query("c17_add_missing", """
select doc_id, 'old' as state from documents where doc_id in (select doc_id from labels) union all select doc_id, 'new' from documents where doc_id not in (select doc_id from labels)""")
def _(t):
    return D.add_missing(t.documents.select("doc_id", F.lit("new").alias("state")), t.labels.select("doc_id", F.lit("old").alias("state")), "doc_id")


@query("c26_parse_pipe_table", """
select doc_id, 0 as "row", c as col, case c when 0 then 'a' else 'b' end as header, case c when 0 then cast(doc_id as varchar) else lang end as value from documents, (values (0), (1)) x(c)
union all select doc_id, 1, c, case c when 0 then 'a' else 'b' end, case c when 0 then cast(n_chars as varchar) else '' end from documents, (values (0), (1)) x(c)""")
def _(t):
    table = F.concat(F.lit("| a | b |\n|:---|---:|\n| "), F.col("doc_id").cast("string"), F.lit(" | "), "lang", F.lit(" |\n|"), F.col("n_chars").cast("string"), F.lit("||\n"))
    return D.parse_pipe_table(t.documents.select("doc_id", table.alias("table_text")), "table_text", ["doc_id"])
