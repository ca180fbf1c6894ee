"""C14, C15, C18-C25: vectors, tokens, sentences, quotes."""

from pyspark.sql import functions as F

from ..functions.text import norm_token
from ..operators import alignment as A
from ..operators import vectors as V
from .registry import query

WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PIECES = rf"""
with raw as (select doc_id, lang, text, regexp_extract_all(text, '[A-Za-z0-9]+(?:/[A-Za-z0-9]+)+|[A-Za-z]+|[0-9]+|{WS}+|[^A-Za-z0-9{WS[1:-1]}]+') as ps from documents),
pieces as (select doc_id, unnest(ps) as t, generate_subscripts(ps, 1) as i from raw),
offs as (select doc_id, i, t, cast(coalesce(sum(length(t)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as int) as start,
  regexp_matches(t, '^{WS}') as gap, lag(t) over (partition by doc_id order by i) as before from pieces),
toks as (select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as idx, t as token, start, cast(start + length(t) as int) as "end",
  case when regexp_full_match(t, '[0-9]+') then 'NUMBER' when contains(t, '/') and regexp_full_match(t, '[A-Za-z0-9]+(?:/[A-Za-z0-9]+)+') then 'ACRONYM' when regexp_full_match(t, '[A-Za-z]+') then 'WORD' else 'PUNCTUATION' end as type,
  coalesce(regexp_matches(before, '[\n\r]') and regexp_matches(before, '^{WS}'), false) and row_number() over (partition by doc_id order by i) > 1 as after_newline, coalesce(contains(before, chr(10)), false) as feed from offs where not gap)
"""


def toks(t):
    return A.tokenize(t.documents, "text", ["doc_id"])


@query("c19_tokenize", PIECES + 'select doc_id, idx, md5(token) as token, type, start, "end", after_newline from toks')
def _(t):
    return toks(t).select("doc_id", "idx", F.md5("token").alias("token"), "type", "start", "end", "after_newline")


SENT = PIECES + """
, f as (select *, lag(token) over w as prev, lead(token) over w as next, lead(feed) over w as next_nl from toks window w as (partition by doc_id order by idx)),
e as (select *, (type = 'PUNCTUATION' and regexp_matches(token, '[.?!]$') and not coalesce(prev || token in ('Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.', 'St.'), false)) or coalesce(next_nl and regexp_matches(next, '^\\p{Lu}'), false) as is_end from f),
s as (select *, coalesce(sum(case when is_end then 1 else 0 end) over (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), 0) as sentence from e),
g as (select doc_id, cast(sentence as int) as sentence, min(idx) as first, max(idx) + 1 as last, min(start) as a, max("end") as b from s group by doc_id, sentence)
"""


@query("c20_sentences", SENT + 'select doc_id, sentence, first, cast(last as int) as last from g')
def _(t):
    return A.text_sentences(t.documents, "text", ["doc_id"]).select("doc_id", "sentence", "first", "last")


@query("c21_span_text", SENT + """
select doc_id, sentence, md5(substring(text, a + 1, b - a)) as span, md5(substring(text, a + 1, b - a)) as sentence_text, cast(null as varchar) as invalid from g join documents using (doc_id)""")
def _(t):
    s = A.text_sentences(t.documents, "text", ["doc_id"]).select("doc_id", "sentence", "first", "last", "text")
    turned = s.select("doc_id", "sentence", F.col("last").alias("first"), F.col("first").alias("last"), F.lit(None).cast("string").alias("text"))
    spans = A.span_text(s.withColumn("valid", F.lit(True)).unionByName(turned.withColumn("valid", F.lit(False))), None, t.documents)
    both = spans.groupBy("doc_id", "sentence").agg(F.max(F.when(F.col("valid"), F.md5("span"))).alias("span"), F.max(F.md5("text")).alias("sentence_text"), F.max(F.when(~F.col("valid"), F.col("span"))).alias("invalid"))
    return both


@query("c22_norm_token", PIECES + """
select stem, cast(count(*) as bigint) as n, cast(count(distinct doc_id) as bigint) as documents from (
  select doc_id, case when length(token) > 3 and lower(token) like '%s' and lower(token) not like '%ss' then lower(token)[1:length(token) - 1] else lower(token) end as stem from toks where type <> 'PUNCTUATION') group by stem""")
def _(t):
    d = toks(t).where("type <> 'PUNCTUATION'").select("doc_id", norm_token(F.col("token")).alias("stem"))
    return d.groupBy("stem").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def quotes(t):
    """Each document quotes all its sentences: in capitals, or spoilt by a foreign word in front, inside or behind."""
    s = A.text_sentences(t.documents, "text", ["doc_id"])
    capitals = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    where = F.col("sentence") % 3
    inside = (where == 2) & F.col("text").rlike(r"^\S+\s")
    spoilt = F.when(inside, F.regexp_replace("text", r"^(\S+)\s", "$1 Zzyzx ")).when(where == 1, F.concat("text", F.lit(" Zzyzx"))).otherwise(F.concat(F.lit("Zzyzx "), "text"))
    return s.select("doc_id", F.col("sentence").alias("quote_id"), F.when(F.col("doc_id") % 2 == 0, capitals).otherwise(spoilt).alias("quote"))


@query("c23_align_exact", SENT + """
, low as (select doc_id, idx, lower(token) as w, start, "end" from toks),
src as (select doc_id, chr(31) || string_agg(w, chr(31) order by idx) || chr(31) as s from low group by doc_id),
qt as (select g.doc_id, g.sentence, last - first as n, chr(31) || string_agg(w, chr(31) order by idx) || chr(31) as q from g join low on low.doc_id = g.doc_id and idx >= first and idx < last where g.doc_id % 2 = 0 group by g.doc_id, g.sentence, n),
hit as (select doc_id, sentence, n, length(left(s, instr(s, q))) - length(replace(left(s, instr(s, q)), chr(31), '')) - 1 as i from qt join src using (doc_id) where instr(s, q) > 0)
select g.doc_id, g.sentence as quote_id, cast(i as int) as first_token, cast(i + n as int) as last_token, a.start as start_pos, z."end" as end_pos, case when i is not null then 'MATCH_EXACT' end as status
from g left join hit using (doc_id, sentence) left join low a on a.doc_id = hit.doc_id and a.idx = i left join low z on z.doc_id = hit.doc_id and z.idx = i + n - 1""")
def _(t):
    a = A.align_exact(quotes(t), t.documents)
    return a.select("doc_id", "quote_id", "first_token", "last_token", "start_pos", "end_pos", "status")


@query("c24_align_fuzzy")
def _(t):
    a = A.align_fuzzy(quotes(t), t.documents)
    return a.withColumn("quote", F.md5("quote")).withColumn("span_text", F.md5("span_text"))


@query("c25_annotate_alignment")
def _(t):
    q = quotes(t).withColumn("field", F.concat(F.lit("f"), F.col("quote_id") % 7))
    cells = q.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list("quote")).alias("quote"))
    a = A.annotate_alignment(cells, t.documents)
    return a.withColumn("quote", F.md5("quote")).withColumn("span_text", F.md5("span_text"))


SIM = "round(list_cosine_similarity(cast({a}.embedding as double[]), cast({b}.embedding as double[])), 9)"


@query("c18_knn", f"""
with s as (select a.vec_id as query_id, b.vec_id, {SIM.format(a='a', b='b')} as similarity from embeddings a, embeddings b),
k as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as k from s)
select query_id, vec_id, round(similarity, 6) as similarity, cast(k as int) as rank from k where k <= 8""")
def _(t):
    x = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return V.knn(x, x, 8).withColumn("similarity", F.round("similarity", 6))


@query("c18_context_text", f"""
with s as (select a.vec_id as query_id, b.vec_id, {SIM.format(a='a', b='b')} as similarity from embeddings a, embeddings b),
k as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as k from s)
select query_id, md5(string_agg('[' || k || '] ' || text, chr(10) || chr(10) order by k)) as context from k join documents on doc_id = vec_id where k <= 4 and text is not null group by query_id""")
def _(t):
    """From ids to neighbours to the text of the documents with the same ids."""
    x = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    texts = t.documents.where("text is not null").select(F.col("doc_id").alias("vec_id"), "text")
    return V.context_text(V.knn(x, x, 4).withColumn("similarity", F.round("similarity", 9)), texts).withColumn("context", F.md5("context"))


GRAPH = f"""
with x as (select label as doc, vec_id as id, embedding from embeddings),
seq as (select doc, id as src, lead(id) over (partition by doc order by id) as dst, 1.0::double as weight, 'sequential' as edge_type from x),
s as (select a.doc, a.id as q, b.id as v, {SIM.format(a='a', b='b')} as sim from x a join x b on a.doc = b.doc and a.id <> b.id),
k as (select *, row_number() over (partition by doc, q order by sim desc, v) as k from s where sim >= 0.3),
e as (select * from seq where dst is not null union all select doc, least(q, v), greatest(q, v), sim, 'semantic' from k where k <= 3),
graph as (select doc, src, dst, arg_max(weight, edge_type) as weight, max(edge_type) as edge_type from e group by doc, src, dst)
"""


def graph(t):
    return V.chunk_graph(t.embeddings.select(F.col("label").alias("doc"), F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 3, 0.3)


@query("c14_chunk_graph", GRAPH + "select doc, src, dst, round(weight, 6) as weight, edge_type from graph")
def _(t):
    return graph(t).withColumn("weight", F.round("weight", 6))


@query("c15_neighbor_context", GRAPH + """
, b as (select doc, src as id, dst as other, weight from graph union all select doc, dst, src, weight from graph),
r as (select *, row_number() over (partition by doc, id order by weight desc, other) as k from b)
select x.doc, x.id, coalesce(string_agg('v' || other, chr(10) order by k) filter (k <= 5 and other < x.id), '') as previous_context, coalesce(string_agg('v' || other, chr(10) order by k) filter (k <= 5 and other > x.id), '') as next_context
from x left join r on r.doc = x.doc and r.id = x.id group by x.doc, x.id""")
def _(t):
    texts = t.embeddings.select(F.col("label").alias("doc"), F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"))
    return V.neighbor_context(graph(t), texts)
