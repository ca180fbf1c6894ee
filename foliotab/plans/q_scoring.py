"""G: evaluation and run analytics."""

from pyspark.sql import functions as F

from ..operators import runs as N
from ..operators import scoring as S
from .registry import query

SCORES = """
with scores as (
  select l.doc_id as question_id, d.lang, d.source, tool, case when tool = 'judge' then quality = 1 end as correct_bool,
    case when tool = 'rubric' then cast(case when quality = 0 and toxic = 0 then 50 else 100 * (1 - toxic) end as double) end as correct_num,
    case when tool = 'rubric' and l.doc_id % 5 = 0 then 'timeout' end as error
  from labels l join documents d on d.doc_id = l.doc_id, (values ('judge'), ('rubric')) t(tool))
"""


def scores(t):
    pairs = F.array(
        F.struct(F.lit("judge").alias("tool"), (F.col("quality") == 1).alias("correct_bool"), F.lit(None).cast("double").alias("correct_num"), F.lit(None).cast("string").alias("error")),
        F.struct(
            F.lit("rubric").alias("tool"),
            F.lit(None).cast("boolean").alias("correct_bool"),
            F.when((F.col("quality") == 0) & (F.col("toxic") == 0), 50.0).otherwise(100.0 * (1 - F.col("toxic"))).alias("correct_num"),
            F.when(F.col("doc_id") % 5 == 0, "timeout").alias("error"),
        ),
    )
    d = t.documents.select("doc_id", "lang", "source")
    return t.labels.join(d, "doc_id").select(F.col("doc_id").alias("question_id"), "lang", "source", F.inline(pairs)).withColumn("explanation", F.lit("because"))


@query("flagship", """
with c as (
  select l.doc_id, d.lang, d.source, case when quality = 1 then 100.0 else 0.0 end as score from documents d join labels l on l.doc_id = d.doc_id
  where length(d.text) > 0)
select lang, cast(count(*) as bigint) as n, round(avg(score), 4) as mean, round(1.96 * stddev_pop(score) / sqrt(count(*)), 4) as half_width,
  round(avg(case when score = 100 then 1.0 else 0.0 end), 4) as perfect, round(1.96 * stddev_pop(case when score = 100 then 1.0 else 0.0 end) / sqrt(count(*)), 4) as perfect_half_width
from c group by lang""")
def _(t):
    """Chunk documents, take the label as a quoted cell of the first chunk, drop the unquoted, keep the best, score."""
    from ..operators import documents as D
    from ..operators import extraction as X
    from ..operators import reconcile as R

    pages = D.paginate(t.documents.select("doc_id", "lang", "text"), "text", page_tokens=4000)
    cells = pages.join(t.labels.select("doc_id", "quality"), "doc_id").select(
        F.lit("quality").alias("table_name"), "doc_id", "lang", F.col("page").alias("chunk_id"), F.lit("quality").alias("field"),
        F.col("quality").cast("string").alias("value"), F.when(F.length("content") > 0, F.array(F.substring("content", 1, 40))).alias("quote"),
    )
    cells = X.unquoted_to_null(cells).filter("value is not null").withColumn("row_id", F.col("chunk_id").cast("bigint"))
    best = R.dedupe_best(cells, ["doc_id", "lang"], "value")
    score = F.when(F.col("value") == "1", 100.0).otherwise(0.0)
    return S.mean_ci(best, ["lang"], score)


@query("g01_flatten_scores", SCORES + """
select question_id, tool, case when error is null then correct_bool end as correct_bool, case when error is null then correct_num end as correct_num, error from scores""")
def _(t):
    s = scores(t)
    raw = F.coalesce(F.col("correct_bool").cast("string"), F.col("correct_num").cast("string"))
    cell = F.when(F.col("error").isNull(), F.to_json(F.struct(raw.alias("correct"), "explanation"))).otherwise(F.to_json(F.struct("error")))
    files = s.groupBy("question_id").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "tool", F.lit('":'), cell))), ","), F.lit("}")).alias("evaluation_tools"))
    return S.flatten_scores(files).drop("explanation")


@query("g02_is_correct", SCORES + "select question_id, tool, coalesce(correct_bool, correct_num = 100, false) as correct from scores")
def _(t):
    return scores(t).select("question_id", "tool", S.is_correct().alias("correct"))


@query("g03_accuracy_by_tool", SCORES + """
select tool, 'strict' as rule, cast(count(*) filter (coalesce(correct_bool, correct_num = 100) and error is null) as bigint) as correct, cast(count(*) as bigint) as total,
  round(count(*) filter (coalesce(correct_bool, correct_num = 100) and error is null) / count(*), 6) as accuracy from scores group by tool
union all select tool, 'legacy', cast(count(*) filter (coalesce(correct_bool, correct_num <> 0) and error is null) as bigint), cast(count(*) as bigint),
  round(count(*) filter (coalesce(correct_bool, correct_num <> 0) and error is null) / count(*), 6) from scores group by tool""")
def _(t):
    s = scores(t)
    return S.accuracy_by_tool(s).withColumn("rule", F.lit("strict")).unionByName(S.accuracy_by_tool(s, legacy=True).withColumn("rule", F.lit("legacy")))


@query("g04_running_accuracy", SCORES + """
select tool, question_id, cast(count(*) over w as bigint) as seen,
  round(cast(cast(sum(cast(coalesce(correct_num, case when correct_bool then 1 else 0 end) as decimal(18,6))) over w as double) / count(*) over w as double), 6) as running
from scores window w as (partition by tool order by question_id rows unbounded preceding)""")
def _(t):
    return S.running_accuracy(scores(t), "question_id").select("tool", "question_id", "seen", "running")


CI = """cast(count(*) as bigint) as n, round(avg({s}), 4) as mean, round(1.96 * stddev_pop({s}) / sqrt(count(*)), 4) as half_width,
  round(avg(case when {s} = 100 then 1.0 else 0.0 end), 4) as perfect, round(1.96 * stddev_pop(case when {s} = 100 then 1.0 else 0.0 end) / sqrt(count(*)), 4) as perfect_half_width"""
NUM = "coalesce(correct_num, case when correct_bool then 100.0 when not correct_bool then 0.0 end, 0.0)"


@query("g05_mean_ci", f"select l_returnflag, l_linestatus, {CI.format(s='l_quantity')} from lineitem group by l_returnflag, l_linestatus")
def _(t):
    return S.mean_ci(t.lineitem, ["l_returnflag", "l_linestatus"], F.col("l_quantity"))


@query("g06_perfect_rate", SCORES + f"select tool, {CI.format(s=NUM)} from scores group by tool")
def _(t):
    return S.mean_ci(scores(t), ["tool"])


@query("g07_breakdown", f"""
with s as (select o_orderstatus, o_orderpriority, cast(year(o_orderdate) as varchar) as y, 'price' as tool, least(100.0, floor(o_totalprice / 4000)) as score from orders)
select 'o_orderstatus' as dim, o_orderstatus as value, tool, {CI.format(s='score')} from s group by all
union all select 'o_orderpriority', o_orderpriority, tool, {CI.format(s='score')} from s group by all
union all select 'y', y, tool, {CI.format(s='score')} from s group by all""")
def _(t):
    o = t.orders.withColumns({"y": F.year("o_orderdate"), "tool": F.lit("price")})
    return S.breakdown(o, ["o_orderstatus", "o_orderpriority", "y"], score=F.least(F.lit(100.0), F.floor(F.col("o_totalprice") / 4000).cast("double")))


@query("g08_score_grid", """
with s as (select case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then null else o_orderstatus end as x, o_orderpriority as y, cast(o_totalprice as decimal(18,2)) as p from orders),
b as (select * from s where x is not null), g as (select x, y from (select distinct x from b union select null), (select distinct y from b union select null) where x is not null or y is not null)
select g.x, g.y, cast(count(p) as bigint) as n, round(cast(cast(sum(p) as double) / nullif(count(p), 0) as double), 4) as mean
from g left join b on (g.x is null or g.x = b.x) and (g.y is null or g.y = b.y) group by g.x, g.y""")
def _(t):
    s = t.orders.filter("not (o_orderstatus = 'P' and o_orderpriority = '5-LOW')").select(F.col("o_orderstatus").alias("x"), F.col("o_orderpriority").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    return S.score_grid(s, "x", "y", F.col("p").cast("decimal(18,2)"))


@query("g09_dataset_stats", """
with q as (select o_orderkey, o_orderstatus, o_orderpriority, count(l_orderkey) as docs from orders left join lineitem on l_orderkey = o_orderkey group by all)
select 'o_orderstatus' as dim, o_orderstatus as value, cast(count(*) as bigint) as questions, round(avg(docs), 6) as mean_documents from q group by all
union all select 'o_orderpriority', o_orderpriority, cast(count(*) as bigint), round(avg(docs), 6) from q group by all""")
def _(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("docs"))
    q = t.orders.join(n, "o_orderkey", "left").fillna({"docs": 0})
    return S.dataset_stats(q, ["o_orderstatus", "o_orderpriority"], F.col("docs"))


@query("g10_zip_metadata", """
with u as (select conv_id, turn, length(text) as asked, row_number() over (partition by conv_id order by turn) as pos from conversations where role = 'user'),
a as (select conv_id, length(text) as answered, row_number() over (partition by conv_id order by turn) as pos from conversations where role = 'assistant')
select conv_id, pos, turn, cast(asked as int) as asked, cast(answered as int) as answered from u join a using (conv_id, pos)""")
def _(t):
    c = t.conversations
    u = c.filter("role = 'user'").select("conv_id", "turn", F.length("text").alias("asked"))
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.length("text").alias("answered"))
    return N.zip_positions(u, a, ["conv_id"], "turn")


@query("g11_run_counts", """
select user_id, cast(count(*) as bigint) as total, cast(count(*) filter (event_type <> 'error') as bigint) as ok, cast(count(*) filter (event_type = 'error') as bigint) as errors from events group by user_id""")
def _(t):
    return N.run_counts(t.events, F.col("event_type") == "error", ["user_id"])


@query("g12_question_flags", SCORES + """
select question_id, bool_and(c) as all_correct, bool_or(c) as any_correct, bool_or(not c) as any_incorrect from (select question_id, coalesce(correct_bool, correct_num = 100, false) as c from scores) group by question_id
union all select doc_id, null, null, null from documents where doc_id not in (select doc_id from labels)""")
def _(t):
    s = t.documents.select(F.col("doc_id").alias("question_id")).join(scores(t).drop("lang", "source"), "question_id", "left")
    return S.question_flags(s)


YEARS = range(1995, 2002)
RUNS = f"""
with s as (select o_custkey as question_id, year(o_orderdate) as run, o_orderpriority as tool, o_totalprice > 150000 as c, o_orderstatus from orders),
cmp as (select question_id,
    {", ".join(f"bool_and(c) filter (run = {y}) as run_{i}_correct, bool_or(c) filter (run = {y}) as run_{i}_any_correct" for i, y in enumerate(YEARS))},
    count(distinct run) = {len(YEARS)} as in_all_runs from s group by question_id)
"""
EVER = "(" + " or ".join(f"coalesce(run_{i}_correct, false)" for i in range(len(YEARS))) + ")"


def all_runs(t):
    s = t.orders.select(
        F.col("o_custkey").alias("question_id"), F.year("o_orderdate").alias("run"), F.col("o_orderpriority").alias("tool"),
        (F.col("o_totalprice") > 150000).alias("correct_bool"), F.lit(None).cast("double").alias("correct_num"),
    )
    return S.compare_runs(s, list(YEARS))


@query("g13_compare_runs", RUNS + "select * from cmp")
def _(t):
    return all_runs(t)


@query("g14_regressions", RUNS + """
select 'regressed' as preset, question_id from cmp where run_0_correct and not run_1_correct
union all select 'all_wrong', question_id from cmp where not """ + EVER + """
union all select 'any_right', question_id from cmp where """ + EVER)
def _(t):
    c = all_runs(t)
    parts = [S.regressions(c, p, len(YEARS)).select(F.lit(p).alias("preset"), "question_id") for p in ("regressed", "all_wrong", "any_right")]
    return parts[0].union(parts[1]).union(parts[2])


@query("g15_questions_wide", SCORES + """
select question_id, lang, max(cast(correct_bool as varchar)) as judge, bool_or(correct_bool) filter (tool = 'judge') as judge_correct,
  max(cast(correct_num as double)) as rubric, bool_or(correct_num = 100) filter (tool = 'rubric') as rubric_correct from scores group by question_id, lang""")
def _(t):
    return S.questions_wide(scores(t), ["judge", "rubric"], ["question_id", "lang"]).withColumn("rubric", F.col("rubric").cast("double"))


@query("g16_tool_breakdown", SCORES + """
select tool, lang, cast(count(*) filter (coalesce(correct_bool, correct_num = 100) and error is null) as bigint) as correct, cast(count(*) as bigint) as total,
  round(100 * count(*) filter (coalesce(correct_bool, correct_num = 100) and error is null) / count(*), 4) as percent from scores group by tool, lang""")
def _(t):
    a = S.accuracy_by_tool(scores(t), ["tool", "lang"])
    return a.select("tool", "lang", "correct", "total", F.round(100.0 * F.col("correct") / F.col("total"), 4).alias("percent"))


@query("g17_stats_with_examples", """
with r as (select o_orderkey as question_id, o_totalprice > 200000 as ok, o_orderstatus, o_orderpriority from orders),
l as (select question_id, ok, 'o_orderstatus' as dim, o_orderstatus as value from r union all select question_id, ok, 'o_orderpriority', o_orderpriority from r),
k as (select *, row_number() over (partition by dim, value, ok order by question_id) as k from l)
select dim, value, cast(count(*) as bigint) as total, cast(count(*) filter (ok) as bigint) as correct,
  coalesce(string_agg(cast(question_id as varchar), ',' order by question_id) filter (ok and k <= 3), '') as successes,
  coalesce(string_agg(cast(question_id as varchar), ',' order by question_id) filter (not ok and k <= 3), '') as failures from k group by dim, value""")
def _(t):
    r = t.orders.select(F.col("o_orderkey").alias("question_id"), (F.col("o_totalprice") > 200000).alias("all_correct"), "o_orderstatus", "o_orderpriority")
    return S.stats_with_examples(r, ["o_orderstatus", "o_orderpriority"])


@query("g18_avg_numeric_score", SCORES + """
select tool, cast(count(*) as bigint) as n, round(avg(coalesce(correct_num, case when correct_bool then 1.0 else 0.0 end)), 6) as mean from scores where error is null group by tool""")
def _(t):
    s = scores(t).withColumn("explanation", F.when(F.col("error").isNull(), F.col("explanation")))
    return S.avg_numeric_score(s)


@query("g19_merge_on_answers", """
select c_custkey, case when c_acctbal > 0 then c_mktsegment when n is not null then 'from log' end as domain, coalesce(n, -1) as score
from customer left join (select o_custkey, cast(count(*) as bigint) as n from orders group by o_custkey) on o_custkey = c_custkey""")
def _(t):
    key = [F.concat(F.lit("gold "), "k").alias("gold"), F.concat(F.lit("pred "), "k").alias("predicted")]
    q = t.customer.withColumn("k", F.col("c_custkey").cast("string")).select("c_custkey", *key, F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("domain"), F.lit(-1).cast("bigint").alias("score"))
    r = t.orders.groupBy(F.col("o_custkey").cast("string").alias("k")).agg(F.count("*").alias("score")).select(*key, F.lit("from log").alias("domain"), "score")
    return S.merge_on_answers(q, r, ["domain"], ["score"]).select("c_custkey", "domain", "score")


def log_lines(t):
    """Each event is one log line; a purchase opens a question; the last tenth of a log is its summary."""
    e = t.events.select("event_id", (F.col("user_id") % 7).alias("log"), "event_type", "user_id", F.round("value", 2).cast("decimal(10,2)").cast("string").alias("v"))
    n, k = F.col("event_id").cast("string"), F.col("event_type")
    head = F.concat(F.lit("=== 1 of 9 | kind"), (F.col("user_id") % 3).cast("string"), F.lit(", level"), (F.col("user_id") % 2).cast("string"), F.lit(" | Question q"), n, F.lit(" ==="))
    msg = (
        F.when(k == "purchase", head)
        .when(k == "click", F.concat(F.lit("Gold Answer: g"), n))
        .when(k == "view", F.concat(F.lit("Predicted Answer: p"), n))
        .when(k == "error", F.concat(F.lit("LLMAsJudge soft_evaluator: score: "), F.when(F.col("user_id") % 2 == 0, "True").otherwise("0.5")))
        .otherwise("note")
    )
    return e.select("log", F.col("event_id").alias("line"), msg.alias("message"))


@query("g20_segment_log", """
with e as (select event_id, user_id % 7 as log, user_id, event_type from events),
s as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by log order by event_id rows unbounded preceding) as segment from e)
select log, cast(segment as bigint) as segment, max('q' || event_id) filter (event_type = 'purchase') as question_id, max('kind' || user_id % 3) filter (event_type = 'purchase') as question_type,
  max('level' || user_id % 2) filter (event_type = 'purchase') as question_level, arg_max('g' || event_id, event_id) filter (event_type = 'click') as gold_answer,
  arg_max('p' || event_id, event_id) filter (event_type = 'view') as predicted_answer, cast(count(*) as bigint) as lines,
  arg_max(case when user_id % 2 = 0 then 'true' else '0.5' end, event_id) filter (event_type = 'error') as soft_evaluator
from s where segment > 0 group by log, segment""")
def _(t):
    out = N.segment_log(log_lines(t)).drop("hard_evaluator")
    return out.withColumn("question_id", F.trim("question_id"))


@query("g21_parse_summary", """
with e as (select event_id, user_id % 7 as log, event_type, user_id, cast(round(value, 2) as decimal(10,2)) as v, min(event_id) over (partition by user_id % 7) as first_id from events),
m as (select *, event_id > first_id and event_type = 'purchase' and user_id % 3 = 0 as sec, event_id > first_id and event_type = 'purchase' and user_id % 3 = 1 as sec2, event_id > first_id and event_type = 'click' as grp from e),
x as (select *, max(case when sec or sec2 then event_id end) over w as sec_at, last_value(case when sec then 'domain' when sec2 then 'level' end ignore nulls) over w as section,
  from m window w as (partition by log order by event_id rows unbounded preceding)),
y as (select *, max(case when grp and section is not null then event_id end) over w as grp_at from x window w as (partition by log order by event_id rows unbounded preceding))
select log, event_id as line, coalesce(section, 'overall') as section, case when grp_at > sec_at then 'g' || cast(grp_at as varchar) end as name,
  case when grp_at > sec_at then grp_at end as n, 'LLMAsJudgeTool soft' as evaluator, cast(v as double) as score
from y where event_type = 'view' and event_id > first_id""")
def _(t):
    e = t.events.select("event_id", (F.col("user_id") % 7).alias("log"), "event_type", "user_id", F.round("value", 2).cast("decimal(10,2)").cast("string").alias("v"))
    first = e.groupBy("log").agg(F.min("event_id").alias("f"))
    n, k, u = F.col("event_id").cast("string"), F.col("event_type"), F.col("user_id") % 3
    msg = (
        F.when(F.col("event_id") == F.col("f"), "=== EXPERIMENT COMPLETE ===")
        .when((k == "purchase") & (u == 0), "--- question_domain: all ---")
        .when((k == "purchase") & (u == 1), "--- question_level: all ---")
        .when(k == "click", F.concat(F.lit("g"), n, F.lit(": ------------------------------------ (N="), n, F.lit(")")))
        .when(k == "view", F.concat(F.lit("LLMAsJudgeTool soft: "), "v", F.lit(" ± 0.1")))
        .otherwise("note")
    )
    return N.parse_summary(e.join(first, "log").select("log", F.col("event_id").alias("line"), msg.alias("message")))


@query("g22_bucket_calls", """
select conv_id, turn, role, cast(sum(case when role = 'system' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as bucket from conversations""")
def _(t):
    return N.segments(t.conversations.select("conv_id", "turn", "role"), F.col("role") == "system", ["conv_id"], "turn")


@query("g23_match_bucket", """
select doc_id, min(item_id) as item_id from documents join benchmark on contains(documents.text, benchmark.text) group by doc_id""")
def _(t):
    b = t.benchmark.select("item_id", F.col("text").alias("question"))
    return N.match_bucket(t.documents.select("doc_id", "text"), b, "doc_id", "text", "item_id", "question")


@query("g24_bucket_status", """
with s as (select lang, doc_id, case when quality is null then 'Unknown' when quality = 1 then 'Correct' else 'Incorrect' end as status from documents left join labels using (doc_id))
select lang, status, cast(count(*) as bigint) as n, min(doc_id) as first_id, max(doc_id) as last_id, cast(sum(count(*)) over (partition by lang) as bigint) as total,
  round(100 * count(*) / sum(count(*)) over (partition by lang), 4) as percent from s group by lang, status""")
def _(t):
    b = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").withColumn("ok", F.col("quality") == 1)
    return S.bucket_status(b, "ok", "doc_id", ["lang"])


@query("g24_wrong_ids", "select doc_id from labels where quality = 0")
def _(t):
    return S.wrong_ids(t.labels.withColumn("ok", F.col("quality") == 1), "ok", "doc_id")


def call_events(t):
    kind = F.when(F.col("event_type") == "view", N.START).when(F.col("event_type") == "click", N.END).when(F.col("event_type") == "purchase", N.FRAME)
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("string")
    rid = F.concat_ws("-", F.col("user_id").cast("string"), hour)
    e = t.events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), kind.alias("event"), F.when(F.col("event_id") % 2 == 0, rid).alias("request_id"), F.when(F.col("event_id") % 2 == 1, rid).alias("parent_run_id"))
    return e.withColumn("request", N.request_id(e))


PAIRS = """
with e as (select event_id, epoch_us(ts) as us, event_type, user_id || '-' || (epoch_us(ts) // 3600000000) as request from events),
p as (select request, 'call' as kind, max(us) filter (event_type = 'view') as start_us, max(us) filter (event_type = 'click') as end_us,
    count(*) filter (event_type = 'view') > 0 and count(*) filter (event_type = 'click') > 0 as matched
  from e where event_type in ('view', 'click') group by request
  union all select request, 'frame', us, us, true from e where event_type = 'purchase')
"""


@query("g25_pair_events", PAIRS + "select *, round((end_us - start_us) / 1000.0, 3) as duration_ms from p")
def _(t):
    return N.pair_events(call_events(t), ["request"])


@query("g26_call_kpis", PAIRS + """
select kind, cast(count(*) as bigint) as total, cast(count(*) filter (matched and end_us >= start_us) as bigint) as visible, cast(count(*) filter (not matched) as bigint) as unmatched from p group by kind""")
def _(t):
    return N.call_kpis(N.pair_events(call_events(t), ["request"]), F.col("matched") & (F.col("end_us") >= F.col("start_us")), ["kind"])


@query("g28_latency_tokens", """
with e as (select event_type, user_id % 3 as model, value, cast(props->>'$.k' as bigint) as tokens, row_number() over (partition by event_type, user_id % 3 order by value) as k, count(value) over (partition by event_type, user_id % 3) as n from events)
select event_type, model, cast(count(*) as bigint) as calls, max(value) filter (k = greatest(1, ceil(n * 0.5))) as p50, max(value) filter (k = greatest(1, ceil(n * 0.95))) as p95, max(value) as worst, cast(sum(tokens) as bigint) as tokens
from e group by event_type, model""")
def _(t):
    e = t.events.select("event_type", (F.col("user_id") % 3).alias("model"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))
    return N.latency_tokens(e, ["event_type", "model"], "value", "tokens", approximate=False)


@query("g29_cost", """
with c as (select role as template, case role when 'user' then 'large' when 'assistant' then 'small' end as model, length(text) // 4 as in_tokens, length(text) // 8 as out_tokens from conversations)
select template, model, cast(count(*) as bigint) as calls, cast(sum(in_tokens) as bigint) as in_tokens, cast(sum(out_tokens) as bigint) as out_tokens,
  round((sum(in_tokens) * case model when 'large' then 2.0 else 0.4 end + sum(out_tokens) * case model when 'large' then 8.0 else 1.6 end) / 1e6, 8) as cost
from c where model is not null group by template, model""")
def _(t):
    c = t.conversations.select(F.col("role").alias("template"), F.floor(F.length("text") / 4).alias("in_tokens"), F.floor(F.length("text") / 8).alias("out_tokens"))
    return N.cost(c, {"user": "large", "assistant": "small"}, {"large": (2.0, 8.0), "small": (0.4, 1.6)})


@query("g30_uncached_requests", """
with r as (select conv_id, turn, md5(text || ':' || role || ':json') as key, cast(case when role = 'system' then 1 else 0 end as double) as temperature from conversations)
select key, cast(count(*) as bigint) as n, temperature from r where temperature > 0 group by key, temperature
union all select key, 1, temperature from (select distinct key, temperature from r where temperature = 0 and key not in (select key from r where turn = 0))""")
def _(t):
    key = N.request_key(F.col("text"), F.col("role"), F.lit("json"))
    r = t.conversations.select("turn", key.alias("key"), F.when(F.col("role") == "system", 1.0).otherwise(0.0).alias("temperature"))
    return N.uncached(r, r.filter("turn = 0")).groupBy("key", "temperature").agg(F.count("*").alias("n"))


PAGE_FILES = """
with l as (select 'logs/run_' || page_id || '_' || (page_id * 3) || '.jsonl' as name from pages where page_id % 3 <> 0),
r as (select 'results/' || case when page_id % 2 = 0 then 'final' else 'sample_x' end || '_' || page_id || '_' || (page_id * 3) || '.json' as name, page_id from pages where length(html) > 3000)
"""


@query("g31_link_by_timestamp", PAGE_FILES + """
, a as (select regexp_extract(name, '([0-9]+_[0-9]+)\\.', 1) as stamp, name from l), b as (select regexp_extract(name, '([0-9]+_[0-9]+)\\.', 1) as stamp, name from r)
select coalesce(a.stamp, b.stamp) as stamp, a.name as log_file, b.name as results_file from a full outer join b on a.stamp = b.stamp""")
def _(t):
    p, q = F.col("page_id").cast("string"), (F.col("page_id") * 3).cast("string")
    logs = t.pages.filter("page_id % 3 <> 0").select(F.concat(F.lit("logs/run_"), p, F.lit("_"), q, F.lit(".jsonl")).alias("name"))
    kind = F.when(F.col("page_id") % 2 == 0, "final").otherwise("sample_x")
    res = t.pages.filter("length(html) > 3000").select(F.concat(F.lit("results/"), kind, F.lit("_"), p, F.lit("_"), q, F.lit(".json")).alias("name"))
    return N.link_by_timestamp(logs, res)


@query("g31_link_by_experiment", """
with l as (select 'logs/' || case when page_id % 2 = 0 then '' else 'old-' end || md5(cast(page_id // 2 as varchar)) || '.jsonl' as name, page_id as mtime from pages where page_id % 5 <> 0),
r as (select distinct 'results/final_' || md5(cast(page_id // 2 as varchar)) || '.json' as name, md5(cast(page_id // 2 as varchar)) as id from pages),
x as (select r.name, r.id, max(l.name) filter (l.name = 'logs/' || id || '.jsonl') as exact, arg_max(l.name, (l.mtime, l.name)) filter (l.name is not null) as loose from r left join l on contains(l.name, r.id) group by all)
select name as results_file, id, coalesce(exact, loose) as log_file from x""")
def _(t):
    h = F.md5(F.floor(F.col("page_id") / 2).cast("string"))
    logs = t.pages.filter("page_id % 5 <> 0").select(F.concat(F.lit("logs/"), F.when(F.col("page_id") % 2 == 0, "").otherwise("old-"), h, F.lit(".jsonl")).alias("name"), F.col("page_id").alias("mtime"))
    res = t.pages.select(F.concat(F.lit("results/final_"), h, F.lit(".json")).alias("name")).distinct()
    return N.link_by_experiment(res, logs)


@query("g32_first_answer", """
select conv_id, coalesce(arg_min(md5(text), turn) filter (contains(text, 'The')), arg_max(md5(text), turn)) as answer, min(turn) filter (contains(text, 'The')) as found_at from conversations group by conv_id""")
def _(t):
    c = t.conversations.withColumn("a", F.md5("text"))
    return N.first_answer(c, ["conv_id"], "turn", F.col("text").contains("The"), "a")


@query("g33_bucket_profile", """
select conv_id, role as template, cast(count(*) as bigint) as calls, min(coalesce(case when turn > 3 then 'late' end, 'turn ' || turn)) as id, min(length(text)) as gold from conversations group by conv_id, role""")
def _(t):
    c = t.conversations.select("conv_id", F.col("role").alias("template"), F.when(F.col("turn") > 3, "late").alias("id_a"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("question_id"), F.length("text").cast("bigint").alias("gold_answer"))
    return N.bucket_profile(c, ["conv_id"], {"id": ["id_a", "question_id"], "gold": ["gold", "gold_answer"]})


@query("g34_attach_log_documents", """
with d as (select doc_id % 50 as question_id, lang || doc_id as name from documents where n_chars > 500), l as (select doc_id % 50 as question_id, lang || doc_id as name, source as o, 'about ' || source as g from documents where source <> 'src0')
select d.question_id, d.name, l.o as original_description, l.g as generated_description, true as matched from d left join l using (question_id, name)
union all select question_id, name, o, g, false from l where name not in (select name from d)""")
def _(t):
    x = t.documents.select((F.col("doc_id") % 50).alias("question_id"), F.concat("lang", F.col("doc_id").cast("string")).alias("name"), "n_chars", "source")
    d = x.filter("n_chars > 500").select("question_id", "name")
    log = x.filter("source <> 'src0'").select("question_id", "name", F.col("source").alias("original_description"), F.concat(F.lit("about "), "source").alias("generated_description"))
    out, missing = N.attach_log_documents(d, log)
    return out.withColumn("matched", F.lit(True)).unionByName(missing.withColumn("matched", F.lit(False)))
